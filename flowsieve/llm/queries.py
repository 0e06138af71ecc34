"""Queries op1 to op13 over the given tables, thin forms of the operators; and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import fixity, hard_negatives, lexical_search, license_index, minmax_dedup, mixing, near_vectors, packing, quality_rules, rule_ensemble, secrets, token_counts, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def near_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with changed, shortened and lost records."""
    primary = fixity.archive(_table(spark, sf_dir, "pages"))
    fate = F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 2)
    changed = F.overlay("record", F.lit("#").cast("binary"), F.lit(6))
    shorter = F.substring("record", F.lit(1), F.octet_length("record") - 1)
    replica = primary.where(~fate.eqNullSafe("04")).withColumn("record", F.when(fate.isin("00", "01"), changed).when(fate.isin("02", "03"), shorter).otherwise(F.col("record")))
    return fixity.audit(primary, replica).select("page_id", "status", "length", "expected")


def secret_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def mixing_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def quality_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def packing_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), size=4096)


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def quality_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, similarity=0.85)


# The rule list of the query.
URL_LIST = [
    url_rules.list_rule("allow", "com/"), url_rules.list_rule("block", "example.com/en/"), url_rules.list_rule("allow", "www.example.com/en/"),
    url_rules.list_rule("block", "net/es/"), url_rules.list_rule("block", "net/fr/"),
]


def url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by the list, then by rules mined from the labels of the documents which their URLs name."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    number = F.expr(r"try_cast(regexp_extract(url, '://[^/]*/[^/]*/([0-9]+)', 1) as bigint)")
    labelled = pages.withColumn("doc_id", number).join(labels, "doc_id").select("url", "block")
    return url_rules.judge(pages, URL_LIST, url_rules.mine(labelled))


def hard_negative_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels move on by one where the id is divisible by 7; anchors are the ids divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def license_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vector_links": near_vector_links,
    "op2_secret_models": secret_models,
    "op3_merkle_fixity": merkle_fixity,
    "op4_mixing_pareto": mixing_pareto,
    "op5_quality_isolation": quality_isolation,
    "op6_packing_best_fit": packing_best_fit,
    "op7_token_lengths": token_lengths,
    "op8_quality_rule_ensemble": quality_rule_ensemble,
    "op9_minmax_near_duplicates": minmax_near_duplicates,
    "op10_url_association_rules": url_association_rules,
    "op11_hard_negative_lists": hard_negative_lists,
    "op12_dual_tree_search": dual_tree_search,
    "op13_license_positions": license_positions,
}
ORACLES: dict[str, str] = {
    "op3_merkle_fixity": r"""
        WITH records AS (
            SELECT page_id, left(sha256(CAST(page_id AS VARCHAR)), 2) AS fate,
                'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
                || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
                || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM pages)
        SELECT page_id, CASE WHEN fate = '04' THEN 'missing' ELSE 'corrupt' END AS status,
            CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS expected
        FROM records WHERE fate IN ('00', '01', '02', '03', '04')
    """,
    "op11_hard_negative_lists": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
            FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, other_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place
            FROM s WHERE same),
        n AS (
            SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS place
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
            WHERE p.place <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE place <= 10
    """,
    "op12_dual_tree_search": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        i AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        bag AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY ALL),
        size AS (SELECT count(*) FILTER (WHERE len(words) > 0) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d),
        o AS (SELECT doc, doc_id, len(words) AS n, unnest(words) AS term FROM d),
        tf AS (SELECT doc, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM o WHERE term IN (SELECT term FROM bag) GROUP BY doc, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, size GROUP BY term),
        scored AS (
            SELECT item_id, doc, any_value(doc_id) AS doc_id,
                CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms))))) AS BIGINT) AS score
            FROM tf JOIN w USING (term) JOIN bag USING (term), size GROUP BY item_id, doc),
        ranked AS (
            SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
            FROM scored WHERE score > 0)
        SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
    """,
}
