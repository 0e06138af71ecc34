"""Nulls, empty and very long texts, ties, repeated rows, empty tables, foreign columns."""

import pytest

from flowsieve.llm import fixity, minmax_dedup, mixing, near_vectors, packing, quality_rules, rule_ensemble, secrets, token_counts, url_rules
from flowsieve.llm.queries import URL_LIST, vocabulary

LONG = "many different words here and there " * 60_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, n_words string, size int, row int, copies int, block int, file int, offset int, digest string, kept boolean, piece int"
ROWS = [
    (1, "a b c d e f g"), (2, "A b C d E f g"), (2, "A b C d E f g"), (3, None), (4, ""), (None, "a b c d e f g"), (None, None),
    (5, "password=abcdefgh12345"), (6, "x"), (6, "y z"), (7, LONG), (8, LONG), (9, " \n\t"), (10, "token"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None, None if d == 6 else "s", None, 1, "x", 2, 3, 4, 5, 6, 7, "q", None, 9) for d, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 1, None), (None, 1, 1), (3, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "dedup": lambda d, lab: minmax_dedup.near_duplicates(d),
    "one of each": lambda d, lab: minmax_dedup.one_of_each(d),
    "secrets": lambda d, lab: secrets.find_secrets(d),
    "mask": lambda d, lab: secrets.mask_secrets(d),
    "mix": lambda d, lab: mixing.mix(d),
    "mixed": lambda d, lab: mixing.mixed_documents(d),
    "judge": lambda d, lab: quality_rules.judge(d, lab),
    "passing": lambda d, lab: quality_rules.passing(d, lab),
    "score": lambda d, lab: rule_ensemble.score(d, lab),
    "tokens": lambda d, lab: token_counts.count_tokens(d, vocabulary("byte_bpe_50k.json")),
    "pack": lambda d, lab: packing.pack_documents(d, vocabulary("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, labels, name):
    out = OPERATORS[name](docs, labels).toPandas()
    if name in ("dedup", "secrets", "mask", "mix", "judge", "score", "tokens"):
        assert sorted(out.doc_id.fillna(-1)) == sorted(-1 if d is None else d for d, _ in ROWS)
    if name in ("one of each", "mask", "mixed", "passing"):
        assert list(out.columns) == docs.columns
    if name == "dedup":
        assert out[out.doc_id == 2].component_id.tolist() == [1, 1]
        assert out[out.doc_id == 8].component_id.tolist() == [7]
        assert out[out.doc_id.isna()].kept.all() and out[out.doc_id.isin([3, 4, 9])].kept.all()
        assert out[out.doc_id.isin([3, 4, 9])].n_shingles.tolist() == [0, 0, 0]
    if name == "one of each":
        assert sorted(out.doc_id.fillna(-1)) == [-1, -1, 1, 3, 4, 5, 6, 6, 7, 9, 10]
    if name == "secrets":
        assert out[out.doc_id == 5].spans.tolist() == ["assign:0:22"]
    if name == "mask":
        assert out[out.doc_id == 5].text.tolist() == ["[secret]"] and out[out.doc_id == 3].text.isna().all()
    if name == "mix":
        assert out[out.doc_id == 7]["size"].tolist() == [360_000] and out[out.doc_id.isin([3, 4, 9])].copies.sum() == 0
    if name == "tokens":
        assert out[out.doc_id.isin([3, 4])].n_tokens.tolist() == [0, 0]
    if name == "pack":
        assert out[out.doc_id.isin([3, 4])].length.tolist() == [1, 1]
        assert out[out.doc_id == 7].length.sum() == 360_001


def test_untrained_without_labels(docs, labels):
    judged = quality_rules.judge(docs, labels.limit(0)).toPandas()
    assert (judged.kept == ~judged.base_failed).all()
    assert rule_ensemble.score(docs, labels.limit(0)).toPandas().score.between(0, 1).all()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 6), (2, None, 7), (None, [1.0, 0.0], 8), (3, [0.0, 1.0], 9), (3, None, 1), (4, [2.0, 0.0], 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    out = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(vectors).collect())
    assert out == [(-1, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (3, 0, 3, True), (4, 2, 1, False)]
    assert near_vectors.near_vectors(vectors.limit(0)).count() == 0


def test_odd_pages(spark):
    rows = [(1, "http://a.com/x", "h", 1), (1, "http://a.com/x", "h", 1), (None, None, None, None), (2, "", "", 2), (3, "HTTP://WWW.Example.COM/en/a?b#c", None, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    mined = url_rules.mine(spark.createDataFrame([], "url string, block boolean"))
    judged = sorted((r.page_id or -1, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, URL_LIST, mined).collect())
    assert judged == [(-1, "", "", None, "allow"), (1, "a.com", "/x", "com/", "allow"), (1, "a.com", "/x", "com/", "allow"), (2, "", "", None, "allow"), (3, "www.example.com", "/en/a", "www.example.com/en/", "allow")]
    assert url_rules.judge(pages.limit(0), URL_LIST, mined).count() == 0
    whole = fixity.archive(pages)
    assert whole.count() == 5 and fixity.audit(whole, whole).count() == 0
    assert fixity.audit(whole, whole.limit(0)).count() == 5
    assert fixity.audit(whole.limit(0), whole.limit(0)).count() == 0


def test_a_worker_keeps_one_operators_memo(spark):
    """The next operator's stage runs in the same workers: what the last one remembered is freed."""
    from flowsieve.llm import common, minmax_dedup, packing
    from flowsieve.llm.queries import vocabulary

    path = vocabulary("word_bpe_49k.json")
    packing.word_ids("some words", path)
    minmax_dedup.shingle_set("some words", 3)
    common.forget_others(packing.__name__)
    assert len(packing._words(path)) == 2 and not minmax_dedup._hashes
    minmax_dedup.shingle_set("some words", 3)
    common.forget_others(minmax_dedup.__name__)
    assert not packing._words(path) and len(minmax_dedup._hashes) == 2

    def held(batch):
        import pyarrow as pa

        minmax_dedup._hashes[b"left"] = 1
        return pa.RecordBatch.from_arrays([pa.array([len(minmax_dedup._hashes)] * batch.num_rows)], ["n"])

    from pyspark.sql import types as T

    held.__module__ = "flowsieve.llm.quality_rules"
    rows = spark.range(0, 64, 1, 8)
    for _ in range(2):
        found = common.map_batches(rows, held, [T.StructField("n", T.LongType())]).distinct().collect()
        assert [r["n"] for r in found] == [1]
