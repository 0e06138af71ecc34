"""URL filtering: a fixed list of rules first, mined association rules for the rest.

DataFrame functions and Spark ML's FP-growth only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class ListRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def list_rule(verdict: str, text: str) -> ListRule:
    """``text`` is a host and the start of a path, as ``example.com/en/``."""
    host, slash, rest = text.partition("/")
    return ListRule(verdict, host, slash + rest)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without ``://`` or url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def tokens(url: Column) -> Column:
    """Distinct runs of letters and digits after the scheme, lower case."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    return F.array_distinct(F.filter(F.split(F.lower(rest), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def _anchored(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``sets`` (items and others) with each of the ``rules`` (part, anchor and
    others) whose part they hold: an inverted index from a rule's anchor, its rarest item."""
    hits = sets.withColumn("anchor", F.explode("items")).join(rules, "anchor")
    return hits.where(F.size(F.array_except("part", "items")) == 0)


def _with_classes(sets: DataFrame, often: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, members, blocked) of tokens that stand in exactly the same URLs, told by a
    fingerprint of these, and ``sets`` with the classes they hold as ``items``."""
    classes = often.groupBy("print", "print2", "n").agg(F.min("token").alias("class"), F.array_sort(F.collect_list("token")).alias("members"), F.first("blocked").alias("blocked"))
    classes = staged(classes.select("class", "members", "blocked"), "token-classes")
    names = classes.select("class", F.explode("members").alias("token"))
    held = sets.withColumn("token", F.explode("tokens")).join(names, "token")
    items = held.groupBy("print", "print2").agg(F.array_sort(F.collect_set("class")).alias("items"), F.first("blocked").alias("blocked"), F.first("seen").alias("seen"))
    return classes, staged(items, "class-sets")


def mine(labelled: DataFrame, least: int = 20, confidence: float = 0.6) -> DataFrame:
    """Rules (items, members, blocked, seen, confidence) from ``labelled`` (url, block).

    A rule is a set of tokens that ``least`` blocked URLs or more hold together, blocked
    in a share of ``confidence`` or more of all labelled URLs that hold them, and minimal:
    no part of it is as good as that. Tokens that are rules alone are never extended.
    Tokens that stand in exactly the same URLs act as one item (``items`` names the first,
    ``members`` lists the choices for each), so a long URL seen many times is one item and
    not all combinations of its tokens. FP-growth finds the combinations of the rest; they
    are counted among all URLs by an inverted index, over distinct token sets.

    Null urls and labels teach nothing, repeated rows count as often as they are there,
    equal counts tie by token. Long URLs are whole. An empty table gives no rules; other
    columns are ignored.
    """
    rows = labelled.where("url is not null and block is not null").select(F.array_sort(tokens(F.col("url"))).alias("tokens"), "block")
    sets = rows.groupBy("tokens").agg(F.count_if("block").alias("blocked"), F.count(F.lit(1)).alias("seen"))
    sets = staged(sets.select("*", F.xxhash64("tokens").alias("print"), F.xxhash64("tokens", F.lit(1)).alias("print2")), "url-sets")
    single = sets.withColumn("token", F.explode("tokens")).groupBy("token").agg(
        F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"), F.bit_xor("print").alias("print"), F.bit_xor("print2").alias("print2"), F.count(F.lit(1)).alias("n"),
    )
    single = staged(single.where(F.col("blocked") >= least).withColumn("confidence", F.col("blocked") / F.col("seen")), "url-tokens")
    alone = single.where(F.col("confidence") >= confidence)
    alone = alone.select(F.array("token").alias("items"), F.array(F.array("token")).alias("members"), "blocked", "seen", "confidence")
    classes, held = _with_classes(sets, single.where(F.col("confidence") < confidence))
    bad = held.where((F.col("blocked") > 0) & (F.size("items") > 1))
    n = bad.agg(F.coalesce(F.sum("blocked"), F.lit(0))).first()[0]
    if n < least:
        return staged(alone, "url-rules")
    # Half a URL below the floor: the share times the rows is rounded up.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(bad.select("items", F.explode(F.sequence(F.lit(1).cast("long"), "blocked"))).select("items"))
    combos = model.freqItemsets.where((F.size("items") > 1) & (F.col("freq") >= least)).select(F.array_sort("items").alias("part"), F.col("freq").alias("blocked"))
    rarest = F.min_by("class", F.struct(F.col("often"), "class")).alias("anchor")
    anchors = combos.withColumn("class", F.explode("part")).join(classes.select("class", F.col("blocked").alias("often")), "class")
    combos = staged(anchors.groupBy("part").agg(F.first(F.col("blocked")).alias("blocked"), rarest), "combinations")
    seen = _anchored(held.select("items", F.col("seen").alias("times")), combos.select("part", "anchor")).groupBy("part").agg(F.sum("times").alias("seen"))
    sure = combos.join(seen, "part").withColumn("confidence", F.col("blocked") / F.col("seen")).where(F.col("confidence") >= confidence)
    sure = staged(sure.withColumn("length", F.size("part")), "sure-sets")
    minimal: DataFrame | None = None
    for length in sorted(r["length"] for r in sure.select("length").distinct().collect()):  # lengths, a handful
        level = sure.where(F.col("length") == length)
        if minimal is not None:
            longer = level.select(F.col("part").alias("items"))
            needless = _anchored(longer, minimal.select("part", "anchor")).select("items").distinct()
            level = level.join(needless, F.col("part") == F.col("items"), "left_anti")
            level = minimal.unionByName(level)
        minimal = staged(level, "minimal-sets")
    if minimal is None:
        return staged(alone, "url-rules")
    choices = minimal.select("part", F.posexplode("part").alias("place", "class")).join(classes.select("class", "members"), "class")
    members = choices.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "members"))), lambda c: c["members"]).alias("members"))
    combined = minimal.join(members, "part").select(F.col("part").alias("items"), "members", "blocked", "seen", "confidence")
    return staged(alone.unionByName(combined), "url-rules")


def _fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``urls`` (tokens and others) with each rule of which they hold a member of
    every item: an inverted index from the members of the item with the fewest to the rule."""
    fewest = F.array_min(F.transform("members", lambda m, i: F.struct(F.size(m).alias("n"), i.alias("place"))))["place"]
    index = rules.withColumn("anchor", F.explode(F.get("members", fewest)))
    hits = urls.withColumn("anchor", F.explode("tokens")).join(index, "anchor")
    return hits.where(F.forall("members", lambda m: F.arrays_overlap(m, F.col("tokens"))))


def judge(pages: DataFrame, listed: Sequence[ListRule], mined: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, mined_rule, confidence.

    Of the listed rules that fit, the longest decides. Without one, a page that has all
    tokens of a mined rule is blocked (mined_rule is the surest, then the shortest), any other allowed.
    Null urls and those without ``://`` have an empty host and path and are allowed
    unless a mined rule fits. Repeated rows are judged alike; other columns are
    ignored; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    pairs = [(r.fits(F.col("host"), F.col("path")), r) for r in sorted(listed, key=lambda r: -len(r.text))]
    pick = lambda value: reduce(lambda rest, p: F.when(p[0], F.lit(value(p[1]))).otherwise(rest), reversed(pairs), F.lit(None).cast("string"))
    rows = rows.withColumn("rule", pick(lambda r: r.text)).withColumn("verdict", pick(lambda r: r.verdict))
    open_urls = rows.where("rule is null and url is not null").select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    surest = F.max_by(F.struct("items", "confidence"), F.struct("confidence", -F.size("items"), "items")).alias("best")
    hits = _fitting(open_urls, mined.select("items", "members", "confidence")).groupBy("url").agg(surest)
    out = rows.join(hits, "url", "left")
    listed_or = F.coalesce("verdict", F.when(F.col("best").isNotNull(), "block").otherwise("allow"))
    by_mined = F.when(F.col("rule").isNull(), F.array_join("best.items", " "))
    return out.select("page_id", "host", "path", "rule", listed_or.alias("verdict"), by_mined.alias("mined_rule"), F.when(F.col("rule").isNull(), F.col("best.confidence")).alias("confidence"))
