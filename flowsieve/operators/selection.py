"""Exact random selections per group without sorting the groups.

Rows are ordered at random by a hash of their key. Taking the first ``want``
rows of a group then only needs the hash at position ``want``. That threshold is
found by counting hash prefixes, which combine before the shuffle, so a group which
holds most of the table costs what a small one costs. The rows under the one prefix
of a group which holds the position are written out with their counts, and further
digits are read from that small table only: two passes over the rows find any
threshold. The selection itself is a comparison with a broadcast threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import ref
from flowsieve.functions.hashing import row_hash
from flowsieve.session import Pinned, stage

# A hash has 32 digits; a stored order may add 16 digits of a row number to it.
HASH_DIGITS = 48
STEP_DIGITS = 3
# Below this many rows under one prefix the remaining digits are read at once.
FINE_ROWS = 50_000
# Copies of one row written by a single task when a threshold falls among copies.
COPY_CHUNK = 100_000

STRATUM, HASH = "_stratum", "_hash"
ALL, NONE = "g", ""  # sort after and before every hexadecimal text


def stored_order(seed: int, row_id: Sequence[str]) -> Column:
    """Distinct hash text for a table about to be written.

    Copies of a row get consecutive texts by a row number which the written
    table fixes; which copy comes first does not change any selection.
    """
    number = F.lpad(F.lower(F.hex(F.monotonically_increasing_id())), 16, "0")
    return F.concat(row_hash(seed, row_id), number)


Quota = Callable[[DataFrame], DataFrame]


def find_thresholds(rows: DataFrame, quota: Quota, fine_rows: int = FINE_ROWS) -> Pinned:
    """Threshold hash of each stratum.

    ``rows`` holds (stratum, hash); ``quota`` turns the sizes (stratum, n) into
    (stratum, n, want). The result holds (stratum, cut, take, ties): rows with a
    hash below ``cut`` are taken, and ``take`` of the ``ties`` rows at ``cut``.
    """
    # The sizes and the first cut come from one pass over the rows.
    cells = rows.withColumn("rows", F.lit(1))
    counts = stage(_prefix_counts(cells, [], STEP_DIGITS), "prefixes")
    sizes = counts.groupBy(STRATUM).agg(F.sum("rows").alias("n"))
    quotas = Pinned(quota(sizes))
    open_ = quotas.side.filter((F.col("want") > 0) & (F.col("want") < F.col("n"))).select(
        F.col(STRATUM).alias("_s"), F.col("want").alias("take")
    )
    state = Pinned(_cut(counts.join(open_, counts[STRATUM].eqNullSafe(F.col("_s"))).drop("_s")))
    width = STEP_DIGITS
    while width < HASH_DIGITS and (ties := state.highest("ties")) is not None:
        # What lies under the cuts: a shrinking table, equal hashes counted together.
        under = stage(_under(cells, state, width), "under-cuts")
        width = HASH_DIGITS if ties <= fine_rows else _next_width(under, width, fine_rows)
        state = Pinned(_cut(_prefix_counts(under, ["take"], width)))
        cells = under.drop("take")
    found = state.side.select(F.col(STRATUM).alias("_s"), "cut", "take", "ties")
    whole = F.when(F.col("want") <= 0, F.lit(NONE)).otherwise(F.lit(ALL))
    return Pinned(
        quotas.frame.join(found, F.col(STRATUM).eqNullSafe(F.col("_s")), "left").select(
            STRATUM,
            F.coalesce("cut", whole).alias("cut"),
            F.coalesce("take", F.lit(0)).alias("take"),
            F.coalesce("ties", F.lit(0)).alias("ties"),
        )
    )


def _next_width(under: DataFrame, width: int, fine_rows: int) -> int:
    """Digits to read next: copies agree in many, which are skipped."""
    sizes = under.groupBy(STRATUM).agg(F.count(F.lit(1)).alias("n"), _common(F.min(HASH), F.max(HASH)).alias("same"))
    same = sizes.agg(F.min(F.when(F.col("n") > fine_rows, F.col("same")))).first()[0]
    return HASH_DIGITS if same is None else min(HASH_DIGITS, max(width, same) + STEP_DIGITS)


def _prefix_counts(rows: DataFrame, keep: Sequence[str], width: int) -> DataFrame:
    return rows.groupBy(STRATUM, *keep, F.substring(HASH, 1, width).alias("prefix")).agg(
        F.sum("rows").alias("rows")
    )


def _common(low: Column, high: Column) -> Column:
    """Number of leading digits two hash texts share."""
    differing = F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(low, i, F.lit(1)) != F.substring(high, i, F.lit(1)))
    return F.coalesce(F.array_min(differing) - 1, F.lit(HASH_DIGITS))


def _cut(counts: DataFrame) -> DataFrame:
    """The prefix of each stratum under which the row number ``take`` lies."""
    # At most 16**STEP_DIGITS prefixes, or FINE_ROWS hashes, of one stratum.
    running = Window.partitionBy(STRATUM).orderBy("prefix")
    return (
        counts.withColumn("upto", F.sum("rows").over(running))
        .filter((F.col("upto") >= F.col("take")) & (F.col("upto") - F.col("rows") < F.col("take")))
        .select(
            STRATUM,
            F.col("prefix").alias("cut"),
            (F.col("take") - (F.col("upto") - F.col("rows"))).alias("take"),
            F.col("rows").alias("ties"),
        )
    )


def _under(rows: DataFrame, open_: Pinned, width: int) -> DataFrame:
    """What starts with its stratum's cut: (stratum, hash, take, rows), equal hashes as one row."""
    state = open_.side.select(F.col(STRATUM).alias("_s"), "cut", "take")
    under = rows[STRATUM].eqNullSafe(state["_s"]) & (
        F.substring(rows[HASH], 1, width) == state["cut"]
    )
    return rows.join(state, under).groupBy(STRATUM, HASH, "take").agg(F.sum("rows").alias("rows"))


def mark_first(
    df: DataFrame,
    stratum: Column,
    quota: Quota,
    key: Sequence[str] | None,
    seed: int,
    flag: str,
    copies: bool = False,
    order: str | None = None,
) -> DataFrame:
    """Add the boolean ``flag``: the first ``want`` rows of each stratum by hash.

    ``key`` names columns which identify a row, or with ``copies`` columns which
    agree only in equal rows. Without a key the whole row is hashed. Equal rows
    tie, and any ``take`` of them give the same table. ``order`` names a column
    which already holds a distinct hash text for every row.
    """
    columns = df.columns
    hashing = ref(order) if order else row_hash(seed, key or columns)
    hashed = df.withColumns({STRATUM: stratum, HASH: hashing})
    cuts = find_thresholds(hashed.select(STRATUM, HASH), quota)
    side = cuts.side.select(F.col(STRATUM).alias("_s"), "cut", "take", "ties")
    joined = hashed.join(side, hashed[STRATUM].eqNullSafe(side["_s"]), "left")
    plain = [ref(c) for c in columns]
    split_ties = F.col("take") < F.col("ties")
    if not cuts.any(split_ties):
        return joined.select(*plain, (F.col(HASH) <= F.col("cut")).alias(flag))
    if order or (key and not copies):
        raise ValueError(f"{order or list(key)} does not identify a row: equal keys at the threshold")

    at_cut = split_ties & (F.col(HASH) == F.col("cut"))
    clear = joined.filter(~F.coalesce(at_cut, F.lit(False))).select(
        *plain, (F.col(HASH) <= F.col("cut")).alias(flag)
    )
    return clear.unionByName(_deal_copies(joined.filter(at_cut), columns, flag))


def _deal_copies(tied: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
    """Split equal rows into taken and left copies: count, then write them out again."""
    plain = [ref(c) for c in columns]
    counted = tied.groupBy(*plain, "take").agg(F.count(F.lit(1)).alias("copies"))
    sides = F.array(
        F.struct(F.lit(True).alias("taken"), F.col("take").alias("copies")),
        F.struct(F.lit(False).alias("taken"), (F.col("copies") - F.col("take")).alias("copies")),
    )
    parts = counted.select(*plain, F.explode(sides).alias("side")).filter("side.copies > 0")
    last = (F.col("side.copies") - 1).cast("bigint")
    chunks = parts.select(
        *plain,
        F.col("side.taken").alias(flag),
        F.col("side.copies").alias("_copies"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / COPY_CHUNK))).alias("_chunk"),
    ).repartition("_chunk", flag)
    in_chunk = F.least(
        F.lit(COPY_CHUNK).cast("bigint"), F.col("_copies") - F.col("_chunk") * COPY_CHUNK
    )
    return chunks.select(
        *plain,
        ref(flag),
        F.explode(F.sequence(F.lit(1).cast("bigint"), in_chunk)).alias("_copy"),
    ).drop("_copy")


def take_n(
    df: DataFrame, n: int, key: Sequence[str] | None, seed: int = 42, where: Column | None = None
) -> DataFrame:
    """Exactly ``min(n, size)`` of the rows matching ``where``; all other rows stay."""
    flag = "_taken"
    inside = F.lit(True) if where is None else F.coalesce(where, F.lit(False))

    def quota(sizes: DataFrame) -> DataFrame:
        wanted = F.when(F.col(STRATUM), F.least(F.col("n"), F.lit(n))).otherwise(F.col("n"))
        return sizes.withColumn("want", wanted)

    return mark_first(df, inside, quota, key, seed, flag).filter(F.col(flag)).drop(flag)


def ordinals(
    df: DataFrame, group: str, hash_column: str, out: str, rows_per_bucket: int = FINE_ROWS
) -> DataFrame:
    """Position (from 0) of each row in the hash order of its group.

    Equals ``row_number() over (partition by group order by hash) - 1``; the
    window runs inside hash buckets of bounded size and counted offsets are added.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    digits = 0
    while largest > rows_per_bucket * 16**digits:
        digits += 1
    order = Window.partitionBy(group, "_bucket").orderBy(hash_column)
    bucketed = df.withColumn("_bucket", F.substring(hash_column, 1, digits) if digits else F.lit(""))
    ranked = bucketed.withColumn("_in_bucket", F.row_number().over(order).cast("bigint") - 1)
    if not digits:
        return ranked.withColumnRenamed("_in_bucket", out).drop("_bucket")
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_g", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    )
    side = Pinned(offsets).side
    return (
        ranked.join(side, ranked[group].eqNullSafe(side["_g"]) & (ranked["_bucket"] == side["_b"]))
        .withColumn(out, F.col("_in_bucket") + F.col("_offset"))
        .drop("_g", "_b", "_offset", "_in_bucket", "_bucket")
    )
