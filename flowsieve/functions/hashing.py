"""Hash keys and hash draws: the same on every engine and every partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.columns import ref

# 15 hexadecimal digits fit a signed 64-bit integer.
DRAW_DIGITS = 15
DRAW_RANGE = float(16**DRAW_DIGITS)


def row_hash(seed: int, key: Sequence[str]) -> Column:
    """32 hexadecimal digits which order the rows of a table at random."""
    cells = [F.coalesce(ref(k).cast("string"), F.lit("\u0000")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cells))


def draw(*parts: Column) -> Column:
    """Uniform integer in [0, 16**15) fixed by its parts."""
    text = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(text, 1, DRAW_DIGITS), 16, 10).cast("bigint")
