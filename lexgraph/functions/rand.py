"""Deterministic pseudo-randomness from md5, reproducible in any SQL engine.

* ``order_key(seed, id)``: a shuffle order; sort by it ascending.
* ``draw_index(seed, *parts, n)``: an integer in [0, n) for a with-replacement draw.
* ``hash_bucket(col, n)``: the bucket of a token in the hashed embedding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _hex8(s: Column) -> Column:
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def order_key(seed, id_col) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), _c(id_col).cast("string")))


def draw_index(seed, parts: list, n) -> Column:
    s = F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts])
    return F.pmod(_hex8(s), _c(n).cast("long"))


def hash_bucket(col, n: int) -> Column:
    return F.pmod(_hex8(_c(col)), F.lit(int(n))).cast("int")
