"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does the same on pure ASCII strings and
    is much faster than ``translate``, so it is used where bytes = characters."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def chunks_of(batches, max_rows: int, size=None, max_size: int = 0):
    """Cut Arrow batches into slices of at most ``max_rows`` rows and, with
    ``size`` (a column name of texts or binaries), about ``max_size`` bytes."""
    import pyarrow.compute as pc
    for b in batches:
        if not b.num_rows:
            continue
        if size is None:
            cuts = list(range(0, b.num_rows, max_rows)) + [b.num_rows]
        else:
            lens = pc.fill_null(pc.binary_length(b.column(size)), 0).to_pylist()
            cuts, n, total = [0], 0, 0
            for i, x in enumerate(lens):
                if n and (n >= max_rows or total + x > max_size):
                    cuts.append(i)
                    n, total = 0, 0
                n += 1
                total += x
            cuts.append(b.num_rows)
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.slice(lo, hi - lo)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared checkpoint folder and
    read it back, so that a lost executor re-reads files instead of recomputing."""
    import uuid

    from lexgraph.session import checkpoint_dir
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
