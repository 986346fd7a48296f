"""Equi-join of many rows with a table of keys where single keys may hold a
large share of the rows (a word like "the", a phrase of a licence).

Keys that hold more than ``share`` of the rows number at most 1 / share, which
bounds what is broadcast; their rows never leave their task.  All other rows
go through a shuffle in which no key holds more than ``share`` of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgraph.session import persist_step

SHARE = 1e-3


def frequent_keys(rows: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """(key): the keys of more than ``share`` of the rows; at most 1 / share."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    counts = persist_step(counts)
    total = counts.agg(F.sum("__c")).first()[0] or 0
    return counts.filter(F.col("__c") > F.lit(share * total)).select(key)


def hot_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """``rows`` left join ``table`` (one row per ``key``).  ``hot``: the frequent
    keys when the caller knows them (at most 1 / share), else they are counted."""
    values = [c for c in table.columns if c != key]
    hot = frequent_keys(rows, key, share) if hot is None else hot
    head = persist_step(table.join(hot, key, "left_semi")).select(F.col(key), *[F.col(c).alias(f"__h_{c}") for c in values], F.lit(True).alias("__hit"))
    met = rows.join(F.broadcast(head), key, "left")  # at most 1 / share rows
    hit = F.col("__hit").isNotNull()
    # rows that are served have no key in the second join and are dealt out evenly
    met = met.withColumn("__k", F.when(~hit, F.col(key))) \
        .withColumn("__s", F.when(hit, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).otherwise(F.lit(0)))
    tail = table.select(F.col(key).alias("__k"), F.lit(0).cast("long").alias("__s"), *[F.col(c).alias(f"__t_{c}") for c in values])
    return met.join(tail, ["__k", "__s"], "left").select(
        *[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(f"__h_{c}", f"__t_{c}").alias(c) for c in values])
