"""The training-data pipeline: five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All but the last
keep the columns of ``docs``, extra ones included.  NULL texts pass every filter and
end as a lone separator; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgraph.llm import decontaminate, line_dedup, near_dedup, packing, tokens, toxicity
from lexgraph.llm.common import read, stored
from lexgraph.session import ship_package


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts toxic go."""
    ship_package(spark)
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except in the largest document that holds them."""
    ship_package(spark)
    return line_dedup.drop_repeated_lines(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship_package(spark)
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    ship_package(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, mixed by source."""
    ship_package(spark)
    return packing.pack(docs, tokens.vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # a trained network decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
