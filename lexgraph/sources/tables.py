"""Driver tables and the derived inputs the operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("documents", "embeddings", "benchmark", "pages", "conversations", "labels")


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES:   # per-row text work: use every core even for one input split
        from lexgraph.session import spread
        df = spread(df)
    return df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as corpus files: filename = ``source/doc_id.txt``."""
    d = table(spark, sf_dir, "documents")
    return d.withColumn("filename", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as (id, embedding, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def label_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword vectors: the mean text vector per label (keyword_id = label).

    An ordinary grouped mean: partial sums per partition, one row per label.
    """
    e = text_vectors(spark, sf_dir)
    x = e.select("label", F.posexplode("embedding").alias("d", "x"))
    m = x.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (m.groupBy("label")
            .agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
            .select(F.col("label").alias("keyword_id"),
                    F.concat(F.lit("label_"), F.col("label").cast("string")).alias("keyword"),
                    F.transform("v", lambda s: s["x"]).alias("embedding")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as the question batch (question_id, question), stripped."""
    from lexgraph.functions.text import strip_ws
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), strip_ws("text").alias("question"))
