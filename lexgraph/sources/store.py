"""The parquet store: chunks, embeddings and the vocabulary per tag, plus
named artefacts.  Paths live in a shared folder (HDFS / object store on a
cluster); nothing is kept on the driver.

Several tables are written as one step: an *epoch*.  Rows of an epoch go to
folders of their own (``<kind>/tag=../epoch=..``), and the epoch counts from the
moment its one-row manifest is there, which is written last.  Readers take the
epochs that have a manifest, so a job that stops between two writes leaves
nothing that is seen, and its rerun writes the same folders again.  One writer
per tag at a time.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "chunks": "chunk_id string, doc_id long, chunk_no int, text string, filename string, page int, n_words int",
    "embeddings": "id string, embedding array<double>, vocab_epoch long",
    "vocab": "token string, df long",
    "counted": "chunk_id string",
    "quarantine": "path string, filename string, file_type string",
}
EPOCHS = "tag string, epoch long, kinds array<string>, replaced array<string>, source string, batch long"


def _path(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{kind}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def epochs(spark: SparkSession, root: str, tag: str) -> DataFrame:
    """The epochs of a tag that count (one row each)."""
    path = _path(root, "_epochs")
    if not _exists(spark, path):
        return spark.createDataFrame([], EPOCHS)
    return spark.read.schema(EPOCHS).option("recursiveFileLookup", "true").parquet(path).filter(F.col("tag") == tag)


class Epoch:
    """Rows of several kinds that come to count together.

    ``source`` and ``batch`` name what is being written: a batch that has an epoch
    already is ``done`` and must not be written again."""

    def __init__(self, spark: SparkSession, root: str, tag: str, source: str | None = None, batch: int | None = None):
        known = epochs(spark, root, tag)
        self.spark, self.root, self.tag, self.source, self.batch = spark, root, tag, source, batch
        self.number = (known.agg(F.max("epoch")).first()[0] or 0) + 1
        self.done = batch is not None and not known.filter((F.col("source") == source) & (F.col("batch") == batch)).isEmpty()
        self.kinds, self.replaced = [], []

    def write(self, df: DataFrame, kind: str, replace: bool = False) -> None:
        """Rows of one kind; with ``replace`` they take the place of all earlier ones."""
        cols = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
        df.select(*cols).write.mode("overwrite").parquet(f"{_path(self.root, kind)}/tag={self.tag}/epoch={self.number}")
        self.kinds.append(kind)
        if replace:
            self.replaced.append(kind)

    def commit(self) -> None:
        row = [(self.tag, self.number, self.kinds, self.replaced, self.source, self.batch)]
        self.spark.createDataFrame(row, EPOCHS).coalesce(1).write.mode("overwrite").parquet(f"{_path(self.root, '_epochs')}/{self.tag}/{self.number}")


def open_store(spark: SparkSession, root: str, tag: str, kind: str = "chunks") -> DataFrame:
    """Rows of one tag; an empty frame with the schema when absent (A6)."""
    own = epochs(spark, root, tag).filter(F.array_contains("kinds", kind))
    first = own.filter(F.array_contains("replaced", kind)).agg(F.max("epoch")).first()[0] or 0
    numbers = [r["epoch"] for r in own.filter(F.col("epoch") >= first).select("epoch").collect()]  # one number per epoch
    cols = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
    if not numbers:
        return spark.createDataFrame([], SCHEMAS[kind] + ", tag string").select(*cols, "tag")
    table = spark.read.schema(SCHEMAS[kind] + ", tag string, epoch long").parquet(_path(root, kind))
    return table.filter((F.col("tag") == tag) & F.col("epoch").isin(numbers)).select(*cols, "tag")


def vocabulary(spark: SparkSession, root: str, tag: str) -> DataFrame:
    """(token, df): the stored document frequencies, summed over the epochs."""
    return open_store(spark, root, tag, "vocab").groupBy("token").agg(F.sum("df").alias("df"))


def save_store(df: DataFrame, root: str, tag: str, kind: str = "chunks", mode: str = "append") -> None:
    """Write rows of one kind as an epoch of its own (A7)."""
    e = Epoch(df.sparkSession, root, tag)
    e.write(df if "vocab_epoch" in df.columns or kind != "embeddings" else df.withColumn("vocab_epoch", F.lit(None).cast("long")), kind, mode == "overwrite")
    e.commit()


def new_chunks(chunks: DataFrame, root: str, tag: str) -> DataFrame:
    """The chunks, one per chunk_id, that the store does not hold (written: it must not see its own output)."""
    from lexgraph.session import persist_step
    have = open_store(chunks.sparkSession, root, tag, "chunks").select("chunk_id")
    return persist_step(chunks.dropDuplicates(["chunk_id"]).join(have, "chunk_id", "left_anti"))


def write_chunks(chunks: DataFrame, root: str, tag: str) -> DataFrame:
    """Upsert by chunk_id: only chunks not yet stored are appended (A5).
    Returns the appended rows (a rerun appends none)."""
    new = new_chunks(chunks, root, tag)
    save_store(new, root, tag, "chunks")
    return new


def count_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(tag, n) (A8)."""
    path = _path(root, "_epochs")
    if not _exists(spark, path):
        return spark.createDataFrame([], "tag string, n long")
    tags = spark.read.schema(EPOCHS).option("recursiveFileLookup", "true").parquet(path).select("tag").distinct().collect()
    parts = [open_store(spark, root, r["tag"], "chunks").select("tag") for r in tags]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def get_by_ids(chunks: DataFrame, ids: DataFrame, id_col: str = "chunk_id", keep_rank: bool = False) -> DataFrame:
    """Chunks for an id list (A10): a semi join, or a join keeping the list's
    columns (e.g. rank) when ``keep_rank``."""
    if keep_rank:
        return ids.join(chunks, id_col)
    return chunks.join(ids.select(id_col), id_col, "left_semi")


def param_hash(params: dict) -> str:
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:12]


def listing(spark: SparkSession, paths: list[str]) -> dict:
    """Number and fingerprint of the files under ``paths``: their names, sizes and
    times.  File contents are not read, and the sum does not depend on the order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    n, total = files.agg(F.count(F.lit(1)), F.sum(mark)).first()
    return {"files": n, "fingerprint": str(total)}


def materialize(spark: SparkSession, root: str, name: str, params: dict, fn, inputs: list[str] | None = None) -> DataFrame:
    """Read the artefact if it was written with the same parameters and, with
    ``inputs`` (paths), from the same files, else compute it with ``fn()`` and write
    it (A11).  Writing also cuts the lineage."""
    key = {**params, "__inputs": listing(spark, inputs)} if inputs else params
    path = f"{root.rstrip('/')}/artefacts/{name}/{param_hash(key)}"
    if not _exists(spark, path + "/_SUCCESS"):
        fn().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_edges(df: DataFrame, path: str) -> None:
    """Edge or member table to parquet (A12)."""
    df.write.mode("overwrite").parquet(path)


def read_lines(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """(line_no, value) of a text file, line_no from 0 in file order (A13), numbered
    by partitions and their counts, without a sort and without Python rows."""
    from lexgraph.functions.text import strip_ws
    from lexgraph.operators.numbering import number_nodes
    rows = number_nodes(spark.read.text(path).select(F.col("value").alias("id")))
    return rows.select(F.col("ix").alias("line_no"), (strip_ws("id") if strip else F.col("id")).alias("value"))


def write_keywords(kw: DataFrame, path: str) -> None:
    """Keywords one per line, sorted (A14); the global sort is range-partitioned,
    part files are in order."""
    kw.select("keyword").orderBy("keyword").write.mode("overwrite").text(path)
