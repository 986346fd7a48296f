"""Session helpers: configuration that the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every lexgraph job wants.  Arrow batches that carry packed vector
# blocks are bounded by bytes, not only by records, so one batch never holds
# more than a few blocks.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "lexgraph", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the lexgraph defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests pass
    ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, object
    store) and is used as is.  Only a local-mode session without that setting
    (tests, laptops) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative lexgraph jobs")
    path = tempfile.mkdtemp(prefix="lexgraph-ckpt-", dir=os.environ.get("LEXGRAPH_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df, every: int = 1, step: int = 0):
    """Cut the lineage of an iterative state every ``every`` steps with a
    table written to the shared checkpoint folder (never a local checkpoint)."""
    if every and step % every == 0:
        return persist_step(df)
    return df


def spread(df, key: str | None = None, min_partitions: int | None = None):
    """Hash-partition rows on ``key`` (default: the first column, the id in
    the driver tables) when the input has fewer partitions than cores (e.g.
    one small file holding one row group).  Hashing a key avoids the sort a
    deterministic round-robin needs.  On a cluster with many input splits this
    is a no-op, so the corpus is not shuffled there."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target, key or df.columns[0])
    return df


def persist_step(df):
    """Cut lineage at a reused intermediate: write it as a parquet table in the
    shared checkpoint folder and read it back (survives executor loss; one
    computation, unlike an uncached RDD checkpoint which computes twice)."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make ``lexgraph`` importable on the executors' Python workers (the
    kernels and UDFs are pickled by reference): zip the package once per
    SparkContext and ``addPyFile`` it -- what ``--py-files`` does."""
    import zipfile

    import lexgraph
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(lexgraph.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="lexgraph-pkg-"), "lexgraph.zip")
    with zipfile.ZipFile(out, "w") as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
