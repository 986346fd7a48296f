"""Clustering and member sampling.

* ``kmeans`` (``operators.kmeans``): ++ seeding, best of ``n_init`` starts, to the fixed point.
* ``assign_clusters``: nearest centre per point (block kernel, k = 1).
* ``sample_members``: ``blocks`` random members per cluster, with replacement
  when the cluster has at most ``blocks`` members, else without; empty
  clusters give no rows.  Randomness is md5-based and seeded.
* ``extract_clusters``: centre members + random members for each algorithm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgraph.functions.rand import draw_index, order_key
from lexgraph.operators.blocks import block_topk
from lexgraph.operators.hotjoin import hot_join
from lexgraph.operators.kmeans import kmeans
from lexgraph.operators.search import nearest_to_center


def assign_clusters(emb: DataFrame, centers: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, dist): nearest centre, ties to the lower cluster number."""
    r = block_topk(emb, centers, 1, metric="l2", largest=False, q_id=id_col, c_id="cluster",
                   q_vec=vec_col, c_vec="center")
    return r.select(F.col("qid").alias("id"), F.col("cid").alias("cluster"), F.col("score").alias("dist"))


def cluster_sizes(assign: DataFrame) -> DataFrame:
    return assign.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def sample_members(assign: DataFrame, blocks: int = 5, seed: int = 0) -> DataFrame:
    """(cluster, rank, id): ``blocks`` draws per non-empty cluster.

    Large clusters (n > blocks) keep their ``blocks`` first members in md5
    order -- a per-cluster top-k that Catalyst limits map-side before the
    shuffle, so a cluster holding a third of all rows never lands whole in one
    task.  Only small clusters (n <= blocks) are ranked in full, to draw with
    replacement.
    """
    sizes = cluster_sizes(assign)
    a = hot_join(assign, sizes, "cluster")
    key = order_key(seed, F.col("id"))
    w = Window.partitionBy("cluster").orderBy(key, F.col("id"))
    big = (a.filter(F.col("n") > blocks).withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= blocks).select("cluster", "rank", "id"))
    small = a.filter(F.col("n") <= blocks).withColumn("pos", F.row_number().over(w) - 1)
    slots = (sizes.filter(F.col("n") <= blocks)
             .select("cluster", "n", F.explode(F.sequence(F.lit(1), F.lit(int(blocks)))).alias("rank"))
             .withColumn("pos", draw_index(seed, ["cluster", "rank"], F.col("n")).cast("int")))
    drawn = slots.join(small.select("cluster", "pos", "id"), ["cluster", "pos"]).select("cluster", "rank", "id")
    return big.unionByName(drawn)


def extract_clusters(emb: DataFrame, k: int = 20, blocks: int = 5, seed: int = 0, n_init: int = 5,
                     algos=("kmeans", "spectral"), spectral_dims: int = 5) -> DataFrame:
    """``cluster_members`` (algo, cluster, kind, rank, id) for each algorithm."""
    out = None
    for algo in algos:
        if algo == "kmeans":
            assign, centers, _ = kmeans(emb, k, n_init=n_init, seed=seed)
            space = emb
        elif algo == "spectral":
            from lexgraph.operators.spectral import spectral_clusters
            assign, centers, space = spectral_clusters(emb, k, extra_dims=spectral_dims, seed=seed)
        else:
            raise ValueError(algo)
        center = nearest_to_center(space, centers, blocks).select("cluster", "rank", "id")
        rand = sample_members(assign, blocks, seed)
        part = (center.withColumn("kind", F.lit("center")).unionByName(rand.withColumn("kind", F.lit("random")))
                .withColumn("algo", F.lit(algo)).select("algo", "cluster", "kind", "rank", "id"))
        out = part if out is None else out.unionByName(part)
    return out
