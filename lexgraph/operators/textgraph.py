"""Weighted kNN text graph and its metrics.

tau_i = sqrt(angle to the K-th neighbour); w_ij = exp(-angle_ij^2 / (tau_i tau_j));
the graph is symmetrised as (W + W^T) / 2 with absent entries 0.  Guard for K
identical vectors (tau = 0): angle 0 (at 6 digits) gives w = 1; angle > 0
with tau_i tau_j = 0 gives w = 0.
"""

from __future__ import annotations

import itertools
import logging
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgraph.operators import hops
from lexgraph.operators.search import knn_graph
from lexgraph.session import persist_step

log = logging.getLogger(__name__)

MOST_AT_ONCE = 1 << 16   # searches of a round
DEALT = "shuffle_hash"   # tables of a row per node are dealt out: by a broadcast each step would send one through the driver


def local_scale(knn: DataFrame, k: int) -> DataFrame:
    """(id, tau) from the K-th neighbour of each text."""
    return knn.filter(F.col("rank") == F.lit(int(k))).select(F.col("src").alias("id"), F.sqrt("angle").alias("tau"))


def edge_weights(knn: DataFrame, k: int) -> DataFrame:
    """Directed weighted edges (src, dst, w).

    tau_i comes from a window over ``src`` (the kNN output is already
    partitioned by ``src``, so it adds no shuffle); tau_j needs one equi-join
    on ``dst``.
    """
    ti = F.max(F.when(F.col("rank") == F.lit(int(k)), F.sqrt("angle"))).over(Window.partitionBy("src"))
    e = knn.withColumn("tau_i", ti)
    tau = local_scale(knn, k).select(F.col("id").alias("dst"), F.col("tau").alias("tau_j"))
    e = e.join(tau, "dst", "left")
    den = F.col("tau_i") * F.col("tau_j")
    w = (F.when(F.round("angle", 6) == 0, F.lit(1.0))
         .when(F.coalesce(den, F.lit(0.0)) == 0, F.lit(0.0))
         .otherwise(F.exp(-(F.col("angle") * F.col("angle")) / den)))
    return e.select("src", "dst", w.alias("w"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """(W + W^T) / 2 as an edge list holding both directions."""
    both = edges.select("src", "dst", "w").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") / 2.0).alias("w"))


def text_graph(emb: DataFrame, k: int = 5, metrics: bool = False, **kw):
    """Whole job: kNN -> weights -> symmetric (src, dst, w); with ``metrics`` also
    one row (n_nodes, n_edges, avg_degree, n_components, diameter)."""
    # the neighbours are read twice (both ends' scales): written once, so the kernel runs once
    edges = symmetrize(edge_weights(persist_step(knn_graph(emb, k=k, **kw)), k))
    if not metrics:
        return edges
    edges = persist_step(edges)
    return edges, avg_degree(edges).join(diameter(edges), "n_nodes")


def avg_degree(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, avg_degree) of the undirected graph (edges stored
    in both directions, self loops not counted)."""
    e = edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return deg.agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("d") / 2).cast("long").alias("n_edges"),
                   F.avg("d").alias("avg_degree"))


def _undirected(edges: DataFrame) -> DataFrame:
    e = edges.filter(F.col("src") != F.col("dst")).select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component), component = least id, to the fixed point: each round
    hooks every node to the least label around it and then follows labels of
    labels, so the rounds grow with the logarithm of a path's length."""
    e = persist_step(_undirected(edges))
    lab = persist_step(e.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")))
    while True:
        msg = e.join(lab.withColumnRenamed("id", "src").hint(DEALT), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        hooked = lab.join(msg.hint(DEALT), "id", "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("c1"))
        # the label of a node learns of the least label that any of its members met
        roots = hooked.groupBy(F.col("c").alias("r")).agg(F.min("c1").alias("best"))
        jump = hooked.join(roots.select(F.col("r").alias("c1"), F.col("best").alias("far")).hint(DEALT), "c1", "left")
        new = persist_step(jump.select("id", "c", F.least("c1", F.coalesce("far", "c1")).alias("c1")))
        if new.filter(F.col("c") != F.col("c1")).isEmpty():
            return lab.withColumnRenamed("c", "component")
        lab = new.select("id", F.col("c1").alias("c"))


def _distances(e: DataFrame, nodes: DataFrame, groups: list[list]) -> DataFrame:
    """(id, d0, d1, ...): hops from the nearest node of each of the few ``groups``, NULL
    where there is no path.  A step joins the nodes that were reached in the last
    one with their edges and takes a minimum per node."""
    ds = [f"d{i}" for i in range(len(groups))]
    state = nodes.select("id", *[F.when(F.col("id").isin(g), 0).alias(d) for d, g in zip(ds, groups, strict=True)])
    for step in itertools.count():
        reached = [F.when(F.col(d) == step, step + 1).alias(d) for d in ds]
        front = state.filter(reduce(or_, [F.col(d).eqNullSafe(step) for d in ds])).select(F.col("id").alias("src"), *reached)
        met = e.join(front.hint(DEALT), "src").groupBy(F.col("dst").alias("id")).agg(*[F.min(d).alias(f"n_{d}") for d in ds])
        state = persist_step(state.join(met.hint(DEALT), "id", "left").select("id", *[F.coalesce(d, f"n_{d}").alias(d) for d in ds]))
        if state.filter(reduce(or_, [F.col(d).eqNullSafe(step + 1) for d in ds])).isEmpty():
            return state


def _eccentricities(e: DataFrame, nodes: DataFrame, sources: list, words: int) -> list[int]:
    """Of each of at most ``64 * words`` sources: hops to its farthest node.  Each node
    keeps a bit per source; a step ORs what changed into the neighbours, and the bits
    that are new anywhere tell whose search goes on."""
    spark, ms = e.sparkSession, [f"m{i}" for i in range(words)]
    kind = nodes.schema["id"].dataType.simpleString()
    slots = spark.createDataFrame([(s, k // 64, k % 64) for k, s in enumerate(sources)], f"id {kind}, word int, bit int")
    zero = F.lit(0).cast("long")
    own = [F.coalesce(F.when(F.col("word") == i, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))), zero) for i in range(words)]
    state = nodes.join(F.broadcast(slots), "id", "left").select("id", *[x.alias(m) for m, x in zip(ms, own, strict=True)], *[x.alias(f"new_{m}") for m, x in zip(ms, own, strict=True)])
    ecc = [0] * len(sources)
    for step in itertools.count(1):
        some = reduce(or_, [F.col(f"new_{m}") != 0 for m in ms])
        front = state.filter(some).select(F.col("id").alias("src"), *[F.col(f"new_{m}").alias(m) for m in ms])
        met = e.join(front.hint(DEALT), "src").groupBy(F.col("dst").alias("id")).agg(*[F.bit_or(m).alias(f"in_{m}") for m in ms])
        fresh = [F.coalesce(f"in_{m}", zero).bitwiseAND(F.bitwise_not(m)) for m in ms]
        state = persist_step(state.join(met.hint(DEALT), "id", "left").select("id", *[F.col(m).bitwiseOR(x).alias(m) for m, x in zip(ms, fresh, strict=True)],
                                                                  *[x.alias(f"new_{m}") for m, x in zip(ms, fresh, strict=True)]))
        seen = state.agg(*[F.bit_or(f"new_{m}") for m in ms]).first()
        for k in range(len(sources)):
            if seen[k // 64] >> (k % 64) & 1:
                ecc[k] = step
        if not any(seen):
            return ecc


def _held_diameter(e: DataFrame, n: int, exact: bool, at_once: int) -> tuple[int, int | None]:
    """(components, diameter) of a graph that each task can hold: the bounds of ``diameter``, each
    source with its own eccentricity.  The searches of a round double, up to ``MOST_AT_ONCE``;
    the driver has a number per node, at most ``hops.NODES``."""
    graph = hops.Hops(e, n)
    try:
        d = graph.reach(np.zeros(1, np.int32), np.zeros(1, np.int32))    # from a node of most neighbours
        if (d == hops.UNMET).any():
            return graph.components(), None
        best = int(d.max())
        if not exact:
            return 1, int(graph.reach(np.array([int(d.argmax())], np.int32), np.zeros(1, np.int32)).max())
        hi = d + best
        while True:
            sources = np.flatnonzero(hi > best)[:at_once].astype(np.int32)    # of most neighbours first
            if not len(sources):
                return 1, best
            ecc = graph.farthest(sources)
            best = max(best, int(ecc.max()))
            log.info("diameter: at least %d after %d more searches", best, len(sources))
            hi = np.minimum(hi, graph.reach(sources, ecc))
            at_once = max(at_once, min(2 * at_once, MOST_AT_ONCE))
    finally:
        graph.close()


def diameter(edges: DataFrame, exact: bool = True, at_once: int = 512) -> DataFrame:
    """(n_nodes, n_components, diameter) in hops; diameter NULL when the graph
    is not connected.

    Exact, by bounds: a node w that is d hops from a node of eccentricity x has an
    eccentricity between max(d, x - d) and x + d.  Only nodes whose upper bound
    is above the largest eccentricity found can still enlarge the diameter.  Up to
    ``at_once`` of these, those of most neighbours first, are searched from together
    (a bit each); then one search from the sources of the least eccentricity lowers the
    bounds around them.  It ends when no node is left: a set of central nodes
    that has everybody nearby is enough, not all nodes.

    A graph that a task can hold (``hops.EDGES``, ``hops.NODES``) is searched in the tasks
    instead, and the searches of a round are many more.

    ``exact=False`` is the double-sweep lower bound: from the node of the highest
    degree, then from the farthest node.
    """
    spark = edges.sparkSession
    e = persist_step(_undirected(edges))
    nodes = persist_step(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")))
    n_nodes = nodes.count()
    schema = "n_nodes long, n_components long, diameter int"
    if n_nodes == 0:
        return spark.createDataFrame([(0, 0, None)], schema)
    if n_nodes <= hops.NODES and e.count() <= 2 * hops.EDGES:
        return spark.createDataFrame([(n_nodes, *_held_diameter(e, n_nodes, exact, at_once))], schema)
    centre = nodes.orderBy(F.desc("deg"), "id").first()["id"]
    dist = _distances(e, nodes, [[centre]])
    if not dist.filter(F.col("d0").isNull()).isEmpty():
        n_comp = components(e).agg(F.countDistinct("component")).first()[0]
        return spark.createDataFrame([(n_nodes, int(n_comp), None)], schema)
    best, far = dist.agg(F.max("d0"), F.max_by("id", F.struct("d0", "id"))).first()
    if not exact:
        best = _distances(e, nodes, [[far]]).agg(F.max("d0")).first()[0]
        return spark.createDataFrame([(n_nodes, 1, best)], schema)
    bounds = persist_step(nodes.join(dist.hint(DEALT), "id").select("id", "deg", (F.col("d0") + best).alias("hi")))
    words = -(-at_once // 64)
    while True:
        left = bounds.filter(F.col("hi") > best)
        sources = [r["id"] for r in left.orderBy(F.desc("deg"), F.xxhash64("id"), "id").limit(at_once).collect()]
        if not sources:
            return spark.createDataFrame([(n_nodes, 1, best)], schema)
        ecc = _eccentricities(e, nodes, sources, words)
        best = max(best, *ecc)
        least = min(ecc)
        log.info("diameter: at least %d after %d more searches", best, len(sources))
        known = spark.createDataFrame(list(zip(sources, ecc, strict=True)), f"id {nodes.schema['id'].dataType.simpleString()}, ecc int")
        near = _distances(e, nodes, [[s for s, x in zip(sources, ecc, strict=True) if x == least]])
        bounds = persist_step(bounds.join(near.hint(DEALT), "id").join(F.broadcast(known), "id", "left")
                              .select("id", "deg", F.least("hi", F.col("d0") + least, "ecc").alias("hi")))
