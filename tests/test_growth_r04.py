"""What made queries of round 4 fail at size: shown on small inputs."""

import numpy as np

from lexgraph.operators import hops
from lexgraph.operators import textgraph as G


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")


def jobs_of(spark, group, work):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = work()
    finally:
        sc.setJobGroup("", "")
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


# ------------------------------------------------------------------ F1, F4: diameter
def hops_of(n, pairs):
    near = [set() for _ in range(n)]
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = np.full((n, n), -1)
    for s in range(n):
        front, step = {s}, 0
        while front:
            out[s, list(front)] = step
            front, step = {b for a in front for b in near[a] if out[s, b] < 0}, step + 1
    return out


def test_diameter_takes_no_job_per_hop(spark):
    row, jobs = jobs_of(spark, "diameter-path", lambda: G.diameter(edges(spark, [(i, i + 1) for i in range(150)])).first())
    assert (row.n_nodes, row.n_components, row.diameter) == (151, 1, 150)
    assert jobs < 60          # a search over tables takes some jobs for each of 150 hops


def test_searches_in_a_task():
    rng = np.random.default_rng(1)
    n = 300
    pairs = [(i, (i + 1) % n) for i in range(n)] + [(0, i) for i in range(100, 200)] + [(int(a), int(b)) for a, b in rng.integers(0, n, (40, 2)) if a != b]
    pairs = sorted({(min(p), max(p)) for p in pairs})
    s, t = (np.array(x, np.int32) for x in zip(*pairs))
    g = hops._Graph([(0, (s[:50].tobytes(), t[:50].tobytes())), (1, (s[50:].tobytes(), t[50:].tobytes()))], n)
    d = hops_of(n, pairs)
    assert sorted(g.farthest(np.arange(n, dtype=np.int32)).tolist()) == sorted(d.max(axis=1).tolist())
    assert g.wide()[1] >= 1                      # a node with more neighbours than are met at once
    top = int(np.argmax((d == 1).sum(axis=1)))
    assert sorted(g.reach(np.zeros(1, np.int32), np.zeros(1, np.int32)).tolist()) == sorted(d[top].tolist())
    assert g.components() == 1


def test_diameter_in_tasks_and_over_tables(spark, monkeypatch):
    ring = [(i, (i + 1) % 9) for i in range(9)] + [(4, 20), (20, 21), (21, 21)]
    row = G.diameter(edges(spark, ring), at_once=2).first()
    assert (row.n_nodes, row.n_components, row.diameter) == (11, 1, 6)
    row = G.diameter(edges(spark, [*ring, (30, 31), (31, 32), (40, 41)])).first()
    assert (row.n_nodes, row.n_components, row.diameter) == (16, 3, None)
    monkeypatch.setattr(hops, "NODES", 0)
    assert G.diameter(edges(spark, [(0, 1), (1, 2), (1, 3)])).first().diameter == 2


# ------------------------------------------------------------------ F15: answer_report
def broadcast_bytes(df):
    """Of a frame that has run: the data size of each of its broadcasts."""
    out, plans = [], [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        else:
            if kind == "BroadcastExchangeExec":
                out.append(p.metrics().apply("dataSize").value())
            plans += [p.children().apply(i) for i in range(p.children().size())]
    return out


def test_a_single_block_is_sent_once(spark):
    from lexgraph.operators.blocks import block_topk
    rng = np.random.default_rng(5)
    X, Q = rng.normal(size=(600, 8)), rng.normal(size=(40, 8))
    corpus, queries = (spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>") for m in (X, Q))
    for left, right, k, one in ((queries, corpus, 3, 40), (corpus, queries, 2, 40)):     # either side of one block, the other of 15
        found = block_topk(left, right, k, metric="dot", block_rows=40)
        rows = found.collect()
        assert max(broadcast_bytes(found)) < 3 * one * 8 * 8
        a, b = (Q, X) if left is queries else (X, Q)
        best = np.argsort(-(a @ b.T), axis=1)[:, :k]
        assert {(r["qid"], r["rank"]): r["cid"] for r in rows} == {(i, j + 1): c for i, row in enumerate(best.tolist()) for j, c in enumerate(row)}


# ------------------------------------------------------------------ F3: knn_descent
def test_places_of_lists_are_not_broadcast(spark, monkeypatch):
    from lexgraph.operators import descent as D
    plans, write = [], D.persist_step
    monkeypatch.setattr(D, "persist_step", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    rng = np.random.default_rng(2)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(80, 4)))], "id long, embedding array<float>")
    assert D.knn_descent(e, 3).count() == 240
    assert len(plans) >= 3 and "Broadcast" not in plans[1]       # the first lists: a row per place


# ------------------------------------------------------------------ F8, F9: kmeans
def test_a_pass_of_kmeans_is_one_job_of_one_stage(spark, monkeypatch):
    from lexgraph.operators import kmeans as KM
    rng = np.random.default_rng(8)
    X = rng.normal(size=(400, 3)).round(2)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(KM, "NEAR_POINTS", 0)          # passes over all points alone
    passes, real = [], KM._pass
    monkeypatch.setattr(KM, "_pass", lambda starts: passes.append(1) or real(starts))
    (assign, centers, cost), jobs = jobs_of(spark, "kmeans-passes", lambda: KM.kmeans(e, 4, n_init=2, seed=3))
    assert len(passes) > 5 and jobs <= len(passes) + 4 + 2 + 12        # passes, seeds, costs and what packs the rows
    X = X.astype(np.float32).astype(float)
    C = np.array([r["center"] for r in centers.orderBy("cluster").collect()])
    got = {r["id"]: r["cluster"] for r in assign.collect()}
    c = ((X[:, None] - C[None]) ** 2).sum(-1).argmin(1)
    assert got == dict(enumerate(c.tolist()))
    assert all(np.allclose(X[c == j].mean(0), C[j], atol=1e-9) for j in range(4))
    assert abs(cost - ((X - C[c]) ** 2).sum()) < 1e-9 * cost
