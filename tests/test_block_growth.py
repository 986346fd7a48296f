"""What the pairwise work moves grows with the rows; tiles give what whole blocks gave."""

import numpy as np

from lexgraph.operators import blocks
from lexgraph.operators.blocks import _blocks_for, block_topk


def frame(spark, X, names):
    return spark.createDataFrame([(n, [float(v) for v in x]) for n, x in zip(names, X)], "id string, embedding array<double>")


def test_blocks_of_a_side_do_not_grow_with_the_rows():
    assert _blocks_for(10_000, 2048, 64, 16) == 5
    assert _blocks_for(100_000, 2048, 64, 16) == _blocks_for(600_000, 2048, 64, 16) == 16
    assert _blocks_for(10_000_000, 2048, 64, 16) == -(-10_000_000 // (blocks.BLOCK_VALUES // 64))   # bounded memory first


def test_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(size=(2300, 3)), 1)          # more than a tile, with ties
    names = [f"n{i:04d}" for i in range(len(X))]
    e = frame(spark, X, names)
    got = {(r["qid"], r["rank"]): r["cid"] for r in block_topk(e, e, 3, metric="l2", largest=False, exclude_self=True, block_rows=4000).collect()}
    D = np.round(np.sqrt(((X[:40, None] - X[None]) ** 2).sum(-1)), 9)
    D[np.arange(40), np.arange(40)] = np.inf
    for i in range(40):
        want = np.lexsort((np.arange(len(X)), D[i]))[:3]
        assert [got[names[i], r] for r in (1, 2, 3)] == [names[j] for j in want]


def test_half_of_the_affinity_gives_all_products(spark):
    from lexgraph.operators.spectral import affinity
    rng = np.random.default_rng(6)
    X, Z = rng.normal(size=(90, 4)), rng.normal(size=(90, 2))
    names = [f"n{i}" for i in range(90)]
    rows, aff = affinity(frame(spark, X, names), 0.5, block_rows=30)
    z = spark.createDataFrame([(n, [float(v) for v in r]) for n, r in zip(names, Z)], "id string, z array<double>")
    got = {r["id"]: r["y"] for r in aff.times(z, 2).collect()}
    A = np.exp(-0.5 * ((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(A, 0)
    assert aff.nb == 3 and np.allclose([got[n] for n in names], A @ Z, atol=1e-12)


def test_node_tables_are_not_broadcast(spark, monkeypatch):
    from lexgraph.operators import textgraph as G
    plans, write = [], G.persist_step
    monkeypatch.setattr(G, "persist_step", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    e = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    assert G.components(e).filter("component = 0").count() == 5
    assert plans and not any("BroadcastHashJoin" in p for p in plans)


def test_near_pairs_moves_no_keys(spark, monkeypatch):
    from lexgraph.operators import keywords as KW
    kinds, write = [], KW.persist_step
    monkeypatch.setattr(KW, "persist_step", lambda df: kinds.append(dict(df.dtypes)) or write(df))
    sets = spark.createDataFrame([("a b c", ["a", "b", "c"]), ("a b c d", ["a", "b", "c", "d"]), ("x y", ["x", "y"])], "k string, t array<string>")
    assert [tuple(r) for r in KW.near_pairs(sets).collect()] == [("a b c", "a b c d")]
    assert any("h" in k for k in kinds) and all("k" not in k and k["t"] == "array<bigint>" for k in kinds if "h" in k)
