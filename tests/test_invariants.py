"""Invariants: block kernel = brute force, graph symmetry, store reruns,
streaming ingest, hooks."""

import os

import numpy as np
from pyspark.sql import functions as F

from lexgraph.operators import embed as EM
from lexgraph.operators import kwgraph as H
from lexgraph.operators import search as S
from lexgraph.operators import textgraph as G
from lexgraph.operators.blocks import block_topk


def test_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 8))
    e = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, embedding array<double>")
    got = block_topk(e, e, 4, exclude_self=True, block_rows=37).select("qid", "rank", "cid").collect()
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    S_ = np.round(Xn @ Xn.T, 6)
    np.fill_diagonal(S_, -np.inf)
    want = set()
    for i in range(len(X)):
        order = sorted(range(len(X)), key=lambda j: (-S_[i, j], j))[:4]
        want |= {(i, r + 1, j) for r, j in enumerate(order)}
    assert {tuple(r) for r in got} == want


def test_graph_symmetric_and_bounded(spark, sf):
    from lexgraph.sources.tables import text_vectors
    g = G.text_graph(text_vectors(spark, sf), k=5)
    rows = {(r.src, r.dst): r.w for r in g.collect()}
    assert all(abs(rows[(b, a)] - w) < 1e-12 for (a, b), w in rows.items())
    assert all(0.0 <= w <= 1.0 for w in rows.values())


def test_keyword_graph_symmetric(spark):
    rng = np.random.default_rng(1)
    lab = [(int(k), int(i), 1) for k in range(6) for i in rng.choice(40, 12, replace=False)]
    df = spark.createDataFrame(lab, "keyword_id int, id long, label int")
    w = {(r.kw_a, r.kw_b): r.w for r in H.keyword_graph(df).collect()}
    sets = {}
    for k, i, _ in lab:
        sets.setdefault(k, set()).add(i)
    for (a, b), c in w.items():
        assert a != b and w[(b, a)] == c == len(sets[a] & sets[b])


def test_check_dim_fails(spark):
    import pytest
    e = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    with pytest.raises(Exception):
        EM.check_dim(e, 3).collect()
    assert EM.check_dim(e, 2).count() == 1


def test_store_rerun_appends_nothing(spark, tmpdir_path):
    from lexgraph.operators.chunk import chunk_documents
    from lexgraph.sources import store as ST
    d = spark.createDataFrame([(1, "A b. C d.", "f.txt")], "doc_id long, text string, filename string")
    c = chunk_documents(d, length=250)
    root = os.path.join(tmpdir_path, "store")
    assert ST.write_chunks(c, root, "t").count() == 1
    assert ST.write_chunks(c, root, "t").count() == 0
    assert ST.count_chunks(spark, root).first().n == 1
    assert ST.open_store(spark, root, "other").count() == 0


def test_streaming_ingest_twice(spark, tmpdir_path):
    from lexgraph.sources import store as ST
    from lexgraph.streaming.ingest import ingest_available
    src = os.path.join(tmpdir_path, "corpus")
    os.makedirs(src)
    for i in range(3):
        with open(os.path.join(src, f"d{i}.txt"), "w") as f:
            f.write(f"Doc {i} says hello. It has two sentences.")
    with open(os.path.join(src, "notes.md"), "w") as f:
        f.write("# Title\nSome *marked* text.")
    root, ck = os.path.join(tmpdir_path, "store"), os.path.join(tmpdir_path, "ck")
    ingest_available(spark, src, root, "t", ck, embed=True, dim=16)
    n1 = ST.open_store(spark, root, "t").count()
    e1 = ST.open_store(spark, root, "t", "embeddings").count()
    assert n1 == 4 and e1 == 4
    ingest_available(spark, src, root, "t", ck, embed=True, dim=16)
    assert ST.open_store(spark, root, "t").count() == n1
    with open(os.path.join(src, "d9.txt"), "w") as f:
        f.write("A new file. Only this is new.")
    ingest_available(spark, src, root, "t", ck, embed=True, dim=16)
    assert ST.open_store(spark, root, "t").count() == n1 + 1
    assert ST.open_store(spark, root, "t", "embeddings").count() == e1 + 1
    md = ST.open_store(spark, root, "t").filter(F.col("filename") == "notes.md").first()
    assert "*" not in md.text and "#" not in md.text


def test_hooks(spark):
    import pandas as pd
    d = spark.createDataFrame([("a", "x y"), ("b", "z")], "chunk_id string, text string")
    e = EM.embed_text(d, dim=2, embedder=lambda s: [[float(len(t)), 1.0] for t in s])
    assert {r.id: r.embedding for r in e.collect()} == {"a": [3.0, 1.0], "b": [1.0, 1.0]}
    from lexgraph.operators.keywords import complete
    p = spark.createDataFrame([("s1", "prompt")], "set_id string, prompt string")
    assert complete(p, lambda s: pd.Series(["k1,k2"] * len(s))).first().answer == "k1,k2"


def test_kmeans_and_extract(spark, sf):
    from lexgraph.operators import cluster as CL
    from lexgraph.sources.tables import text_vectors
    m = CL.extract_clusters(text_vectors(spark, sf), k=4, blocks=3, seed=1, n_init=2, algos=("kmeans",)).collect()
    kinds = {(r.cluster, r.kind) for r in m}
    assert len(kinds) == 8
    assert all(sum(1 for r in m if (r.cluster, r.kind) == ck) == 3 for ck in kinds)


def test_keyword_graph_column_block_path(spark):
    rng = np.random.default_rng(2)
    lab = [(int(k), int(i), 1) for k in range(9) for i in rng.choice(30, 10, replace=False)]
    df = spark.createDataFrame(lab, "keyword_id int, id long, label int")
    dense = sorted(tuple(r) for r in H.keyword_graph(df).collect())
    blocked = sorted(tuple(r) for r in H.keyword_graph(df, {"dense_max": 2, "col_block": 4, "block": 7}).collect())
    assert dense == blocked and len(dense) > 0
