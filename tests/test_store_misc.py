"""Store artefacts, lines, sorted keywords, truncation, spectral map."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgraph.operators import embed as EM
from lexgraph.sources import store as ST


def test_materialize_reuses(spark, tmpdir_path):
    calls = []

    def fn():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "x")
    a = ST.materialize(spark, tmpdir_path, "thing", {"k": 1}, fn)
    b = ST.materialize(spark, tmpdir_path, "thing", {"k": 1}, fn)
    c = ST.materialize(spark, tmpdir_path, "thing", {"k": 2}, fn)
    assert a.count() == b.count() == c.count() == 5 and len(calls) == 2


def test_lines_and_keywords(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "q.txt")
    with open(p, "w") as f:
        f.write("  first question \nsecond\n")
    r = ST.read_lines(spark, p).orderBy("line_no").collect()
    assert [(x.line_no, x.value) for x in r] == [(0, "first question"), (1, "second")]
    out = os.path.join(tmpdir_path, "kw")
    ST.write_keywords(spark.createDataFrame([("b",), ("a",), ("c",)], "keyword string"), out)
    assert [x.value for x in spark.read.text(out).collect()] == ["a", "b", "c"]
    e = os.path.join(tmpdir_path, "edges")
    ST.save_edges(spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, w double"), e)
    assert spark.read.parquet(e).count() == 1


def test_route_and_markdown(spark, tmpdir_path):
    from lexgraph.sources.corpus import route_files, scan_corpus, to_text
    for name, body in [("a.txt", "Plain."), ("b.md", "## Head\n[link](http://x) **bold**"), ("c.bin", "??")]:
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(body)
    ok, bad = to_text(route_files(scan_corpus(spark, tmpdir_path)))
    texts = {r.filename: r.text for r in ok.collect()}
    assert texts["a.txt"] == "Plain." and texts["b.md"] == "Head\nlink bold"
    assert [r.filename for r in bad.collect()] == ["c.bin"]


def test_max_seq_len_truncates(spark):
    d = spark.createDataFrame([("a", "x y z"), ("b", "x")], "chunk_id string, text string")
    full = {r.id: r.embedding for r in EM.embed_text(d, dim=8).collect()}
    cut = {r.id: r.embedding for r in EM.embed_text(d, dim=8, max_seq_len=1).collect()}
    assert np.allclose(cut["a"], cut["b"]) and not np.allclose(full["a"], full["b"])


def test_spectral_matches_numpy(spark):
    from lexgraph.operators.spectral import spectral_embedding
    rng = np.random.default_rng(0)
    C = rng.normal(size=(3, 5))
    X = np.vstack([c + 0.3 * rng.normal(size=(20, 5)) for c in C]) / 2.0
    e = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, embedding array<double>")
    got = {r.id: r.map for r in spectral_embedding(e, 2, gamma=1.0, tol=1e-6).collect()}
    A = np.exp(-((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(A, 0)
    d = A.sum(1)
    w, V = np.linalg.eigh(A / np.sqrt(d)[:, None] / np.sqrt(d)[None, :])
    ref = V[:, np.argsort(-w)[1:3]] / np.sqrt(d)[:, None]
    for k in range(2):
        ref[:, k] *= np.sign(ref[np.argmax(np.abs(ref[:, k])), k])
    assert np.abs(np.array([got[i] for i in range(len(X))]) - ref).max() < 1e-8


def test_literal_propagation_matches_numpy(spark):
    from lexgraph.operators.kwgraph import propagate_rows
    rng = np.random.default_rng(3)
    n = 24
    W = np.zeros((n, n))
    for i in range(n):
        for j in rng.choice(n, 4, replace=False):
            if i != j:
                W[i, j] = W[j, i] = rng.random()
    e = spark.createDataFrame([(i, j, float(W[i, j])) for i in range(n) for j in range(n) if W[i, j] > 0],
                              "src long, dst long, w double")
    seeds = {0: 1, 5: 0, 9: 1}
    sdf = spark.createDataFrame([(7, k, v) for k, v in seeds.items()], "keyword_id int, id long, seed int")
    got = {r.id: (r.f0, r.f1) for r in propagate_rows(e, sdf, gamma=20.0, iters=3, tol=None, block_rows=10).collect()}
    K = np.exp(-20 * ((W[:, None, :] - W[None, :, :]) ** 2).sum(-1))
    Fm = np.zeros((n, 2))
    for k, v in seeds.items():
        Fm[k, v] = 1
    for _ in range(3):
        Fn = K @ Fm
        s = Fn.sum(1, keepdims=True)
        Fn = np.divide(Fn, s, out=np.zeros_like(Fn), where=s > 0)
        for k, v in seeds.items():
            Fn[k] = 0
            Fn[k, v] = 1
        Fm = Fn
    assert max(abs(got[i][0] - Fm[i, 0]) + abs(got[i][1] - Fm[i, 1]) for i in range(n)) < 1e-9


def test_literal_propagation_reaches_its_tolerance_or_raises(spark):
    from lexgraph.operators.kwgraph import propagate_rows
    rng = np.random.default_rng(5)
    n = 30
    W = np.zeros((n, n))
    for i in range(n):
        for j in rng.choice(n, 3, replace=False):
            if i != j:
                W[i, j] = W[j, i] = 0.1 * rng.random()
    e = spark.createDataFrame([(f"n{i:02}", f"n{j:02}", float(W[i, j])) for i in range(n) for j in range(n) if W[i, j] > 0],
                              "src string, dst string, w double")
    seeds = {i: i // 3 % 2 for i in range(0, n, 3)}
    sdf = spark.createDataFrame([(7, f"n{i:02}", v) for i, v in seeds.items()], "keyword_id int, id string, seed int")
    with pytest.raises(RuntimeError):
        propagate_rows(e, sdf, iters=2, tol=1e-9)
    got = {r.id: r.f1 for r in propagate_rows(e, sdf, tol=1e-3).collect()}
    K = np.exp(-20 * ((W[:, None, :] - W[None, :, :]) ** 2).sum(-1))
    x = np.zeros((n, 2))
    for i, v in seeds.items():
        x[i, v] = 1
    held = x[list(seeds)]
    for _ in range(1000):
        y = K @ x
        y /= y.sum(1, keepdims=True)
        y[list(seeds)] = held
        x, d = y, np.abs(y - x).sum()
        if d < 1e-3:
            break
    live = [i for i in range(n) if W[i].any()]
    assert set(got) == {f"n{i:02}" for i in live} and max(abs(got[f"n{i:02}"] - x[i, 1]) for i in live) < 1e-9
