"""Steps whose work was larger than their result: what they move, and that results are whole."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexgraph.operators import keywords as KW


def brute_counts(asked, texts, longest):
    held = Counter()
    for t in texts:
        w = t.split()
        held.update({" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)})
    return {p: held[p] for p in asked if held[p]}


def test_phrase_counts_are_those_of_all_runs(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12))) for _ in range(200)] + ["a a a a", "", "a b"]
    asked = ["a", "a a", "a a a", "b c", "c d e", "z", "a z", "h g f"]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "chunk_id int, text string")
    for cut in (7, 1 << 19):     # also in many slices
        monkeypatch.setattr(KW, "SLICE", cut)
        got = KW.phrase_counts(spark.createDataFrame([(p,) for p in asked * 2], "phrase string"), chunks, 3)
        assert {r.phrase: r.df for r in got.collect()} == brute_counts(asked, texts, 3)


def test_runs_that_are_no_phrase_stay_in_their_task():
    """Before, each run of each chunk was a row of the shuffle."""
    class Wanted:
        value = np.zeros((1 << 16) >> 6, dtype=np.uint64)

    rows = pa.array(np.random.default_rng(1).integers(0, 1 << 62, (500, 40)).tolist(), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([rows], names=["t"])
    assert sum(b.num_rows for b in KW._held_runs(Wanted, (1 << 16) - 1, 3)([batch])) == 0
    Wanted.value = ~Wanted.value
    assert sum(b.num_rows for b in KW._held_runs(Wanted, (1 << 16) - 1, 3)([batch])) == 500 * (40 + 39 + 38)


def test_blocks_that_meet_one_block_stay_small(spark, monkeypatch):
    """Before, 16 blocks held the rows whatever their number (up to 65,536 vectors each in a Python worker)."""
    from lexgraph.operators import blocks as B
    sizes, pack = [], B._pack
    monkeypatch.setattr(B, "_grid", lambda spark: 16)
    monkeypatch.setattr(B, "_pack", lambda df, i, v, n: sizes.append(n) or pack(df, i, v, n))
    X = np.random.default_rng(2).normal(size=(1000, 3))
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, embedding array<double>")
    cent = emb.filter("id < 5")
    got = {r.qid: r.cid for r in B.block_topk(emb, cent, 1, metric="l2", largest=False, block_rows=10).collect()}
    near = {r.cid for r in B.block_topk(cent.filter("id = 0"), emb, 7, metric="l2", largest=False, block_rows=10).collect()}
    assert sizes == [100, 1, 1, 100]
    assert got == {i: int(np.argmin(((X[:5] - x) ** 2).sum(1))) for i, x in enumerate(X)}
    assert near == set(np.argsort(((X - X[0]) ** 2).sum(1))[:7].tolist())
    sizes.clear()
    B.block_topk(emb, emb, 1, block_rows=10)
    assert sizes == [16, 16]


def test_neighbours_that_cannot_enter_a_list_are_not_sent():
    """Before, every member of a gathered list sent its best whatever its list held already."""
    from lexgraph.operators.descent import _compare
    X = np.random.default_rng(5).normal(size=(30, 4))
    unit = X / np.linalg.norm(X, axis=1)[:, None]
    S = unit @ unit.T
    np.fill_diagonal(S, -np.inf)
    worst = np.sort(S, axis=1)[:, -3]          # lists that hold the three best
    cols = {"ms": list(range(30)), "xs": X.tolist(), "norms": np.linalg.norm(X, axis=1).tolist()}
    for least, sent in ((worst, 3), (np.full(30, -np.inf), 8)):
        batch = pa.RecordBatch.from_pydict({k: [v] for k, v in (cols | {"worsts": least.tolist()}).items()})
        out = pa.Table.from_batches(list(_compare(8)([batch]))).to_pydict()
        assert Counter(out["src"]) == dict.fromkeys(range(30), sent)
        assert all(abs(S[a, b] - s) < 1e-12 for a, b, s in zip(out["src"], out["dst"], out["sim"]))
