"""Search, packing, language model and their numeric parts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lexgraph.llm import elias_fano, ngram_lm, one_bit_search, packing, tokens


# ----------------------------------------------------------------- search
def brute_nearest(rows, every, k):
    good = {i: np.asarray(v, float) for i, v in rows
            if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.asarray(v, float)).all() and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            s = [(-(good[i] @ good[q]) / (np.linalg.norm(good[i]) * np.linalg.norm(good[q])), i) for i in good if i != q]
            out[q] = [(i, -x) for x, i in sorted((round(x, 12), i) for x, i in s)[:k]]
    return out


def test_search_cases_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 430)]  # copies: ties by id
    rows += [(500, None), (501, [0.0] * 8), (502, [float("nan")] + [1.0] * 7), (503, [1.0] * 3), (504, [None] + [1.0] * 7),
             (505, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (450, rows[7][1]), (450, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", one_bit_search.F.lit(1))
    want = brute_nearest(rows, 50, 5)
    got = {}
    for r in one_bit_search.nearest(df, rows_per_stripe=100, queries_per_stripe=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    same = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(same) >= 0.95 * 5 * len(want)
    for q in got:
        assert len(got[q]) == 5
        for i, s in got[q]:
            v = dict((a, b) for a, b in rows if a is not None)
            x, y = np.array(v[i]), np.array(v[q])
            assert abs(s - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-12
    assert [i for i, _ in got[450]] == [7, 400, 401, 402, 403]


def test_search_small_and_empty(spark):
    one = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, -1.0])], one)
    assert [(r["rank"], r["vec_id"]) for r in one_bit_search.nearest(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    for rows in ([], [(1, [1.0])], [(0, [0.0])], [(0, [1.0])]):
        assert one_bit_search.nearest(spark.createDataFrame(rows, one)).count() == 0


def test_search_recall_on_given_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in one_bit_search.query(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        found += len(got[ids[q]] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert found >= 0.9 * 5 * len(got)


# ----------------------------------------------------------------- packing
def test_schedule_is_gapless_and_keeps_proportions():
    rng = np.random.default_rng(0)
    for _ in range(150):
        totals = rng.integers(0, 200, rng.integers(1, 7)).tolist()
        shares = None if rng.random() < 0.4 else rng.choice([0, 0.1, 0.5, 1, 3], len(totals)).tolist()
        plan, places = packing.Schedule(totals, shares, int(rng.integers(1, 40))), []
        for s, n in enumerate(totals):
            at = 0
            for w in range(plan.windows):
                lo, hi, first = plan.place(s, w)
                assert lo == at and hi >= lo
                places += range(first, first + hi - lo)
                at = hi
            assert at == n
        assert sorted(places) == list(range(sum(totals)))
    plan = packing.Schedule([600, 300, 100], None, 100)
    assert [[plan.served(s, w + 1) - plan.served(s, w) for s in range(3)] for w in range(10)] == [[60, 30, 10]] * 10
    plan = packing.Schedule([10, 1000], [1.0, 1.0], 100)  # the first runs dry
    assert plan.served(0, 1) == 10 and plan.served(1, 1) == 90


@pytest.mark.parametrize("shares", [None, {"a": 1.0, "b": 1.0}])
def test_packing_round_trip(spark, shares):
    text = "Some words, and 3 numbers. " * 40
    docs = [(1, "hello world", "a", 1), (2, None, "a", 1), (3, "", None, 1), (4, text * 20, "b", 1), (5, text, "hot", 1), (5, text, "hot", 1),
            (6, "a   b \n c ", "b", 1), (None, "no id", "b", 1)] + [(100 + i, text, "hot", 1) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, pid int").repartition(5)
    rows = packing.pack(df, tokens.vocabulary(), shares=shares).collect()
    tok = tokens.ByteTokens(tokens.vocabulary())
    ids = {i: np.append(np.asarray(tok.tok.encode(t or "", add_special_tokens=False).ids, "<u4"), 0).astype("<u4") for i, t, _, _ in docs}
    at, sequences = Counter(), {}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_tokens"]))
    repeated = Counter(i for i, *_ in docs)
    assert at == Counter({i: len(ids[i]) * n for i, n in repeated.items()})
    assert sorted(sequences) == list(range(len(sequences)))
    for s, pieces in sequences.items():
        end = 0
        for offset, n, _ in sorted(pieces):
            assert offset == end
            end += n
        assert end == pieces[0][2] == (1024 if s < len(sequences) - 1 else end) <= 1024


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string"), tokens.vocabulary()).count() == 0


def test_ids_are_the_tokenizers_own(spark, sf):
    t = tokens.ByteTokens(tokens.vocabulary(), max_words=2000)
    texts = ["", " ", "a  b", "a   b", "x \n y", "x\n y", "end ", " lead", "tab\t\tx y", "é x", "日本語 x", "it's we'll  don't", "a\x1cb c",
             "<|endoftext|> hi", "\n\n\n", "a\r\n b", "12 34 5x ½ ²", "long" * 2000 + " w " + "y" * 3000, "x\xa0y z"]
    texts += [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for i in range(0, len(texts), 100):
        for text, got in zip(texts[i:i + 100], t.encode(texts[i:i + 100])):
            assert got == t.ids(text)


# ----------------------------------------------------------------- language model
def test_elias_fano_lists():
    rng = np.random.default_rng(0)
    for trial in range(150):
        n, u = int(rng.integers(0, 300)), int(rng.choice([1, 2, 10, 300, 10**6, 2**32, 2**40]))
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        if trial % 3 == 0 and n:
            v = np.sort(np.concatenate([v[:n // 2], np.full(n - n // 2, v[0])]))
        view = elias_fano.View(b"xx" + elias_fano.encode(v, u), 2)
        assert (view.all() == v).all()
        q = np.concatenate([v, rng.integers(0, u, 50, dtype=np.uint64)])
        assert (view.successor(q) == np.searchsorted(v, q)).all()
        if n:
            at = rng.integers(0, n, 50)
            assert (view.access(at) == v[at]).all()


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        keys = np.unique((rng.integers(0, 40, n, dtype=np.uint64) << np.uint64(32)) | rng.integers(0, 2**32, n, dtype=np.uint64))
        probs = -rng.random(len(keys)) * 5
        trie = ngram_lm.BigramTrie(ngram_lm.BigramTrie.build(keys, probs, 5.0))
        assert np.abs(ngram_lm.log_prob_of(trie.find(keys), 5.0) - probs).max(initial=0) <= 5 / 254 / 2 + 1e-9
        other = np.setdiff1d(rng.integers(0, 2**63, 500, dtype=np.uint64), keys)
        assert not trie.find(other).any()


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"W{x}" for x in rng.zipf(1.6, int(rng.integers(0, 80))) if x < 500)) for i in range(300)]
    docs += [(400, None), (401, ""), (402, "É\x0bé\n\n" + "w1 " * 4000), (5, docs[5][1]), (None, "w1 w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ngram_lm.scores(df, block_tokens=700, shard_keys=300).collect()
    assert len(got) == len(docs)
    end = b"\0end"
    cut = lambda t: (t or "").encode().lower().split() + [end]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    one, two = Counter(), Counter()
    for i, t in docs:
        if not held(i):
            one.update(cut(t))
            two.update(zip([end] + cut(t)[:-1], cut(t)))
    n, v, once = sum(one.values()), len(one), sum(c == 1 for c in one.values())
    unknown = min(0.5, (once + 0.1) / (n + 0.1 * (v + 1)))
    single = lambda w: (1 - unknown) * (one[w] + 0.1) / (n + 0.1 * v) if one[w] else unknown
    texts = dict(docs)
    for r in got:
        w = cut(texts[r["doc_id"]])
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        full = sum(math.log10((two[h, x] + ngram_lm.MU * single(x)) / (one[h] + ngram_lm.MU)) for h, x in zip([end] + w[:-1], w))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(one[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-8 * len(w) and abs(r["score"] - full) < 0.02 * len(w)


def test_held_out_texts_are_likelier_than_by_unigrams(spark, sf):
    rows = ngram_lm.query(spark, sf).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.scores(empty).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ngram_lm.scores(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
