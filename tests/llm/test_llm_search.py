"""Ranked search and repeated passages against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from lexgraph.llm import ranked_search as rs
from lexgraph.llm import suffix_dedup as sd


# ------------------------------------------------------------ ranked search
def brute_rank(docs, items, top):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, n in Counter(cut(text)).items() if t in c)
            scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(x for x in scores if x[0] < 0)[:top])]
    return sorted(out, key=str)


DOCS = "doc_id long, text string, score long, rank int"


@pytest.mark.parametrize("block", [4096, 7])
def test_ranks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rs, "BLOCK_DOCS", block)
    rng = np.random.default_rng(3)
    word = lambda: f"w{int(rng.zipf(1.3)) % 60}"  # noqa: E731  a few very common words
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(1, 80))))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "!? ;"), (203, "W1 w2, É é"), (203, "W1 w2, É é"), (None, "w1 w2 w3"), (204, "w7 " * 20_000), (2, docs[2][1])]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 30))))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "É w1 w1 w1 É"), (103, "unheard"), (7, "w5 w6"), (104, "w7 w7 w1")]
    d = spark.createDataFrame([(*x, 1, 1) for x in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in rs.ranked_search(d, b, top=5).collect()), key=str)
    assert got == brute_rank(docs, items, 5)


def test_passes_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"a b{i % 3} c{i % 5} d") for i in range(30)], "doc_id string, text string")
    items = spark.createDataFrame([(f"q{i}", f"a b{i % 3} c{i}") for i in range(7)], "item_id string, text string")
    whole = sorted(map(tuple, rs.ranked_search(docs, items).collect()))
    monkeypatch.setattr(rs, "ITEMS", 2)
    assert sorted(map(tuple, rs.ranked_search(docs, items).collect())) == whole and whole


def test_nothing_to_rank(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rs.ranked_search(none, items).count() == 0
    assert rs.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).count() == 0


# ------------------------------------------------------------ repeated passages
def brute_cut(docs, size):
    """Rows of one id are one document whose places are (id, start)."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            key, at = b[p:p + size], (i is not None, i or 0, p)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - size + 1):
            if first[b[p:p + size]] < (i is not None, i or 0, p):
                gone[p:p + size] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = np.random.default_rng(seed)
    text = lambda n: "".join(rng.choice(list("abcdé "), n))
    pool = [text(int(n)) for n in rng.integers(15, 90, 12)]
    docs = []
    for i in range(120):
        parts = [text(int(rng.integers(0, 60))) for _ in range(4)]
        for k in range(3):
            parts.insert(int(rng.integers(0, len(parts))), pool[int(rng.integers(0, len(pool)))][int(rng.integers(0, 6)):])
        docs.append((i, "".join(parts)))
    docs += [(300, None), (301, ""), (302, "ab"), (303, "a" * 5000), (304, "a" * 700), (305, "abc" * 900), (306, "xabc" + "abc" * 90)]
    docs += [(400 + i, docs[5][1]) for i in range(40)] + [(500 + i, docs[6][1] + text(40) + pool[0]) for i in range(60)]
    docs += [(7, docs[7][1]), (8, pool[1] + docs[9][1]), (None, docs[10][1]), (None, pool[2] * 2)]
    return docs


@pytest.mark.parametrize("seed,rows", [(1, 4096), (2, 64)])
def test_cuts_equal_brute_force(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(sd, "RANK_ROWS", rows)
    docs = passages(seed)
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, h long, start long").repartition(5)
    got = sd.cut_documents(d, 20)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_cut(docs, 20)


def test_long_texts_in_segments(spark, monkeypatch):
    rng = np.random.default_rng(9)
    half = "".join(rng.choice(list("abcdefgh"), 3000))
    docs = [(1, half + "".join(rng.choice(list("abcdefgh"), 500))), (2, "zz" + half[100:] + "yy"), (3, half[2500:])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_cut(docs, 100)
    assert sorted((tuple(r) for r in sd.cut_documents(d).collect()), key=str) == want
    pieces = [p for x in sd._pieces([docs[0][1].encode() * 700], 100) for p in x]  # longer than a segment
    assert [p[1] for p in pieces] == [0, sd.SEGMENT, 2 * sd.SEGMENT] and all(len(p[2]) <= sd.SEGMENT + 99 for p in pieces)
    long = spark.createDataFrame([(1, docs[0][1] * 700), (2, "x" + docs[0][1])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in sd.cut_documents(long).collect()}
    assert got == {1: (2_450_000, 2_446_500, 1), 2: (3501, 3500, 1)}
    kept = sd.cut_documents(d, with_bytes=True).select("kept", "kept_sha256").collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept)


def test_doubling_ranks_windows(spark):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    for size in (16, 20, 31):
        where = np.arange(0, 3000 - size)
        alive, rank = sd.doubled_ranks(data, where, size)
        held = Counter(bytes(data[p:p + size]) for p in where)
        assert alive.tolist() == [p for p in where if held[bytes(data[p:p + size])] > 1]
        assert len({(r, bytes(data[p:p + size])) for p, r in zip(alive, rank)}) == len(set(rank.tolist()))


def test_no_documents(spark):
    assert sd.cut_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
