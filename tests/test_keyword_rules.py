"""Near-copy merge, lattice splitting, rounds of proposals, hot-key join."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lexgraph.operators import keywords as KW
from lexgraph.operators.hotjoin import frequent_keys, hot_join


def names(df):
    return sorted(r["keyword"] for r in df.collect())


def kw(spark, words):
    return spark.createDataFrame([(w,) for w in words], "keyword string")


def toks(w):
    return re.findall(r"\w+", w.lower())


def test_recycling_spellings_become_one(spark):
    got = names(KW.dedup_keywords(kw(spark, ["Styrofoam recycling", "Styrofoam packaging recycling", "Styrofoam recycling machine",
                                             "recycling Styrofoam", "glass", "!!", " !! ", "", None])))
    assert got == ["", " !! ", "Styrofoam recycling", "glass"]


def brute_dedup(words, t=0.6):
    sets = {w: frozenset(toks(w)) for w in words}
    first = {}
    for w in sorted(words):
        first.setdefault(sets[w], w)
    held = Counter(sets[w] for w in words)
    order = sorted(first, key=lambda s: (-held[s], len(s), " ".join(sorted(s))))
    kept = []
    for s in order:
        if not any(len(s & x) >= t * len(s | x) - 1e-12 for x in kept):
            kept.append(s)
    return sorted(first[s] for s in kept)


@pytest.mark.parametrize("wide", [24, 3])
def test_dedup_equals_brute_force(spark, wide, monkeypatch):
    rng = np.random.default_rng(1)
    words = sorted({" ".join(f"w{min(int(rng.zipf(1.4)), 40)}" for _ in range(int(rng.integers(1, 9)))) for _ in range(400)})
    sets = [(" ".join(sorted(set(toks(w)))), sorted(set(toks(w)))) for w in words]
    sets = sorted({k: t for k, t in sets}.items())
    pairs = {(r["a"], r["b"]) for r in KW.near_pairs(spark.createDataFrame(sets, "k string, t array<string>"), 0.6, wide).collect()}
    want = {(a, b) for (a, x), (b, y) in combinations(sets, 2) if 5 * len(set(x) & set(y)) >= 3 * len(set(x) | set(y))}
    assert pairs == want and want
    assert names(KW.dedup_keywords(kw(spark, words))) == brute_dedup(words)


def test_split_into_parts_that_stand_alone(spark):
    texts = ["apple pie"] * 8 + ["recycling of glass"] * 9 + ["apple recycling"] * 2 + ["new york"] * 5 + ["things"] * 30
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    got = names(KW.split_keywords(kw(spark, ["Apple recycling", "new york", "Glass", "new york recycling glass", "apple things", "unheard words", "!!"]), chunks))
    # "new york" is no two words (each as frequent as the whole); "things" is no part; "Glass" is there already
    assert got == ["!!", "Glass", "apple", "apple things", "new york", "recycling", "unheard words"]
    assert names(KW.split_keywords(kw(spark, []), chunks)) == []


def test_rounds_give_each_keyword_once(spark):
    rows = [("a", "x", 5.0), ("a", "y", 4.0), ("a", "z", 1.0), ("b", "x", 6.0), ("b", "y", 4.0), ("b", "q", 0.5), ("c", "banned", 9.0), ("c", "x", 1.0)]
    scored = spark.createDataFrame(rows, "set_id string, keyword string, score double")
    avoid = kw(spark, ["banned"])
    got = {(r["set_id"], r["keyword"]): r["round"] for r in KW.keyword_rounds(scored, 2, avoid).collect()}
    # round 1: b wins x, a wins y by its name; round 2: a takes z, b takes q; c is left with nothing
    assert got == {("b", "x"): 1, ("a", "y"): 1, ("a", "z"): 2, ("b", "q"): 2}
    assert KW.keyword_rounds(scored.limit(0), 2).count() == 0


def test_topic_filter(spark):
    chunks = spark.createDataFrame([("1", "solar power plant"), ("2", "wind power"), ("3", "cake recipe")], "chunk_id string, text string")
    got = names(KW.on_topic(kw(spark, ["solar power", "cake"]), "solar power", chunks, 0.8, dim=256))
    assert got == ["solar power"]


def test_hot_join_equals_left_join(spark):
    rows = spark.createDataFrame([(i, "the" if i % 3 == 0 else f"w{i % 50}" if i % 7 else None) for i in range(3000)], "id long, token string")
    table = spark.createDataFrame([("the", 1, 2.0)] + [(f"w{i}", i, float(i)) for i in range(40)], "token string, a int, b double")
    hot = frequent_keys(rows, "token", 0.2)
    assert [r["token"] for r in hot.collect()] == ["the"]
    got = sorted(map(tuple, hot_join(rows, table, "token", share=0.2).collect()), key=str)
    assert got == sorted(map(tuple, rows.join(table, "token", "left").select("id", "token", "a", "b").collect()), key=str)
