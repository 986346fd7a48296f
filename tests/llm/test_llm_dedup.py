"""Line dedup, near-duplicate groups and decontamination: fixtures with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexgraph.llm import decontaminate as D
from lexgraph.llm import line_dedup as L
from lexgraph.llm import near_dedup as N

SCHEMA = "doc_id long, text string, lang string"


def long_line(i):
    return f"this is the shared line number {i} with enough characters"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_line_dedup_cases(spark):
    a, b = long_line(1), long_line(2)
    docs = [(i, f"own {i}\n  {a.upper()}\t", "en") for i in range(1, 7)]  # six documents, the last wins
    docs += [(10, None, None), (11, "", "en"), (12, f"{b}\n{b}", "en"), (13, b, "en"), (14, b, "en"), (15, b, None),
             (None, a, "en"), (16, "é" * 50 + "\n" + "x" * 100_000, "en")]
    got = {r["doc_id"]: r for r in L.keep_bitmaps(spark.createDataFrame(docs, SCHEMA)).collect()}
    for i in range(1, 6):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (2, 1, sha(f"own {i}"))
        assert bytes(got[i]["keep_bitmap"]) == b"\x80"
    assert got[6]["n_dropped"] == 0 and got[6]["keep_bitmap"] is None
    assert got[10]["n_lines"] == got[11]["n_lines"] == 1 and got[10]["kept_sha256"] == sha("")
    assert got[12]["n_dropped"] == 0  # four documents are too few
    assert got[None]["n_dropped"] == 0
    assert got[16]["n_lines"] == 2


def test_line_dedup_bitmap_and_repeats(spark):
    a = long_line(3)
    text = "\n".join(["short"] * 9 + [a, "tail", a])
    docs = [(i, text, "en") for i in range(5)] + [(0, text, "en")]  # a repeated row
    rows = L.keep_bitmaps(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == 6
    for r in rows:
        if r["doc_id"] < 4:
            bits = "".join(f"{x:08b}" for x in bytes(r["keep_bitmap"]))[:r["n_lines"]]
            assert bits == "1" * 9 + "0" + "1" + "0" and r["n_dropped"] == 2
        else:
            assert r["n_dropped"] == 0


def test_line_dedup_keeps_columns(spark):
    docs = spark.createDataFrame([(i, long_line(1), i, "x") for i in range(6)], "doc_id long, text string, pos int, h1 string") \
        .withColumnRenamed("h1", "odd name.1")
    out = L.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["pos"]) for r in out.collect()} == \
        {(i, "" if i < 5 else long_line(1), i) for i in range(6)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert L.keep_bitmaps(empty).count() == 0 and L.drop_repeated_lines(empty).count() == 0
    assert N.near_groups(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0
    assert D.contamination(empty, bench).count() == 0 and D.decontaminate(empty, bench).count() == 0


# ------------------------------------------------------------ decontamination
def brute_hits(doc, items, n=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), doc or ""))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(words) - size + 1):
                if words[i:i + size] == w[k:k + size]:
                    hit.update(range(i, i + size))
                    names.add(name)
    return len(words), len(hit), names


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 12)}"  # noqa: E731  few words: chance matches and repeats
    items = [(i, " ".join(word() for _ in range(int(rng.integers(0, 25))))) for i in range(30)]
    items += [(100, "one"), (101, "Two, words"), (102, None), (103, "..."), (104, "É a b c d e f g h i j k l"), (30, items[3][1])]
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 120))))) for i in range(60)]
    docs += [(200, None), (201, ""), (202, "!!"), (203, "say ONE thing"), (204, "two-words"), (205, items[5][1] + " z " + items[7][1]),
             (206, "É A b c d e f g h i j k l"), (207, "é a b c d e f g h i j k l"), (208, " ".join(["w1"] * 3000))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], set(r["items"]), r["contaminated"]) for r in D.contamination(d, b).collect()}
    for i, text in docs:
        n, hit, names = brute_hits(text, items)
        assert got[i] == (n, hit, names, hit > 0), i
    small = {r["doc_id"]: (r["n_words"], r["n_hit"], set(r["items"]), r["contaminated"])
             for r in D.contamination(d, b, max_broadcast=0).collect()}
    assert small == got


def test_decontamination_removal(spark):
    item = " ".join(f"k{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "clean Text", 1), (2, f"Before {item} after", 2), (2, "other text of the id", 3), (None, item, 4),
                                  (3, None, 5), (4, item, 6), (4, item, 6)], "doc_id long, text string, w int")
    bench = spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string")
    out = D.decontaminate(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r["w"] for r in out.collect()) == [1, 3, 5]
    cut = {r["w"]: r["text"] for r in D.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {1: "clean Text", 2: "before after", 3: "other text of the id", 4: "", 5: None, 6: ""}
    none = spark.createDataFrame([], "item_id string, text string")
    assert D.decontaminate(docs, none).count() == 7
    with pytest.raises(ValueError):
        D.decontaminate(docs, bench, remove="all")


# ------------------------------------------------------------ near duplicates
def test_probability_jaccard_and_signatures():
    rng = np.random.default_rng(2)
    a = [f"w{rng.integers(0, 3)}" for _ in range(60)]
    b = a[:50] + ["x"] * 10
    keys, counts, _ = N.shingle_bags([" ".join(a), " ".join(b)])
    low, doc = np.uint64((1 << 44) - 1), keys >> np.uint64(44)
    pick = lambda i: (keys[doc == i] & low, counts[doc == i])
    bag = lambda w: Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    u, v = bag(a), bag(b)
    want = sum(1 / sum(max(u[j] / u[i], v[j] / v[i]) for j in set(u) | set(v)) for i in set(u) & set(v))
    assert abs(N.probability_jaccard(*pick(0), *pick(1)) - want) < 1e-12
    s = N.signatures(keys, counts, 2, 4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def groups_of(spark, docs, **options):
    out = N.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    return {r["doc_id"]: (r["class_id"], r["group_id"]) for r in out}, out


def test_near_groups_cases(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    copy = list(base)
    copy[150] = "changed"
    other = [f"v{x}" for x in rng.integers(0, 5000, 300)]
    docs = [(5, " ".join(base)), (3, " ".join(base).upper()), (9, " ".join(copy)), (1, " ".join(other)), (20, None), (21, ""),
            (22, "!!!"), (23, "!!!"), (30, "two words"), (31, "Two, words"), (32, "two other"), (40, "x " * 50_000), (41, "x " * 49_000)]
    got, rows = groups_of(spark, docs)
    assert got[5] == (3, 3) and got[3] == (3, 3) and got[9] == (9, 3) and got[1] == (1, 1)
    assert all(got[i] == (i, i) for i in (20, 21, 22, 23, 32))
    assert got[31] == (30, 30) and got[41] == (41, 40)
    assert len(rows) == len(docs)


def star(n, seed=4):
    """A base text and ``n`` texts near it but not near each other."""
    rng = np.random.default_rng(seed)
    base = [f"b{x}" for x in range(400)]
    out = []
    for i in range(n):
        w = list(base)
        for at in rng.choice(400, 8, replace=False):
            w[at] = f"c{i}x{at}"
        out.append(" ".join(w))
    return " ".join(base), out


def brute_groups(docs):
    bags = {}
    for i, x in docs:
        w = re.findall(r"\w+", (x or "").lower())
        if w:
            bags[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: find(i) for i, _ in docs}


@pytest.mark.parametrize("block", [256, 7])  # 7: crowds of several blocks
def test_near_groups_star_around_a_late_base(spark, block):
    base, near = star(40)
    docs = [(i, t) for i, t in enumerate(near)] + [(1000, base)]
    got, _ = groups_of(spark, docs, block=block)
    assert {i: g for i, (_, g) in got.items()} == brute_groups(docs)


def test_near_groups_common_passage_is_no_link(spark):
    passage = " ".join(f"p{x}" for x in range(100))
    docs = [(i, passage + " " + " ".join(f"d{i}y{x}" for x in range(100))) for i in range(60)]
    got, _ = groups_of(spark, docs, block=16)
    assert all(g == i for i, (_, g) in got.items())


def test_drop_near_duplicates(spark):
    base, near = star(3)
    rows = [(7, base, "a"), (8, near[0], "b"), (8, near[0], "b"), (9, "an other text of several words", "c"),
            (9, "an other text of several words", "c"), (None, "no id here at all today", "d"), (10, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = N.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["fp"] for r in out.collect()) == ["a", "c", "d", "e"]


def test_rows_without_id_beside_copies(spark):
    base, near = star(3)
    alone, other = "words that no proper id holds at all", "Words, that no proper id holds - at all!"
    docs = [(None, base), (5, base), (6, base), (7, near[0]), (None, near[1]), (None, alone), (None, alone), (None, other),
            (None, None), (None, None), (None, ""), (9, "something else entirely is said in here")]
    out = spark.createDataFrame([(i, x, k) for k, (i, x) in enumerate(docs)], "doc_id long, text string, k int")
    rows = N.near_groups(out).collect()
    of_base = [r for r in rows if r["group_id"] == 5]
    assert sorted((r["doc_id"] or 0) for r in of_base) == [0, 0, 5, 6, 7]
    assert [r["doc_id"] for r in of_base if r["keep"]] == [5] and all(r["keep"] is not None for r in rows)
    assert {r["class_id"] for r in of_base if r["doc_id"] in (5, 6)} == {5}
    kept = [r["k"] for r in N.drop_near_duplicates(out).collect()]
    assert sorted(k for k in kept if k not in (5, 6, 7)) == [1, 8, 9, 10, 11]
    assert sum(k in (5, 6, 7) for k in kept) == 1


def test_components(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("z1", "z1")]
    found = {r["node"]: r["root"] for r in N.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert all(found[f"n{i:03}"] == "n000" for i in range(1, 61)) and found["z2"] == found["z3"] == "z1"


def test_near_groups_on_given_documents(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    bags, inverted = {}, defaultdict(list)
    for i, x in docs:
        w = re.findall(r"\w+", (x or "").lower())
        if w:
            bags[i] = Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
            for s in bags[i]:
                inverted[s].append(i)
    shared = Counter((a, b) for ids in inverted.values() for k, a in enumerate(ids) for b in ids[k + 1:])
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 2 * n >= max(len(bags[a]), len(bags[b])):
            items = sorted(set(bags[a]) | set(bags[b]))
            at = {s: k for k, s in enumerate(items)}
            arrays = []
            for bag in (bags[a], bags[b]):
                order = sorted(bag, key=at.get)
                arrays += [np.array([at[s] for s in order]), np.array([bag[s] for s in order])]
            if N.probability_jaccard(*arrays) >= 0.8:
                p, q = sorted((find(a), find(b)))
                up[q] = p
    got = {r["doc_id"]: r["group_id"] for r in N.query(spark, sf).collect()}
    assert got == {i: find(i) for i, _ in docs}
