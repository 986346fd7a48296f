"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A document is the bag of its five-word shingles; the measure is probability
Jaccard, ``sum_i 1 / sum_j max(u_j/u_i, v_j/v_i)``, which is plain Jaccard where
no shingle repeats.

1. Sketch: the arrivals of a shingle of weight ``w`` form a Poisson process of
   rate ``w`` that falls on random signature slots; a slot keeps its first
   arrival.  Arrivals are drawn round by round, for a whole batch of documents
   at once, and a shingle stops as soon as it is later than every slot of its
   document.  Two slots agree with the probability of the measure.
2. Classes: documents of equal words are one class with one sketch, however
   many they are; all later steps see classes only.
3. Banding: classes that agree on all rows of a band share a bucket.  No
   bucket is paired up in full.  Its leader -- the member whose buckets are the
   largest, which in a crowd of copies is their common origin -- is paired with
   the others, and these pairs are verified exactly.  The members of all buckets
   with one leader are its crowd.  Where a crowd holds several components, its
   members that share a band are compared across components, block by block,
   inside tasks of bounded size that return links only.
4. Components of the verified links, by alternating large and small stars.

Verification, like everything on classes, is a join; a hot leader is only a
join key, whose partition Spark can split.  Nothing of the documents' number
reaches the driver.

Defined cases: a text of one to four words is one shingle; texts without a word
(NULL and empty ones among them) are alone in their groups; equal measures need
no tie-break, groups take their least id; rows with a NULL id are members like any
other and go where their group holds an id, and of a group without any the least
text hash stays; repeated rows are members of one class;
an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.llm.common import chunks_of, read, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
BLOCK = 256  # members of a crowd compared at once with as many others
MAX_BROADCAST = 1_000_000
WORD = re.compile(r"\w+")
_GOLD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
DOC_BITS = 20  # documents of a batch, above the 44 bits of a shingle's hash


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _GOLD
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word, from its characters and their places."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(sizes) - sizes
    place = (np.arange(len(code)) - np.repeat(begin, sizes)).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(code * _GOLD + (place + np.uint64(1)) * _MIX), begin) + sizes.astype(np.uint64))


def shingle_bags(texts: list[str | None]):
    """(keys, counts, fingerprints): sorted ``document << 44 | shingle`` of the
    batch, how often each occurs, and 16 bytes that tell the word sequence
    (None: no word)."""
    import hashlib
    cut = [WORD.findall(t.lower()) if t else [] for t in texts]
    prints = [hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest() if w else None for w in cut]
    index: dict[str, int] = {}
    for w in cut:
        for x in w:
            if x not in index:
                index[x] = len(index)
    if not index:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), prints
    hashes = np.append(_word_hashes(list(index)), np.uint64(0))
    none = len(index)  # short texts are filled up with a word that is none
    get = index.__getitem__
    flat = np.array([i for w in cut if w for i in list(map(get, w)) + [none] * (SHINGLE - len(w))], np.int64)
    sizes = np.array([max(len(w), SHINGLE) if w else 0 for w in cut])
    doc = np.repeat(np.arange(len(cut)), sizes)
    h = hashes[flat]
    s = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        s = (s ^ h[j:len(h) - SHINGLE + 1 + j]) * _GOLD
        s ^= s >> np.uint64(31)
    whole = doc[:len(s)] == doc[SHINGLE - 1:]
    keys = np.sort((doc[:len(s)][whole].astype(np.uint64) << np.uint64(64 - DOC_BITS)) | (_mix(s[whole]) >> np.uint64(DOC_BITS)))
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[begin], np.diff(np.append(begin, len(keys))), prints


def signatures(keys: np.ndarray, counts: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """(documents x slots) shingle that arrives first in each slot; 0 in
    documents without shingles."""
    doc = (keys >> np.uint64(64 - DOC_BITS)).astype(np.int64)
    item = keys & np.uint64((1 << (64 - DOC_BITS)) - 1)
    first = np.full(n_docs * slots, np.inf)
    who = np.zeros(n_docs * slots, np.uint64)
    time, rate = np.zeros(len(keys)), counts.astype(np.float64)
    turn = 0
    while len(item):
        turn += 1
        draw = _mix(item * _MIX + np.uint64(turn * int(_GOLD) & (1 << 64) - 1))
        # 53 bits give the exponential gap, another mix the slot
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate
        at = doc * slots + (_mix(draw + _GOLD) % np.uint64(slots)).astype(np.int64)
        early = np.flatnonzero(time < first[at])
        # later arrivals first, so that the earliest of a slot is written last
        early = early[np.argsort(-time[early], kind="stable")]
        first[at[early]] = time[early]
        who[at[early]] = item[early]
        last = first.reshape(n_docs, slots).max(axis=1)
        live = time < last[doc]
        doc, item, time, rate = doc[live], item[live], time[live], rate[live]
    return who.reshape(n_docs, slots)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, fp, bands): ``t`` and the id tell the row, ``fp`` its words (NULL:
    none), ``bands`` are the keys of its buckets."""
    def run(batches):
        import pyarrow as pa
        for b in chunks_of(batches, 1_000, "text", 4 << 20):
            keys, counts, prints = shingle_bags(b.column("text").to_pylist())
            who = signatures(keys, counts, b.num_rows, BANDS * BAND_ROWS).reshape(b.num_rows, BANDS, BAND_ROWS)
            band = np.arange(1, BANDS + 1, dtype=np.uint64)[None] * _GOLD
            for r in range(BAND_ROWS):
                band = _mix(band ^ who[:, :, r])
            flat = pa.array(band.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * BANDS + 1, BANDS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t"), pa.array(prints, pa.binary()), lists],
                                             names=["id", "t", "fp", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, t long, fp binary, bands array<bigint>")


def probability_jaccard(a, ca, b, cb) -> float:
    """Exact measure of two bags given by sorted distinct items and counts."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = ca[ia].astype(np.float64), cb[ib].astype(np.float64)
    only_a, only_b = ca.sum() - x.sum(), cb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    from_x = np.append(np.cumsum(x[::-1])[::-1], 0.0)  # sum of x at and after a place
    to_y = np.append(0.0, np.cumsum(y))  # sum of y before a place
    at = np.searchsorted(ratio, ratio, side="left")
    return float((x / (from_x[at] + only_a + ratio * (to_y[at] + only_b))).sum())


def verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose measure reaches ``similarity``."""
    left = bags.select(F.col("fp").alias("u"), F.col("items").alias("ui"), F.col("counts").alias("uc"))
    right = bags.select(F.col("fp").alias("v"), F.col("items").alias("vi"), F.col("counts").alias("vc"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "ui", "uc", "vi", "vc")

    def run(batches):
        import pyarrow as pa
        num = lambda x, t: np.frombuffer(x.as_buffer(), dtype=t)
        for b in batches:
            ok = [probability_jaccard(num(ui, "<u8"), num(uc, "<u4"), num(vi, "<u8"), num(vc, "<u4")) >= similarity
                  for ui, uc, vi, vc in zip(*(b.column(c) for c in ("ui", "uc", "vi", "vc")))]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "u binary, v binary")


def same_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (__id, __t) where a NULL id equals another."""
    return left.alias("l").join(right.alias("r"), F.col("l.__id").eqNullSafe(F.col("r.__id")) & (F.col("l.__t") == F.col("r.__t")), how)


def bags_of(docs: DataFrame, wanted: DataFrame, n_wanted: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, items, counts) of the wanted classes, read from one row of each."""
    ids = wanted.select(F.col("id").alias("__id"), F.col("t").alias("__t"))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__t"), F.col(text_col).alias("text"))
    rows = same_rows(rows, F.broadcast(ids) if n_wanted <= MAX_BROADCAST else ids, "left_semi").select("text")

    def run(batches):
        import pyarrow as pa
        low = np.uint64((1 << (64 - DOC_BITS)) - 1)
        for b in chunks_of(batches, 1_000, "text", 4 << 20):
            keys, counts, prints = shingle_bags(b.column("text").to_pylist())
            ends = np.searchsorted(keys >> np.uint64(64 - DOC_BITS), np.arange(b.num_rows + 1, dtype=np.uint64))
            cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints, pa.binary()), pa.array([(keys[i:j] & low).tobytes() for i, j in cuts], pa.binary()),
                 pa.array([counts[i:j].astype("<u4").tobytes() for i, j in cuts], pa.binary())], names=["fp", "items", "counts"])

    return rows.mapInArrow(run, "fp binary, items binary, counts binary").dropDuplicates(["fp"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (u, v): the least node of each
    component, by alternating large and small stars to the fixed point."""
    edges = stored(links.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .filter("a <> b").distinct()
        large = stored(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")
        edges = stored(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``nodes`` with ``root``, their own value where no link holds them."""
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))


def leaders(members: DataFrame) -> DataFrame:
    """(key, leader) of (key, fp, n): the member of each bucket whose own
    buckets, of ``n`` members each, are the largest together."""
    weight = members.groupBy("fp").agg(F.sum("n").alias("weight"))
    return members.join(weight, "fp").groupBy("key").agg(F.max(F.struct("weight", "fp"))["fp"].alias("leader"))


def common_items(items: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many items each two of the bags share, by products of 0/1 matrices
    over the items that occur in several, a bounded number of columns at once."""
    n = len(items)
    out = np.zeros((n, n), np.float64)
    every = np.concatenate(items)
    row = np.repeat(np.arange(n), [len(x) for x in items])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times > 1)
    number = np.full(len(times), -1)
    number[several] = np.arange(len(several))
    column = number[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, len(several), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((n, min(width, len(several) - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return out


def crowd_links(crowds: DataFrame, bands: DataFrame, bags: DataFrame, similarity: float, block: int) -> DataFrame:
    """Verified links (u, v) between different components of each crowd.

    ``crowds``: (crowd, fp, root).  A crowd with several components is dealt into
    blocks of about ``block`` members; each pair of blocks is one group, whose
    size is bounded whatever the crowd's.  Inside it, members of different
    components that share a band are compared exactly, by one matrix of common
    shingles; bags with repeats among them one by one.  Only links leave."""
    parts = crowds.groupBy("crowd", "root").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("crowd").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = crowds.join(open_.select("crowd", blocks.alias("blocks")), "crowd") \
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("crowd", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp", "root")
    rows = cells.join(bags, "fp").join(bands.select("fp", "bands"), "fp")

    def compare(pdf):
        import pandas as pd
        names, own_block = pdf["fp"].tolist(), pdf["own"].to_numpy()
        root = pd.factorize(pdf["root"])[0]
        keys = np.stack(pdf["bands"].to_numpy())
        items = [np.frombuffer(x, "<u8") for x in pdf["items"]]
        counts = [np.frombuffer(x, "<u4") for x in pdf["counts"]]
        apart = root[:, None] != root[None, :]
        if pdf["a"].iat[0] != pdf["b"].iat[0]:
            apart &= own_block[:, None] != own_block[None, :]
        shared = np.zeros(apart.shape, bool)
        for k in range(keys.shape[1]):
            shared |= keys[:, k][:, None] == keys[:, k][None, :]
        common = common_items(items)
        size = np.array([len(x) for x in items], np.float64)
        plain = np.array([bool((c == c[0]).all()) for c in counts])
        # where no shingle repeats, or all of them alike, the measure is common / union
        exact = common / (size[:, None] + size[None, :] - common)
        both = plain[:, None] & plain[None, :]
        near = np.where(both, exact >= similarity, True)
        i, j = np.nonzero(np.triu(apart & shared & near, 1))
        up, found = root.copy(), []
        for x, y in zip(i.tolist(), j.tolist()):
            if up[x] != up[y] and (both[x, y] or probability_jaccard(items[x], counts[x], items[y], counts[y]) >= similarity):
                found.append((max(names[x], names[y]), min(names[x], names[y])))
                up[up == up[y]] = up[x]
        return pd.DataFrame(found, columns=["u", "v"])

    return rows.groupBy("crowd", "a", "b").applyInPandas(compare, "u binary, v binary")


def _grouped(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, t, fp, class_id, group_id, keep), one row per document row."""
    rows = stored(sketches(docs, id_col, text_col))
    named = rows.filter(F.col("fp").isNotNull())
    # proper ids before NULL ones; all rows of a class have the same bands
    place = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    reps = stored(named.groupBy("fp").agg(F.min(place).alias("of"), F.min_by("bands", place).alias("bands"))
                  .select("fp", "of.id", "of.t", "bands"))
    classes = reps.select("fp", "id", "t")
    keys = reps.select("fp", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(keys.join(shared, "key"))
    nodes = members.select("fp").distinct()
    wanted = stored(nodes.join(reps.select("fp", "id", "t", "bands"), "fp"))
    bags = stored(bags_of(docs, wanted, wanted.count(), id_col, text_col))
    crowds = stored(members.select("key", "fp").join(leaders(members), "key").select(F.col("leader").alias("crowd"), "fp").distinct())
    star = crowds.filter("crowd <> fp").select(F.greatest("fp", "crowd").alias("u"), F.least("fp", "crowd").alias("v")).distinct()
    links = stored(verified(star, bags, similarity))
    found = components(links)
    more = stored(crowd_links(labelled(crowds, found), wanted, bags, similarity, block))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    groups = stored(labelled(classes, found))
    least = groups.groupBy("root").agg(F.min(place).alias("of")).select("root", F.col("of.id").alias("group_id"), F.col("of.t").alias("of_t"))
    table = groups.join(least, "root").select("fp", F.col("id").alias("class_id"), "group_id", "of_t")
    out = rows.select("id", "t", "fp").join(table, "fp", "left")
    keep = F.col("fp").isNull() | F.col("id").eqNullSafe(F.col("group_id")) & (F.col("id").isNotNull() | (F.col("t") == F.col("of_t")))
    return out.select("id", "t", "fp", F.coalesce("class_id", "id").alias("class_id"),
                      F.coalesce("group_id", "id").alias("group_id"), keep.alias("keep"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                block: int = BLOCK) -> DataFrame:
    """(id, t, class_id, group_id, keep), one row per document row; ``t`` is the
    xxhash64 of the text."""
    g = _grouped(docs, id_col, text_col, similarity, block)
    return g.select(F.col("id").alias(id_col), "t", "class_id", "group_id", "keep")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, the one with the least id."""
    groups = stored(_grouped(docs, id_col, text_col, **options))
    lost = groups.filter(~F.col("keep")).select(F.col("id").alias("__id"), F.col("t").alias("__t")).distinct()
    n_lost = lost.count()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).alias("__id"),
                        F.xxhash64(F.col(text_col)).alias("__t"))
    kept = same_rows(keyed, F.broadcast(lost) if n_lost <= MAX_BROADCAST else lost, "left_anti")
    # repeated rows: one of each stays
    repeated = groups.filter(F.col("id").isNotNull()).groupBy("id").count().filter("count > 1")
    if not repeated.isEmpty():
        kept = kept.filter(F.col("__id").isNull()).unionByName(
            kept.filter(F.col("__id").isNotNull()).dropDuplicates(["__id", "__t"]))
    # rows without an id are told apart by their text, and by nothing where that has no word
    twins = groups.filter(F.col("keep") & F.col("id").isNull() & F.col("fp").isNotNull()).groupBy(F.col("t").alias("__t")).count() \
        .filter("count > 1").select("__t")
    if not twins.isEmpty():
        bare = kept.filter(F.col("__id").isNull())
        kept = kept.filter(F.col("__id").isNotNull()).unionByName(bare.join(twins, "__t", "left_anti").select(*kept.columns)) \
            .unionByName(bare.join(twins, "__t", "left_semi").dropDuplicates(["__t"]).select(*kept.columns))
    return kept.select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_groups(read(spark, sf_dir, "documents"))
    return g.select("doc_id", "class_id", "group_id", "keep")
