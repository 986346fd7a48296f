"""Repeated passages of the corpus, by prefix doubling over sampled positions.

A window is ``min_bytes`` bytes of one text.  Bytes covered by a window that also
starts earlier (smaller id, or same id and earlier start) go.  Ranking every byte
position in every round would shuffle some twenty bytes for each byte of text and
round, so a sample of the positions that loses no repeat is ranked first, and
all byte positions only where a repeat begins or ends:

1. Each window owns one of its positions: the one whose next h = 2/5 ``min_bytes``
   bytes hash lowest.  Equal windows own the same one, so a string of h bytes there
   is their common prefix to rank; about one position in thirty is owned.
2. Spark sorts (rank of h bytes, rank of all bytes that the windows owning the
   position cover, id, start), range-partitioned by all four, so that no group of
   copies is one task.  Positions whose first rank is unique leave.  Of equal
   pairs all but the first have only repeated windows (marks).  Firsts that share
   their first rank with another pair stay.
3. Those few get their bytes and grow: windows that begin far before the
   position share 3/10 ``min_bytes`` more bytes to its left, the others to its
   right.  Spark sorts these longer strings, again by ranges; whoever is alone leaves,
   and all byte positions of the others are ranked by doubling (8, 16, 32, 64, ...
   bytes, the last step overlapping) inside the ranges.
4. What a range's first and last groups cannot decide alone (their windows may be
   in the neighbouring range) is decided by an aggregate over the windows of these.
5. Marks return to their documents, which are cut in their rows.

Ranks up to step 3 are 64-bit hashes of the strings (in step 2 both must agree),
those of the doubling are exact.

Defined cases: a NULL text is empty; texts shorter than a window lose nothing;
rows that share an id (NULL ids too, which come before all others) count as one
document whose places are (id, start), so repeated rows keep or lose the same
bytes and never lose any by each other's equal places; bytes are taken as they
are, valid UTF-8 or not; an empty table gives an empty result; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgraph.llm.common import chunks_of, read, stored

MIN_BYTES = 100
SEGMENT = 1 << 20          # bytes of text that are hashed at once
RANK_ROWS = 4096           # owned positions that are ranked by doubling at once

_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out, m = np.ones(n, np.uint64), 1
    while m < n:
        t = min(m, n - m)
        out[m:m + t] = out[:t] * np.uint64(pow(base, m, 1 << 64))
        m += t
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Rolling 64-bit hashes of all substrings of a buffer of bounded length."""

    def __init__(self, size: int):
        self.up, self.down = _powers(_ODD, size), _powers(pow(_ODD, -1, 1 << 64), size + 1)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        c = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[:len(data)], out=c[1:])
        return c

    def of(self, c: np.ndarray, start, end) -> np.ndarray:
        return _mix((c[end] - c[start]) * self.down[start])


def _owned(c: np.ndarray, hashes: Hashes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the strings of h bytes, position that each window owns)."""
    h = 2 * size // 5
    x = _mix((c[h:] - c[:-h]) * hashes.down[:len(c) - h])
    low, step, w = (x & ~np.uint64(0xFFFFFF)) | np.arange(len(x), dtype=np.uint64), 1, size - h + 1
    while 2 * step <= w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < w:
        low = np.minimum(low[:step - w], low[w - step:])
    return x, (low & np.uint64(0xFFFFFF)).astype(np.int64)


def _pieces(texts, size: int):
    """Buffers of at most ``SEGMENT`` and a window: (row, start in the text, bytes) lists."""
    piece, total = [], 0
    for i, text in enumerate(texts):
        data = text or b""
        for at in range(0, max(len(data) - size + 1, 0), SEGMENT):
            part = data[at:at + SEGMENT + size - 1]
            if piece and total + len(part) > SEGMENT + size:
                yield piece
                piece, total = [], 0
            piece.append((i, at, part))
            total += len(part)
    if piece:
        yield piece


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))


def owned_positions(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, g, id, start, na): the owned positions, ``na >> 16`` bytes after ``start``,
    where the first of their ``na & 65535`` windows starts."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("start", T.LongType()), T.StructField("na", T.IntegerType())])

    def run(batches):
        import pyarrow as pa
        hashes = Hashes(SEGMENT + 2 * size)
        for b in chunks_of(batches, 4096, "text", 2 << 20):
            ids = b.column("id")
            for piece in _pieces(b.column("text").to_pylist(), size):
                data = np.frombuffer(b"".join(p[2] for p in piece), np.uint8)
                c = hashes.prefixes(data)
                x, own = _owned(c, hashes, size)
                sizes = np.array([len(p[2]) for p in piece])
                begin = np.cumsum(sizes) - sizes
                of = np.repeat(np.arange(len(piece)), sizes)[:len(own)]
                p = np.flatnonzero(np.arange(len(own)) + size <= (begin + sizes)[of])
                first = np.flatnonzero(np.r_[True, (own[p][1:] != own[p][:-1]) | (of[p][1:] != of[p][:-1])])
                s, e = p[first], p[np.r_[first[1:] - 1, len(p) - 1]]
                k = of[s]
                start = s - begin[k] + np.array([q[1] for q in piece])[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[own[s]].view(np.int64)), pa.array(hashes.of(c, s, e + size).view(np.int64)),
                     ids.take(pa.array(np.array([q[0] for q in piece])[k])), pa.array(start), pa.array((own[s] - s << 16 | e - s + 1).astype(np.int32))], names=schema.names)

    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def _differs(a) -> np.ndarray:
    """Of each row but the first: does the value differ from the one before (NULL equals NULL)?"""
    import pyarrow.compute as pc
    x, y = a.slice(1), a.slice(0, len(a) - 1)
    same = pc.fill_null(pc.equal(x, y), False)
    return ~pc.or_(same, pc.and_(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)


def rank_pairs(owned: DataFrame) -> DataFrame:
    """(id, start, na, h, g, marked) of sorted pairs: marked ones have an equal pair
    before them; the others are the firsts of pairs whose ``h`` others may have too."""
    by = ["h", "g", "id", "start"]
    schema = T.StructType([owned.schema[c] for c in ("id", "start", "na", "h", "g")] + [T.StructField("marked", T.BooleanType())])

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            new_h = np.r_[True, _differs(b.column("h"))]
            new = new_h | np.r_[True, _differs(b.column("g"))]
            moved = np.cumsum(np.r_[True, _differs(b.column("id")) | _differs(b.column("start"))])
            run_start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            marked = moved > moved[run_start]
            group = np.cumsum(new_h) - 1
            pairs = np.bincount(group, new)[group]
            # what lies before the first and behind the last row of the batch is not known here
            stays = new & ((pairs > 1) | (group == 0) | (group == group[-1]))
            keep = np.flatnonzero(marked | stays)
            rows = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "start", "na", "h", "g")), pa.array(marked[keep])], names=schema.names)

    return owned.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def _with_places(docs: DataFrame, places: DataFrame, how: str, id_col: str, text_col: str) -> DataFrame:
    """(id, text, places): texts with the places of their id, which are the build side;
    a document has at most as many as it is long."""
    fields = [c for c in places.columns if c != "id"]
    per = places.repartition("id").groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("places")).withColumnRenamed("id", "at_id")
    texts = _texts(docs, id_col, text_col)
    return texts.join(per.hint("shuffle_hash"), texts["id"].eqNullSafe(per["at_id"]), how).select("id", "text", "places")


def _located(b, size: int, hashes: Hashes, covered, check):
    """Of a batch of (text, places): (bytes, offsets of the texts, places, their texts,
    their starts in the bytes), without places that another text of the id has.
    ``covered(places)`` gives the bytes a place covers, ``check(places, hashes)`` the true ones."""
    texts, lists = b.column("text"), b.column("places")
    off = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    places = {f.name: lists.flatten().field(f.name).to_numpy(zero_copy_only=False) for f in lists.type.value_type}
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = off[row] + places["start"]
    order = np.argsort(at, kind="stable")
    order = order[(at + covered(places) <= off[1:][row])[order]]
    places, row, at = {k: v[order] for k, v in places.items()}, row[order], at[order]
    true = np.zeros(len(at), bool)
    for lo in range(0, len(data), SEGMENT):
        x, y = np.searchsorted(at, [lo, lo + SEGMENT])
        if x < y:
            c, part = hashes.prefixes(data[lo:lo + SEGMENT + 4 * size]), {k: v[x:y] for k, v in places.items()}
            true[x:y] = check(part, hashes.of(c, at[x:y] - lo, at[x:y] - lo + covered(part)))
    return data, off, {k: v[true] for k, v in places.items()}, row[true], at[true]


def sides_of(docs: DataFrame, firsts: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(h, id, start, n, data): for each of the ``firsts``, the windows that begin at
    least half way before the owned position, and the others: the rank ``h`` of
    the string common to them, and the bytes ``data`` that they cover."""
    schema = T.StructType([T.StructField("h", T.LongType()), firsts.schema["id"], T.StructField("start", T.LongType()),
                           T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])
    h = 2 * size // 5
    half = (size - h + 1) // 2

    def run(batches):
        import pyarrow as pa
        hashes = Hashes(SEGMENT + 4 * size)
        for b in chunks_of(batches, 4096, "text", 4 << 20):
            data, _, p, row, at = _located(b, size, hashes, lambda p: (p["na"] & 65535) - 1 + size,
                                           lambda p, x: x.view(np.int64) == p["g"])
            n, a = (p["na"] & 65535).astype(np.int64), (p["na"] >> 16).astype(np.int64)
            for lo in range(0, len(data), SEGMENT):
                x, y = np.searchsorted(at, [lo, lo + SEGMENT])
                if x == y:
                    continue
                c = hashes.prefixes(data[lo:lo + SEGMENT + 4 * size])
                anchor = at[x:y] - lo + a[x:y]
                far = np.clip(a[x:y] - half + 1, 0, n[x:y])  # windows 0 .. far - 1 begin at least half way before
                for side, first, count, begin, end in ((0, np.zeros_like(far), far, anchor - half, anchor + h),
                                                       (1, far, n[x:y] - far, anchor, anchor + size - half + 1)):
                    k = np.flatnonzero(count > 0)
                    if not len(k):
                        continue
                    s, e = at[x:y][k] + first[k], at[x:y][k] + first[k] + count[k] - 1 + size
                    key = hashes.of(c, begin[k], end[k]) ^ np.uint64(side)
                    size_of = e - s
                    ends = np.cumsum(size_of)
                    flat = np.arange(ends[-1]) - np.repeat(ends - size_of, size_of) + np.repeat(s, size_of)
                    spans = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data[flat])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), b.column("id").take(pa.array(row[x:y][k])), pa.array(p["start"][x:y][k] + first[k]),
                         pa.array(count[k].astype(np.int32)), spans], names=schema.names)

    return _with_places(docs, firsts.select("id", "start", "na", "g"), "inner", id_col, text_col).mapInArrow(run, schema)


def doubled_ranks(data: np.ndarray, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(those ``windows``, by their starts in ``data``, that are not alone; their ranks)."""
    padded = np.r_[data, np.zeros(size, np.uint8)]
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k:k + len(data)]
    h = 8
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    while len(windows):
        windows = windows[np.bincount(rank)[rank[windows]] > 1]
        if h == size or not len(windows):
            break
        step = min(h, size - h)  # the last step overlaps
        key = rank * (int(rank.max()) + 1)
        key[:len(data) - step] += rank[step:]
        if h + step == size:
            last = np.unique(key[windows], return_inverse=True)[1]
            alone = np.bincount(last)[last] == 1
            return windows[~alone], last[~alone]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        h += step
    return windows, rank[windows]


def _ranked(ids, start, n, data, size: int):
    """Of sorted rows, for each window: its row, its number there, its start in ``data``,
    and whether an equal window comes before it."""
    lengths = n.astype(np.int64) - 1 + size
    begin = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    where = begin[row] + number
    alive, rank = doubled_ranks(data, where, size)
    at = np.searchsorted(where, alive)
    place = np.cumsum(np.r_[True, _differs(ids)]) if len(n) else n  # of ids: rows of a group are sorted by id
    begins = start[row] + number
    order = np.lexsort((begins[at], place[row[at]], rank))
    at, rank = at[order], rank[order]
    first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.zeros(0, np.int64)
    lead = at[np.repeat(first, np.diff(np.r_[first, len(rank)]))] if len(rank) else at
    same = (place[row[at]] == place[row[lead]]) & (begins[at] == begins[lead])
    repeated = np.zeros(len(row), bool)
    repeated[at] = ~same
    return row, number, where, repeated


def rank_windows(spans: DataFrame, size: int) -> DataFrame:
    """Rows (id, start, n, v, w): places whose ``n`` windows have an equal earlier one
    (``w`` NULL), and single windows of a range's first and last groups with their hash
    ``w``, which other ranges may know.  ``v`` tells the bytes covered."""
    by = ["h", "id", "start"]
    schema = T.StructType([spans.schema["id"], T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType()),
                           T.StructField("v", T.IntegerType()), T.StructField("w", T.LongType()), T.StructField("w2", T.LongType())])

    def run(batches):
        import pyarrow as pa
        hashes = Hashes(RANK_ROWS * 4 * size)
        held, opening = None, True

        def ranked(table, open_first, open_last):
            """Rows of whole groups, but for the open first and last one."""
            h, ids = table.column("h").to_numpy(), table.column("id")
            start, n = table.column("start").to_numpy(), table.column("n").to_numpy()
            for lo in range(0, len(h), RANK_ROWS):
                # a longer group is cut, and its parts are open
                yield from one(h, ids, start, n, table.column("data"), lo, min(lo + RANK_ROWS, len(h)), open_first, open_last)

        def one(h, ids, start, n, data, lo, hi, open_first, open_last):
            part = slice(lo, hi)
            buf = np.frombuffer(b"".join(data.slice(lo, hi - lo).to_pylist()), np.uint8)
            own = ids.slice(lo, hi - lo)
            row, number, where, repeated = _ranked(own, start[part], n[part], buf, size)
            c = hashes.prefixes(buf)
            k = np.flatnonzero(repeated)
            if len(k):
                cut = np.flatnonzero(np.r_[True, (np.diff(k) != 1) | (row[k][1:] != row[k][:-1])])
                a, z = k[cut], k[np.r_[cut[1:] - 1, len(k) - 1]]
                yield batch(own, row[a], start[part][row[a]] + number[a], z - a + 1, hashes.of(c, where[a], where[z] + size), None, None)
            is_open = np.zeros(hi - lo, bool)
            if lo or open_first:
                is_open |= h[part] == h[lo]
            if hi < len(h) or open_last:
                is_open |= h[part] == h[hi - 1]
            k = np.flatnonzero(is_open[row] & ~repeated)
            if len(k):
                w = hashes.of(c, where[k], where[k] + size)
                w2 = hashes.of(c, where[k] + size // 3, where[k] + size)
                yield batch(own, row[k], start[part][row[k]] + number[k], np.ones(len(k), np.int64), w, w, w2)

        def batch(ids, row, start, n, v, w, w2):
            none = pa.nulls(len(row), pa.int64())
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(start, pa.int64()), pa.array(n.astype(np.int32)), pa.array((v >> np.uint64(33)).astype(np.int32)),
                 none if w is None else pa.array(w.view(np.int64)), none if w is None else pa.array(w2.view(np.int64))], names=schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            table = table.combine_chunks()
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if len(h) - cut > RANK_ROWS:
                cut = len(h)
            if cut:
                whole = table.slice(0, cut).combine_chunks().to_batches()[0]
                yield from ranked(whole, opening, cut == len(h))
                opening = cut == len(h)
            held = table.slice(cut) if cut < len(h) else None
        if held is not None and held.num_rows:
            yield from ranked(held.combine_chunks().to_batches()[0], opening, True)

    return spans.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def repeated_places(docs: DataFrame, size: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n, v): places whose ``n`` windows, starting at ``start``, all have an equal earlier one."""
    if size < 16:
        raise ValueError("min_bytes: at least 16")
    ranked = stored(rank_pairs(owned_positions(docs, size, id_col, text_col)))
    marks = ranked.filter("marked").select("id", "start", F.col("na").bitwiseAND(65535).alias("n"), F.shiftrightunsigned("g", 33).cast("int").alias("v"))
    spans = stored(sides_of(docs, ranked.filter("NOT marked"), size, id_col, text_col))
    windows = stored(rank_windows(spans, size))
    ends = windows.filter(F.col("w").isNotNull())
    first = ends.groupBy("w", "w2").agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("times")) \
        .filter("times > 1").select("w", "w2", "first")
    late = ends.join(first, ["w", "w2"]).filter(~F.struct("id", "start").eqNullSafe(F.col("first")))
    return marks.unionByName(windows.filter(F.col("w").isNull()).select(*marks.columns)).unionByName(late.select(*marks.columns))


def _runs(off: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal runs of intervals sorted by start."""
    if not len(row):
        return row, start, end
    reach = np.maximum.accumulate(end)  # texts lie one behind the other, so an earlier text never reaches into a later one
    new = np.flatnonzero(np.r_[True, (start[1:] > reach[:-1]) | (row[1:] != row[:-1])])
    return row[new], start[new], reach[np.r_[new[1:] - 1, len(row) - 1]]


def cut_documents(docs: DataFrame, size: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): every document without its repeats."""
    marks = repeated_places(docs, size, id_col, text_col)
    joined = _with_places(docs, marks.select("id", "start", "n", "v"), "left", id_col, text_col)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes).fields])

    def run(batches):
        import pyarrow as pa
        hashes = Hashes(SEGMENT + 4 * size)
        for b in chunks_of(batches, 4096, "text", 8 << 20):
            data, off, p, row, at = _located(b, size, hashes, lambda p: p["n"].astype(np.int64) - 1 + size,
                                             lambda p, x: (x >> np.uint64(33)).astype(np.int64) == p["v"])
            row, start, end = _runs(off, row, at, at + p["n"].astype(np.int64) - 1 + size)
            removed = np.bincount(row, end - start, len(off) - 1).astype(np.int64)
            spans = np.bincount(row, minlength=len(off) - 1)
            first = np.r_[0, np.cumsum(spans)]
            view, digests, kept = memoryview(data), [], []
            for i in range(len(off) - 1):
                pieces, at_ = [], off[i]
                for k in range(first[i], first[i + 1]):
                    pieces.append(view[at_:start[k]])
                    at_ = end[k]
                pieces.append(view[at_:off[i + 1]])
                digest = hashlib.sha256()
                for piece in pieces:
                    digest.update(piece)
                digests.append(digest.hexdigest())
                if with_bytes:
                    kept.append(b"".join(pieces))
            arrays = [b.column("id"), pa.array(np.diff(off)), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * with_bytes, names=schema.names)

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_documents(read(spark, sf_dir, "documents"))


SQL = """
WITH t AS (SELECT doc_id, hex(coalesce(text, '')) AS x FROM documents),
b AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS byte,
         CASE WHEN 2 * i + 200 <= length(x) THEN md5(substr(x, 2 * i + 1, 200)) END AS w
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS i FROM t)),
r AS (
  SELECT doc_id, i, byte, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS late FROM b),
g AS (
  SELECT doc_id, i, byte, max(late::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g),
s AS (
  SELECT doc_id, count(*) AS n_bytes, sum(gone)::BIGINT AS n_removed, sum((gone = 1 AND before = 0)::INT)::BIGINT AS n_spans,
         sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), ''))) AS kept_sha256
  FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM t LEFT JOIN s USING (doc_id)
"""
