"""Ranked lexical search: the best documents of every item, exactly, by MaxScore
with bounds of term pairs.

1. ``index_blocks``: documents become blocks where they lie (no shuffle); a block
   holds, for the terms of the items only, posting lists of (local document, tf),
   and the counts that the statistics need.  Blocks are written once.
2. N, L and each term's document frequency are sums over the blocks; only the
   last has a row per term of the items.
3. ``_Block``: with these the integer impact of every posting is known, so each
   term's largest impact in the block and, for the pairs that the items' common
   terms form, the intersection list's largest joint impact.
4. ``_Block.search``: the terms of an item, common ones as pairs, are added up from the
   smallest bound; as long as the sum stays below the item's 20th best score so
   far, documents that hold only those are never looked at.  A pair's bound is
   what one document can get from both, which is less than the sum of both
   maxima when the best documents of the two differ, so more units are skipped.
   What is left is scored, and dropped as soon as score and remaining bound fall
   short.  A block whose whole bound falls short is skipped.
5. Each task returns at most 20 rows per item; a window ranks them.

Items are taken in passes of at most ``ITEMS`` rows or ``ITEM_BYTES``, which bounds what is
broadcast; every pass reads all documents.

Defined cases: a NULL text, or one without terms, gives no rows as an item and no
match as a document; every item row is ranked by itself, also rows of one
item_id; repeated document rows are ranked each; a NULL doc_id comes after the
others of its score; empty tables give an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgraph.llm.common import chunks_of, read, stored

TOP = 20
ITEMS, ITEM_BYTES = 4096, 16 << 20
BLOCK_DOCS, BLOCK_BYTES = 4096, 16 << 20
# A-Z lower-cased, other ASCII but letters and digits blank; bytes of other characters stay
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Items:
    """The items of one pass: their terms, numbered from the commonest in the
    items, and the pairs of terms that get a joint bound."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        counts = [Counter(terms_of(r[1])) for r in rows]
        held = Counter(t for c in counts for t in c)
        self.vocabulary = {t: i for i, t in enumerate(sorted(held, key=lambda t: (-held[t], t)))}
        self.queries = [{self.vocabulary[t]: n for t, n in c.items()} for c in counts]

    def weighed(self, n_docs: int, df: dict[int, int]) -> None:
        """Sets the weights, and the pairs: neighbours of an item's terms in order of weight."""
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)
        self.plans, pairs = [], set()
        for q in self.queries:
            terms = sorted((t for t in q if df.get(t)), key=lambda t: (self.weight[t], t))
            plan = [tuple(sorted(terms[k:k + 2])) for k in range(0, len(terms), 2)]
            pairs.update(p for p in plan if len(p) == 2)
            self.plans.append(plan)
        self.pairs = sorted(pairs)


def index_blocks(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block: ids in order, terms of each document, and the posting
    lists of ``vocabulary`` (term, document frequency; documents and tfs as packed integers)."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), *T.StructType.fromDDL(
        "lens binary, holding long, total long, terms array<int>, df array<int>, at binary, tf binary").fields])
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of at most ITEM_BYTES of items

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        get = shipped.value.get
        for b in chunks_of(batches, BLOCK_DOCS, text_col, BLOCK_BYTES):
            b = b.take(pc.sort_indices(b.column(id_col)))  # NULL ids last
            lens, found = np.zeros(b.num_rows, np.int64), []
            for i, text in enumerate(b.column(text_col).to_pylist()):
                terms = terms_of(text)
                lens[i] = len(terms)
                ids = np.fromiter(map(get, terms, repeat(-1)), np.int64, len(terms))
                ids, tf = np.unique(ids, return_counts=True)
                k = int(len(ids) > 0 and ids[0] < 0)
                found.append((ids[k:], tf[k:]))
            term = np.concatenate([f[0] for f in found])
            at = np.repeat(np.arange(b.num_rows), [len(f[0]) for f in found])
            tf = np.concatenate([f[1] for f in found])
            order = np.argsort(term, kind="stable")
            held, df = np.unique(term, return_counts=True)
            arrays = [pa.array([b.column(id_col).to_pylist()], pa.list_(b.schema.field(id_col).type)), pa.array([lens.astype("<i4").tobytes()]),
                      pa.array([int((lens > 0).sum())], pa.int64()), pa.array([int(lens.sum())], pa.int64()),
                      pa.array([held.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int32())),
                      pa.array([at[order].astype("<u2").tobytes()]), pa.array([tf[order].astype("<i4").tobytes()])]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class _Block:
    def __init__(self, items: Items, n_docs: int, n_terms: int, ids, lens, terms, df, at, tf):
        self.ids, self.items = ids, items
        m = 75 + 25 * lens.astype(np.int64) * n_docs // n_terms
        ends = np.cumsum(df)
        self.at, self.n = at.astype(np.int64), len(lens)
        tf = tf.astype(np.int64)
        self.impact = np.repeat(items.weight[terms], df) * (1_000_000_000 * tf // (1000 * tf + 12 * m[self.at]))
        self.span = {t: slice(e - n, e) for t, e, n in zip(terms.tolist(), ends.tolist(), df.tolist(), strict=True)}
        self.most = {t: int(self.impact[s].max()) for t, s in self.span.items()}
        self.joint = self._joint_maxima()

    def _joint_maxima(self) -> dict:
        """Of each pair of the items: the most that one document gets from both terms."""
        out, dense, last = {}, np.zeros(self.n, np.int64), None
        for a, b in self.items.pairs:
            if a not in self.span or b not in self.span:
                continue
            if a != last:
                if last is not None:
                    dense[self.at[self.span[last]]] = 0
                dense[self.at[self.span[a]]] = self.impact[self.span[a]]
                last = a
            first = dense[self.at[self.span[b]]]
            both = first > 0
            joint = int((first[both] + self.impact[self.span[b]][both]).max()) if both.any() else 0
            out[a, b] = max(joint, self.most[a], self.most[b])
        return out

    def _bound(self, unit: tuple, times: dict) -> int:
        own = [(t, times[t]) for t in unit if t in self.span]
        if len(own) == 2:
            (a, x), (b, y) = own
            low = min(x, y)
            return low * self.joint[a, b] + (x - low) * self.most[a] + (y - low) * self.most[b]
        return sum(n * self.most[t] for t, n in own)

    def search(self, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(local documents, scores) of all documents that score ``least`` (1 or more) or more."""
        times = self.items.queries[q]
        units = sorted((x, u) for u in self.items.plans[q] if (x := self._bound(u, times)) > 0)
        rest, skipped = 0, 0
        while skipped < len(units) and rest + units[skipped][0] < least:
            rest += units[skipped][0]
            skipped += 1
        score = np.zeros(self.n, np.int64)
        if skipped == len(units):
            return np.zeros(0, np.int64), score[:0]
        for _, unit in units[skipped:]:
            for t in unit:
                if t in self.span:
                    score[self.at[self.span[t]]] += times[t] * self.impact[self.span[t]]
        found = np.flatnonzero((score > 0) & (score + rest >= least))
        for bound, unit in reversed(units[:skipped]):
            if not len(found):
                break
            for t in unit:
                if t in self.span:
                    at, s = self.at[self.span[t]], self.span[t]
                    k = np.minimum(np.searchsorted(at, found), len(at) - 1)
                    hit = at[k] == found
                    score[found[hit]] += times[t] * self.impact[s][k[hit]]
            rest -= bound
            found = found[score[found] + rest >= least]
        return found, score[found]


def _search(blocks: DataFrame, items: Items, n_docs: int, n_terms: int, id_type: T.DataType, item_type: T.DataType, top: int) -> DataFrame:
    shipped = blocks.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", item_type), T.StructField("doc_id", id_type),
                           T.StructField("score", T.LongType())])

    def run(batches):
        import pyarrow as pa
        items, best = shipped.value, {}
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r]  # noqa: E731, B023
                block = _Block(items, n_docs, n_terms, get("ids").values, *(np.frombuffer(get("lens").as_py(), "<i4"),
                               *(get(c).values.to_numpy() for c in ("terms", "df")), np.frombuffer(get("at").as_py(), "<u2"),
                               np.frombuffer(get("tf").as_py(), "<i4")))
                for q in range(len(items.ids)):
                    kept = best.get(q, [])
                    at, score = block.search(q, -kept[-1][0] if len(kept) == top else 1)
                    if len(at):
                        order = np.lexsort((at, -score))[:top]  # local documents are in order of their ids
                        new = [(-int(score[k]), i is None, i) for k in order for i in (block.ids[int(at[k])].as_py(),)]
                        best[q] = sorted(kept + new, key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:top]
        rows = [(q, items.ids[q], x[2], -x[0]) for q, xs in best.items() for x in xs]
        if rows:
            kinds = _arrow_types(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=schema.names)

    found = blocks.select("ids", "lens", "terms", "df", "at", "tf").mapInArrow(run, schema)
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _arrow_types(schema: T.StructType) -> list:
    from pyspark.sql.pandas.types import to_arrow_type
    return [to_arrow_type(f.dataType) for f in schema.fields]


def _passes(items: DataFrame, item_col: str, text_col: str):
    rows, size = [], 0
    for r in items.select(item_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        if rows and (len(rows) == ITEMS or size + len(r[1]) > ITEM_BYTES):
            yield Items(rows)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1])
    yield Items(rows)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item row."""
    spark, out = docs.sparkSession, None
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    for p in _passes(items, item_col, item_text_col):
        blocks = stored(index_blocks(docs, p.vocabulary, id_col, text_col))
        n_docs, n_terms = blocks.agg(F.sum("holding"), F.sum("total")).first()
        if not n_docs or not p.vocabulary:
            part = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                                                           T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))
        else:
            df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df"))
            p.weighed(n_docs, {r[0]: r[1] for r in df.collect()})  # a row per term of the pass
            part = _search(blocks, p, n_docs, n_terms, id_type, item_type, top)
        out = part if out is None else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
q AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
p AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
i AS (
  SELECT p.doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))) AS impact
  FROM p JOIN w USING (term), s),
scored AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
