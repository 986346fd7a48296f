"""Benchmark decontamination in DataFrame functions only.

A window is ``n`` consecutive item words; an item of fewer words, but not
none, is one window.  A document word inside any occurrence of a window is hit.

Every window holds exactly one anchor of its item: anchors are short word
n-grams at item positions a fixed step apart, chosen so that any ``n``
consecutive words contain one whole.  The set of anchor hashes is the
broadcast hash set (its size is counted first; above ``max_broadcast`` anchors
Spark joins by shuffle instead, with the same result).  The scan hashes every
n-gram of a document, keeps the positions found in the set, and verifies them
in the joined row: matched words are counted to the left and right of the
anchor, word by word, so a hash collision changes nothing.  A match of at least
a window gives one span.  Texts are scanned once and never shuffled; only
spans are grouped per document.

Defined cases: NULL texts, and texts and items without a word, match nothing;
repeated rows are separate documents (each is told by a row number of the
scan); repeated item ids are one item; an empty benchmark leaves every document
clean; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.llm.common import ascii_lower, read, stored

WINDOW = 10
GRAM = 3
MAX_BROADCAST = 2_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def anchors(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
            gram: int = GRAM) -> DataFrame:
    """(item, iw, a, g, need): item words, anchor position, anchor length and
    the words a match must have.  Steps of ``window - gram + 1`` put exactly
    one anchor into every window."""
    step = window - gram + 1
    items = bench.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("iw")) \
        .withColumn("m", F.size("iw")).filter(F.col("m") > 0).distinct()
    long = items.filter(F.col("m") >= window) \
        .withColumn("a", F.explode(F.sequence(F.lit(step - 1), F.col("m") - gram, F.lit(step)))) \
        .withColumns({"g": F.lit(gram), "need": F.lit(window)})
    short = items.filter(F.col("m") < window) \
        .withColumns({"a": F.lit(0), "g": F.least(F.lit(gram), F.col("m")), "need": F.col("m")})
    return long.unionByName(short).drop("m")


def gram_hash(words: Column, at: Column, g: int) -> Column:
    return F.xxhash64(F.lit(g), *[F.get(words, at + j) for j in range(g)])


def _matched(w: Column, p: Column, iw: Column, a: Column, first: Column, last: Column, step: int) -> Column:
    """Equal words in a row at item positions first, first + step, ..., last."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def merge(acc, i):
        same = acc["on"] & F.coalesce((p + i - a >= 0) & (F.get(w, p + i - a) == F.get(iw, i)), F.lit(False))
        return F.struct((acc["n"] + same.cast("int")).alias("n"), same.alias("on"))

    places = F.when((first <= last) if step > 0 else (first >= last), F.sequence(first, last, F.lit(step))) \
        .otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, merge)["n"]


def spans(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          gram: int = GRAM, item_id: str = "item_id", item_text: str = "text",
          max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(row, doc, t, n_words, spans array<(lo, hi)>, items array): one row per
    document row; ``hi`` is exclusive, ``t`` the xxhash64 of the text."""
    found = anchors(bench, item_id, item_text, window, gram)
    sizes = {r["g"]: r["count"] for r in found.groupBy("g").count().collect()}  # at most ``gram`` rows
    lengths = sorted(sizes) or [gram]
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"),
                        F.xxhash64(F.col(text_col)).alias("t"), words_of(F.col(text_col)).alias("w"))

    def keys(g):
        at = F.when(F.size("w") >= g, F.sequence(F.lit(0), F.size("w") - g)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("p"), gram_hash(F.col("w"), i, g).alias("key")))

    # place -1 stands for the document itself, so that clean documents stay in the result
    own = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("long").alias("key")))
    scan = words.select("row", "doc", "t", "w", F.inline(F.concat(own, *[keys(g) for g in lengths])))
    hashed = F.coalesce(*[F.when(F.col("g") == g, gram_hash(F.col("iw"), F.col("a"), g)) for g in lengths])
    table = found.select("item", "iw", "a", "need", hashed.alias("key"))
    if sum(sizes.values()) <= max_broadcast:
        table = F.broadcast(table)
    hits = scan.join(table, "key", "left").filter((F.col("p") < 0) | F.col("iw").isNotNull())
    step = window - gram + 1
    w, p, iw, a = F.col("w"), F.col("p"), F.col("iw"), F.col("a")
    left = _matched(w, p, iw, a, a - 1, F.greatest(a - step + 1, F.lit(0)), -1)
    right = _matched(w, p, iw, a, a, F.least(a + window - 1, F.size(iw) - 1), 1)
    spanned = hits.select("row", "doc", "t", F.when(p < 0, F.size(w)).alias("n_words"), "item", p, "need",
                          F.when(p >= 0, left).alias("l"), F.when(p >= 0, right).alias("r"))
    real = F.col("l") + F.col("r") >= F.col("need")
    span = F.when(real, F.struct((F.col("p") - F.col("l")).alias("lo"), (F.col("p") + F.col("r")).alias("hi")))
    return spanned.groupBy("row", "doc", "t").agg(
        F.max("n_words").alias("n_words"), F.collect_set(span).alias("spans"),
        F.collect_set(F.when(real, F.col("item"))).alias("items"))


def covered(spans_col: Column) -> Column:
    """Positions inside any span, each once."""
    return F.array_distinct(F.flatten(F.transform(spans_col, lambda s: F.sequence(s["lo"], s["hi"] - 1))))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated), one row per document row."""
    s = spans(docs, bench, id_col, **options)
    return s.select(F.col("doc").alias(id_col), F.col("n_words").cast("long").alias("n_words"),
                    F.size(covered(F.col("spans"))).cast("long").alias("n_hit"),
                    F.size("items").cast("long").alias("n_items"), "items",
                    (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", id_col: str = "doc_id",
                  text_col: str = "text", max_broadcast: int = MAX_BROADCAST, **options) -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``)
    with the hit words cut out: the words that stay, lower-cased and joined by
    one space; clean texts stay as they are.  The hit documents are written
    first; texts are only streamed past them while they are few enough."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    s = spans(docs, bench, id_col, text_col, max_broadcast=max_broadcast, **options)
    hit = stored(s.filter(F.size("spans") > 0).select("doc", "t", "spans").dropDuplicates(["doc", "t"]))
    few = hit.count() <= max_broadcast
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    text = F.col("whole").getField(text_col)
    same = whole["whole"].getField(id_col).eqNullSafe(hit["doc"]) & (F.xxhash64(text) == hit["t"])
    if remove == "documents":
        only = hit.select("doc", "t")
        same = whole["whole"].getField(id_col).eqNullSafe(only["doc"]) & (F.xxhash64(text) == only["t"])
        return whole.join(F.broadcast(only) if few else only, same, "left_anti").select("whole.*")
    joined = whole.join(F.broadcast(hit) if few else hit, same, "left")
    words = words_of(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), covered(F.col("spans")))
    cut = F.array_join(F.transform(stay, lambda i: F.get(words, i)), " ")
    new = F.when(F.col("spans").isNull(), text).otherwise(cut)
    return joined.select(F.col("whole").withField(text_col, new).alias("whole")).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return c.select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(k) AS n, array_to_string(k, ' ') AS key FROM (
    SELECT item_id, w[i:i + least(len(w), 10) - 1] AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (
  SELECT p.doc_id, p.i, k.n, k.item_id
  FROM (SELECT DISTINCT n FROM windows) s, places p, windows k
  WHERE p.i + s.n - 1 <= len(p.w) AND k.n = s.n AND array_to_string(p.w[p.i:p.i + s.n - 1], ' ') = k.key),
words AS (SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
