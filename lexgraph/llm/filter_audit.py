"""Filter interaction audit: what every order of the filters keeps and drops.

Five filters say of each document whether it fails.  A document that fails the
set F survives a subset S of the filters where S and F share none, so its 32
answers make one 32-bit word (bit S: it survives S).  Words are counted by
position: carry-save adders turn three words of one weight into a sum word and
a carry word of twice the weight until two of each weight are left, and only
those are read bit by bit.  One array of 32 counts for each (part, quality, toxic)
is all that leaves a task; every figure of every order is a difference of such counts.

Filter E (identical to a smaller id's text) needs the smallest id of each text.
Texts do not travel: rows of some 50 bytes are first counted per text hash (128
bits), part and label, with the smallest id and how many rows have it, so that a
text that a third of all rows hold is a few rows before it is shuffled; then
the smallest id of the text decides which counts fail.  A word that many
documents share enters the adders once for each bit of that number.

Defined cases: a NULL text is empty, and equal to other empty ones; a NULL part
counts as the empty string; a NULL id is neither smaller nor larger than another,
so its row never fails E; rows with one id and one text (repeated rows) do not
fail E by each other; a document is good or toxic if any label row of its id says
1; documents without labels are neither; an empty table gives no rows; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgraph.llm.common import UPPER, read

LETTERS = "ABCDE"
SUBSETS = 1 << len(LETTERS)
MIN_WORDS = 200
WORDS = r"[^\x20\x09-\x0D]+"


def _fails_text(text: Column) -> list[Column]:
    """Failure of A to D, each from the whole text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(words)
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < 50 * n,
            100 * upper > 3 * F.char_length(text), text.rlike(r"[#$%&*|]")]


def survival_word(mask: Column) -> Column:
    """The 32-bit word (as a long) of a document that fails the filters in ``mask``."""
    words = [sum(1 << s for s in range(SUBSETS) if not s & f) for f in range(SUBSETS)]
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in words]), mask + 1)


def words_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "lang") -> DataFrame:
    """(part, good, toxic, word, n): survival words and how many documents have them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(_fails_text(F.col("t")))), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t")) \
        .select("id", "part", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit("text"), "t").alias("h2"), mask.alias("mask"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")) \
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    none = F.lit(0)
    known = rows.join(marks, "id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    text_of, kind = ["h1", "h2"], ["mask", "part", "good", "toxic"]
    per_id = known.groupBy(*text_of, *kind, "id").agg(F.count(F.lit(1)).alias("c"))  # repeated rows
    counted = per_id.groupBy(*text_of, *kind).agg(
        F.sum("c").alias("n"), F.min("id").alias("least"), F.coalesce(F.min_by("c", "id"), none).alias("of_least"),
        F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("of_none"))
    first = F.min("least").over(Window.partitionBy(*text_of))  # at most a row per part and label in each
    passing = F.col("of_none") + F.when(F.col("least") == F.col("first"), F.col("of_least")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), passing.alias("n")),
                   F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - passing).alias("n")))
    return counted.withColumn("first", first).select("part", "good", "toxic", F.explode(both).alias("x")).filter("x.n > 0") \
        .select("part", "good", "toxic", survival_word(F.col("x.mask")).alias("word"), "x.n") \
        .groupBy("part", "good", "toxic", "word").agg(F.sum("n").alias("n"))


def positional_counts(words: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """How often the 32-bit ``words`` have each bit set, by carry-save adders; a word
    that counts ``times`` enters at the weight of each bit of that number."""
    counts = np.zeros(SUBSETS, np.int64)
    words = words.astype(np.uint32, copy=False)
    times = np.ones(len(words), np.int64) if times is None else times
    weight, now = 1, words[:0]
    while len(now) or (times >= weight).any():
        now = np.concatenate([now, words[times & weight > 0]])
        carried = [words[:0]]
        while len(now) >= 3:
            k = len(now) // 3
            a, b, c = now[:k], now[k:2 * k], now[2 * k:3 * k]
            carried.append((a & b) | (c & (a ^ b)))
            now = np.concatenate([a ^ b ^ c, now[3 * k:]])
        for word in now:
            counts += weight * ((int(word) >> np.arange(SUBSETS)) & 1)
        weight, now = 2 * weight, np.concatenate(carried)
    return counts


def survivors(words: DataFrame) -> DataFrame:
    """(part, good, toxic, kept array<long>[32]): survivors of each subset."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column("part").dictionary_encode()
            label = 2 * b.column("good").to_numpy() + b.column("toxic").to_numpy()
            key = parts.indices.to_numpy().astype(np.int64) * 4 + label
            word = b.column("word").to_numpy().astype(np.uint32)
            order = np.argsort(key, kind="stable")
            keys, starts = np.unique(key[order], return_index=True)
            times = b.column("n").to_numpy()[order]
            counts = [positional_counts(x, n) for x, n in zip(np.split(word[order], starts[1:]), np.split(times, starts[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [parts.dictionary.take(pa.array(keys // 4)).cast(pa.string()), pa.array(keys % 4 // 2, pa.int32()), pa.array(keys % 2, pa.int32()),
                 pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))], names=["part", "good", "toxic", "kept"])

    counted = words.mapInArrow(run, "part string, good int, toxic int, kept array<long>")
    sums = counted.groupBy("part", "good", "toxic").agg(*[F.sum(F.get("kept", F.lit(s))).alias(f"k{s}") for s in range(SUBSETS)])
    return sums.select("part", "good", "toxic", F.array(*[f"k{s}" for s in range(SUBSETS)]).alias("kept"))


def _steps() -> Column:
    """The 600 steps of all orders, as an array of structs of constants."""
    steps = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(LETTERS[i] for i in order), "step": k + 1, "f": f, "before": before, "after": before | 1 << f})
            before |= 1 << f
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, f int, before int, after int>>")


def _shapley_weights(f: int) -> list[int]:
    """Of each subset's survivors in the sum, over all orders, of what filter ``f`` removes."""
    out = [0] * SUBSETS
    for s in range(SUBSETS):
        if not s >> f & 1:
            before = s.bit_count()
            w = factorial(before) * factorial(len(LETTERS) - 1 - before)
            out[s] += w
            out[s | 1 << f] -= w
    return out


def audit(docs: DataFrame, labels: DataFrame, **cols) -> DataFrame:
    """One row per part, order and step; see the module's head and ``query``."""
    s = survivors(words_of(docs, labels, **cols))
    pick = lambda c: [F.sum(F.when(c, F.get("kept", F.lit(i))).otherwise(0)).alias(f"k{i}") for i in range(SUBSETS)]
    kinds = {"every": F.lit(True), "good_": F.col("good") == 1, "toxic_": F.col("toxic") == 1}
    per = s.groupBy("part").agg(*[x.alias(f"{name}{i}") for name, c in kinds.items() for i, x in enumerate(pick(c))])
    per = per.select("part", *[F.array(*[f"{name}{i}" for i in range(SUBSETS)]).alias(name) for name in kinds])
    shapley = F.array(*[sum((F.get("every", F.lit(i)) * w for i, w in enumerate(_shapley_weights(f)) if w), F.lit(0)) for f in range(len(LETTERS))])
    full = SUBSETS - 1
    bit = [1 << f for f in range(len(LETTERS))]
    failing = F.array(*[F.get("every", F.lit(0)) - F.get("every", F.lit(b)) for b in bit])
    alone = F.array(*[F.get("every", F.lit(full ^ b)) - F.get("every", F.lit(full)) for b in bit])
    rows = per.withColumns({"shapley": shapley, "failing": failing, "alone": alone}) \
        .select("*", F.explode(_steps()).alias("at")).select("*", "at.*")
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return rows.select(
        "part", "filter_order", "step", F.get("every", F.col("after")).alias("kept"), lost("every").alias("removed"),
        (F.get("failing", F.col("f")) - lost("every")).alias("redundant"), F.get("alone", F.col("f")).alias("unique_fails"),
        lost("good_").alias("good_lost"), lost("toxic_").alias("toxic_lost"), F.get("shapley", F.col("f")).alias("shapley"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN w.doc_id > first THEN 'E' ELSE '' END) AS f
  FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id),
kinds AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT o, s, substr(o, s, 1) AS letter, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) r(s)),
hits AS (
  SELECT k.*, o, s, letter, contains(f, letter) AS fails,
         f <> translate(f, before, '') AS gone
  FROM kinds k, steps),
out AS (
  SELECT part, o AS filter_order, s AS step, letter,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f = letter THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM hits GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM out
"""
