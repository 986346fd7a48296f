"""Line dedup over the whole corpus, in DataFrame functions only.

Every text is cut into lines inside its row.  Lines long enough to count are
represented by a 128-bit hash of their key; texts never travel with them.

1. ``occurrences``: one row per long line: document, position, hash.
2. ``sorted_runs``: the rows are range-partitioned by (hash, document descending)
   and sorted by (hash, document, position) inside a range.  The ranges cut the
   document too, so a hash that a third of all documents hold spreads over many
   of them.  Streaming a range gives, without another exchange, one run per
   hash and document with its positions.  Runs are written with the number of
   their range.
3. The first run of a hash in the order is that of its largest document.  Each
   range tells of its hashes how many documents it holds and the largest; only
   these sums (one row per range and hash, so a few per hash) meet by hash,
   which carries counts and winners across the borders of ranges.
4. What was found returns to the runs by (range, hash): no key of that join has more
   rows than one range.  Losing positions are gathered per document and packed
   as a keep bitmap (one bit a line, the first line highest in the first byte,
   1: it stays; a document that loses nothing has a NULL bitmap).

A document is told by its id and a hash of its text, so repeated rows share
one decision and rows with one id but other texts are not mixed.

Defined cases: rows with one id and different texts count as documents of their own, a NULL id
as one, too; a NULL or empty text is one empty line; a document with a NULL
id loses nothing; among rows with the largest id all keep the line; repeated
rows count as one document; an empty table gives an empty result; other
columns are passed by (``drop_repeated_lines``) or left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.llm.common import BLANKS, ascii_lower, read, stored

MIN_CHARS = 40
MIN_DOCS = 5


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _doc_key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__t")]


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(__id, __t, pos, h1, h2): one row per line whose key has ``min_chars``."""
    lines = docs.select(*_doc_key(id_col, text_col), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line")) \
        .filter(F.char_length("line") >= min_chars)
    keyed = lines.select("__id", "__t", "pos", line_key(F.col("line")).alias("k")).filter(F.char_length("k") >= min_chars)
    return keyed.select("__id", "__t", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"))


def sorted_runs(occ: DataFrame) -> DataFrame:
    """(range, h1, h2, __id, __t, at): positions of each hash in each document, by sorted ranges."""
    by = [F.col("h1"), F.col("h2"), F.col("__id").desc(), F.col("__t")]
    return occ.repartitionByRange(*by).sortWithinPartitions(*by, "pos") \
        .groupBy("h1", "h2", "__id", "__t").agg(F.collect_set("pos").alias("at")).withColumn("range", F.spark_partition_id())


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(__id, __t, dropped array<int>) of the documents that lose lines."""
    # the hashes are written once: choosing the ranges and dealing them out read them, not the texts
    runs = stored(sorted_runs(stored(occurrences(docs, id_col, text_col, min_chars))))
    key = ["h1", "h2"]
    held = stored(runs.groupBy("range", *key).agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("largest")))
    frequent = held.groupBy(*key).agg(F.sum("n").alias("n"), F.max("largest").alias("winner")) \
        .filter(F.col("n") >= min_docs).select(*key, "winner")
    known = held.select("range", *key).join(frequent, key)
    lost = runs.join(known, ["range", *key]).filter(F.col("__id") < F.col("winner"))
    return lost.groupBy("__id", "__t").agg(F.flatten(F.collect_list("at")).alias("dropped"))


def pack_bits(n: Column, dropped: Column) -> Column:
    """Keep bitmap of ``n`` lines: runs of kept lines between sorted dropped
    positions are spelled as a string of 0 and 1, then packed eight to a byte.
    Linear in the lines; NULL when nothing is dropped."""
    d = F.array_sort(dropped)
    gaps = F.zip_with(d, F.concat(F.array(F.lit(-1)), F.slice(d, 1, F.size(d) - 1)),
                      lambda at, before: F.concat(F.repeat(F.lit("1"), at - before - 1), F.lit("0")))
    flags = F.concat(F.array_join(gaps, ""), F.repeat(F.lit("1"), n - 1 - F.element_at(d, -1)))
    padded = F.rpad(flags, F.floor((n + 7) / 8).cast("int") * 8, F.lit("0"))
    bytes_ = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 8).cast("int")),
                         lambda b: F.lpad(F.conv(F.substr(padded, b * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.unhex(F.array_join(bytes_, ""))


def with_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(whole, text, lines, dropped): every row of ``docs`` as a struct, its
    text and lines, and the positions it loses (NULL: none).  The losing
    documents are the build side of the join; texts are only streamed."""
    drops = dropped_positions(docs, id_col, text_col, min_chars, min_docs)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *_doc_key(id_col, text_col))
    return keyed.join(drops.hint("shuffle_hash"), ["__id", "__t"], "left").select(
        "whole", F.col("whole").getField(text_col).alias("text"),
        lines_of(F.col("whole").getField(text_col)).alias("lines"), "dropped")


def kept_text(lines: Column, dropped: Column, text: Column) -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    joined = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(joined)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256, keep_bitmap), one row per document,
    without its text; the hash tells a reader that it applied the bitmap right."""
    d = with_dropped(docs.select(id_col, text_col), id_col, text_col, **limits)
    n, dropped = F.size("lines"), F.col("dropped")
    return d.select(F.col("whole").getField(id_col).alias(id_col), n.cast("long").alias("n_lines"),
                    F.when(dropped.isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
                    F.sha2(kept_text(F.col("lines"), dropped, F.col("text")), 256).alias("kept_sha256"),
                    F.when(dropped.isNotNull(), pack_bits(n, dropped)).alias("keep_bitmap"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with the losing lines cut out of the text; texts that lose
    nothing stay as they are (NULL stays NULL)."""
    d = with_dropped(docs, id_col, text_col, **limits)
    new = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept_text(F.col("lines"), F.col("dropped"), F.col("text")))
    return d.select(F.col("whole").withField(text_col, new).alias("whole")).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = keep_bitmaps(read(spark, sf_dir, "documents"))
    return out.withColumn("keep_bitmap", F.hex("keep_bitmap"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS winner FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.doc_id, pos, line, coalesce(keyed.doc_id < winner, false) AS lost
  FROM keyed LEFT JOIN frequent USING (k)),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256,
         rpad(string_agg(CASE WHEN lost THEN '0' ELSE '1' END, '' ORDER BY pos), (8 * ((count(*) + 7) // 8))::INT, '0') AS bits
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, kept_sha256,
       CASE WHEN n_dropped > 0 THEN array_to_string(list_transform(range(0, length(bits) // 4), lambda i:
         substr('0123456789ABCDEF', 1 + 8 * substr(bits, 4 * i + 1, 1)::INT + 4 * substr(bits, 4 * i + 2, 1)::INT
                                      + 2 * substr(bits, 4 * i + 3, 1)::INT + substr(bits, 4 * i + 4, 1)::INT, 1)), '') END AS keep_bitmap
FROM per
"""
