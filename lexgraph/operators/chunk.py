"""Sentence-respecting word chunks (split unit = word, no overlap).

Packing rule: walk the sentences in order; a new chunk opens when the current
one is non-empty and adding the sentence would exceed ``length`` words; a
longer single sentence is a chunk of its own.  Chunk text is the sentences
joined by one space.  Page = 1 + form feeds before the chunk's first
non-space character.

Everything happens inside one document row (a fold over its sentence array),
so chunking is a narrow transformation: no shuffle, any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgraph.functions.text import SENTENCE_RE, WS, count_char, strip_ws, word_count

CHUNK_COLUMNS = ["chunk_id", "doc_id", "chunk_no", "text", "filename", "page", "n_words"]


def _parts(text_col: str):
    raw = F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE_RE), 0)
    return F.transform(raw, lambda r: F.struct(
        strip_ws(r).alias("s"),
        word_count(r).alias("w"),
        count_char(F.regexp_extract(r, f"^{WS}*", 0), "\f").alias("fl"),
        count_char(r, "\f").alias("ft"),
    ))


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_no, sentence), sent_no from 0."""
    raw = F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE_RE), 0)
    s = F.filter(F.transform(raw, strip_ws), lambda x: x != F.lit(""))
    return docs.select(id_col, F.posexplode(s).alias("sent_no", "sentence"))


def chunk_documents(docs: DataFrame, length: int = 250, language: str | None = None,
                    id_col: str = "doc_id", text_col: str = "text", filename_col: str = "filename") -> DataFrame:
    """``language`` selects the sentence rule and never filters; the one rule
    here serves every language whose sentences end in . ! or ?"""
    if language not in (None, "en", "de", "fr", "es", "nl", "it", "pt"):
        raise ValueError(f"no sentence rule for language {language!r}")
    if filename_col not in docs.columns:
        docs = docs.withColumn(filename_col, F.lit(None).cast("string"))
    L = F.lit(int(length))
    empty = F.array().cast("array<struct<text:string,page:int,n_words:int>>")
    init = F.struct(empty.alias("done"), F.lit("").alias("text"), F.lit(0).alias("page"),
                    F.lit(0).alias("words"), F.lit(0).alias("ff"))

    def close(acc):
        return F.concat(acc["done"], F.array(F.struct(acc["text"].alias("text"), acc["page"].alias("page"),
                                                      acc["words"].alias("n_words"))))

    def step(acc, e):
        # the parts array is consumed once, element by element: the regex work
        # per document stays linear (no re-evaluation inside the lambda)
        open_new = (e["w"] > 0) & ((acc["words"] == 0) | (acc["words"] + e["w"] > L))
        return F.struct(
            F.when(open_new & (acc["words"] > 0), close(acc)).otherwise(acc["done"]).alias("done"),
            F.when(e["w"] == 0, acc["text"]).when(open_new, e["s"])
             .otherwise(F.concat(acc["text"], F.lit(" "), e["s"])).alias("text"),
            F.when(open_new, F.lit(1) + acc["ff"] + e["fl"]).otherwise(acc["page"]).alias("page"),
            F.when(open_new, e["w"]).otherwise(acc["words"] + e["w"]).alias("words"),
            (acc["ff"] + e["ft"]).alias("ff"),
        )

    def finish(acc):
        return F.when(acc["words"] > 0, close(acc)).otherwise(acc["done"])

    fold = F.aggregate(_parts(text_col), init, step, finish)
    out = (docs.select(F.col(id_col).alias("doc_id"), F.col(filename_col).alias("filename"),
                       F.posexplode(fold).alias("chunk_no", "c"))
           .select("doc_id", "chunk_no", "c.text", "filename", "c.page", "c.n_words"))
    out = out.withColumn("chunk_id", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"),
                                                        F.col("chunk_no").cast("string"), F.col("text"))))
    return out.select(*CHUNK_COLUMNS)


def chunk_stats(chunks: DataFrame, docs: DataFrame, by: str = "source") -> DataFrame:
    """Files and chunks per group (the counts the reference logs)."""
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"))
    j = docs.select("doc_id", by).join(c, "doc_id", "left")
    return j.groupBy(by).agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce(F.sum("n_words"), F.lit(0)).cast("long").alias("n_words"),
        F.round(F.coalesce(F.try_divide(F.sum("n_words"), F.sum("n_chunks")), F.lit(0.0)), 6).alias("avg_words"),
    )
