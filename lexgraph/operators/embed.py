"""Hashed TF-IDF embedder (the built-in model) and embedding bookkeeping.

value(bucket) = sum over token occurrences in the bucket of ln((N+1)/(df+1)),
then L2-normalised.  ``df`` and ``N`` always come from the corpus, so queries
and keywords are embedded in the corpus' space (unseen token: df = 0).

Plan: tokens are counted in their row.  The ``HEAD`` commonest words of the
vocabulary, nearly all occurrences of a text, go to the tasks (a top list, so its
size is fixed) and are summed into the row's vector there.  Only the other words
of a row, each once with its count, become rows of a join with the vocabulary; none
of these holds more than one ``HEAD``-th of all occurrences, so the join has no hot
key.  Their sums meet the row's vector in one aggregation by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgraph.functions.rand import hash_bucket
from lexgraph.functions.text import tokens
from lexgraph.session import persist_step

HEAD = 1 << 16  # words whose values go to the tasks


def _toks(text_col: str, max_seq_len: int | None):
    t = tokens(text_col)
    return F.slice(t, 1, int(max_seq_len)) if max_seq_len else t


def corpus_vocab(corpus: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
                 max_seq_len: int | None = None) -> DataFrame:
    """(token, df): number of corpus rows holding the token."""
    return (corpus.select(F.explode(F.array_distinct(_toks(text_col, max_seq_len))).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("df")))


def embed_text(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", dim: int = 64,
               corpus: DataFrame | None = None, corpus_text_col: str | None = None,
               max_seq_len: int | None = None, vocab: DataFrame | None = None,
               n_docs: int | None = None, embedder=None) -> DataFrame:
    """(id, embedding array<double>) for every row of ``df``.

    ``embedder`` (K1 hook) replaces the built-in model: a function
    ``pandas.Series[str] -> pandas.Series[list[float]]`` run as an Arrow-batched
    pandas UDF.
    """
    if embedder is not None:
        from lexgraph.functions.hooks import embedder_udf
        return df.select(F.col(id_col).alias("id"), embedder_udf(embedder, dim)(F.col(text_col)).alias("embedding"))
    if corpus is None:
        if vocab is None or n_docs is None:  # read up to three times: its words, its size, its vectors
            df = persist_step(df.select(*dict.fromkeys([id_col, text_col])))
        corpus = df
    ctext = corpus_text_col or text_col
    if vocab is None:
        vocab = corpus_vocab(corpus, text_col=ctext, max_seq_len=max_seq_len)
    if n_docs is None:
        n_docs = corpus.count()
    # bucket and idf once per distinct token (vocabulary side), not per occurrence
    lnN = F.lit(float(n_docs)) + 1.0
    vw = persist_step(vocab.select("token", "df", hash_bucket("token", dim).alias("vb"), F.log(lnN / (F.col("df") + 1.0)).alias("idf")))
    top = vw.orderBy(F.desc("df"), "token").limit(HEAD).toArrow()  # HEAD rows at most
    shipped = df.sparkSession.sparkContext.broadcast((dict(zip(top["token"].to_pylist(), range(top.num_rows), strict=True)),
                                                      top["vb"].to_numpy().astype(np.int64), top["idf"].to_numpy()))
    counted = persist_step(df.select(F.col(id_col).alias("id"), _head_and_tail(shipped, dim)(F.coalesce(
        _toks(text_col, max_seq_len), F.array().cast("array<string>"))).alias("s")).select("id", "s.*"))
    rare = counted.select("id", F.explode(F.arrays_zip("tail", "tf")).alias("t")).select("id", F.col("t.tail").alias("token"), "t.tf")
    met = rare.join(vw.drop("df"), "token", "left") \
        .select("id", F.coalesce("vb", hash_bucket("token", dim)).alias("b"), (F.col("tf") * F.coalesce("idf", F.log(lnN))).alias("x"))
    rows = counted.select("id", "head", F.lit(None).cast("int").alias("b"), F.lit(None).cast("double").alias("x")) \
        .unionByName(met.select("id", F.lit(None).cast("array<double>").alias("head"), "b", "x"))
    m = rows.groupBy("id").agg(F.first("head", ignorenulls=True).alias("head"), F.collect_list("b").alias("bs"), F.collect_list("x").alias("xs"))
    return m.select("id", _scatter_unit(dim)(F.col("head"), F.col("bs"), F.col("xs")).alias("embedding"))


def _head_and_tail(shipped, dim: int):
    """tokens -> (summed values of the common words by bucket, other words, their counts)."""
    kind = T.StructType([T.StructField("head", T.ArrayType(T.DoubleType())), T.StructField("tail", T.ArrayType(T.StringType())),
                         T.StructField("tf", T.ArrayType(T.IntegerType()))])

    @F.arrow_udf(kind)
    def split(tokens: pa.Array) -> pa.Array:
        place, bucket, idf = shipped.value
        n = len(tokens)
        row = np.repeat(np.arange(n), tokens.value_lengths().to_numpy(zero_copy_only=False))
        flat = tokens.flatten().dictionary_encode()
        words = flat.dictionary
        known = np.fromiter((place.get(w, -1) for w in words.to_pylist()), np.int64, len(words))
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = known[code] if len(code) else code
        M = np.zeros((n, dim))
        common = at >= 0
        np.add.at(M, (row[common], bucket[at[common]]), idf[at[common]])
        key, tf = np.unique(row[~common] * max(len(words), 1) + code[~common], return_counts=True)
        per = np.bincount(key // max(len(words), 1), minlength=n)
        ends = pa.array(np.r_[0, np.cumsum(per)].astype(np.int32))
        tail = words.take(pa.array(key % max(len(words), 1)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(M.ravel())),
                                           pa.ListArray.from_arrays(ends, tail), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))],
                                          names=["head", "tail", "tf"])
    return split


def _scatter_unit(dim: int):
    """(vector, bucket list, value list) -> the vector with the values added, of unit length.

    One numpy scatter per Arrow batch; Spark has no scatter-into-array
    expression (a map lookup per position would scan the list ``dim`` times)."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scatter(head: pa.Array, bs: pa.Array, xs: pa.Array) -> pa.Array:
        n = len(bs)
        lens = bs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        b = bs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        x = xs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = np.repeat(np.arange(n), lens)
        M = head.flatten().to_numpy(zero_copy_only=False).reshape(n, dim).copy()
        np.add.at(M, (rows, b), x)
        nrm = np.sqrt(np.einsum("ij,ij->i", M, M))
        M = np.divide(M, nrm[:, None], out=np.zeros_like(M), where=nrm[:, None] > 0)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(M.ravel()))
    return scatter


def embed_missing(chunks: DataFrame, existing: DataFrame, dim: int = 64, id_col: str = "chunk_id",
                  text_col: str = "text", **kw) -> DataFrame:
    """Embed only the chunks without an embedding (anti join on id); the
    corpus statistics still come from all chunks."""
    todo = chunks.join(existing.select(F.col("id").alias(id_col)), id_col, "left_anti")
    return embed_text(todo, id_col=id_col, text_col=text_col, dim=dim, corpus=chunks, **kw)


def embed_keywords(keywords: DataFrame, chunks: DataFrame, dim: int = 64, id_col: str = "keyword_id",
                   text_col: str = "keyword") -> DataFrame:
    """Keyword vectors in the corpus' space (idf from the chunks)."""
    return embed_text(keywords, id_col=id_col, text_col=text_col, dim=dim, corpus=chunks, corpus_text_col="text")


def check_dim(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """Fail the job on any vector whose size is not ``dim`` (lazy, row-level)."""
    msg = f"embedding dimension differs from {dim}"
    return df.filter(F.assert_true(F.size(col) == F.lit(int(dim)), msg).isNull())


def all_embeddings(chunks: DataFrame, embeddings: DataFrame, dim: int | None = None) -> DataFrame:
    """Chunks that have an embedding, as (id, embedding)."""
    e = embeddings if dim is None else check_dim(embeddings, dim)
    return chunks.select(F.col("chunk_id").alias("id")).join(e, "id", "inner")
