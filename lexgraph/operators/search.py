"""Vector search: top-k retrieval, exact kNN, keyword x text similarity,
nearest points to centres, and batch question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgraph.functions.vector import angle as _angle
from lexgraph.operators.blocks import block_topk
from lexgraph.operators.embed import embed_text

# Fixed value: the rule line closing each question in the answer report.
REPORT_RULE = "=" * 37


def retrieve_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine",
                  q_id: str = "id", c_id: str = "id", **kw) -> DataFrame:
    """(query_id, rank, id, score) against a flat (exact) index."""
    largest = metric != "l2"
    r = block_topk(queries, corpus, k, metric=metric, largest=largest, q_id=q_id, c_id=c_id, **kw)
    return r.select(F.col("qid").alias("query_id"), "rank", F.col("cid").alias("id"), "score")


def knn_graph(emb: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding", **kw) -> DataFrame:
    """Exact cosine kNN of every vector, itself excluded by id:
    (src, rank, dst, angle)."""
    r = block_topk(emb, emb, k, metric="cosine", largest=True, exclude_self=True,
                   q_id=id_col, c_id=id_col, q_vec=vec_col, c_vec=vec_col, **kw)
    return r.select(F.col("qid").alias("src"), "rank", F.col("cid").alias("dst"), _angle("score").alias("angle"))


def kw_text_similarity(kw: DataFrame, emb: DataFrame, **kwargs) -> DataFrame:
    """Full keyword x text cosine matrix as (keyword_id, id, score)."""
    r = block_topk(kw, emb, None, q_id="keyword_id", c_id="id", **kwargs)
    return r.select(F.col("qid").alias("keyword_id"), F.col("cid").alias("id"), "score")


def _none(kw: DataFrame, emb: DataFrame) -> DataFrame:
    kinds = kw.schema["keyword_id"].dataType.simpleString(), emb.schema["id"].dataType.simpleString()
    return kw.sparkSession.createDataFrame([], "keyword_id {}, rank int, id {}, score double".format(*kinds))


def closest(kw: DataFrame, emb: DataFrame, n1: int = 1, **kwargs) -> DataFrame:
    """The n1 most similar texts per keyword: (keyword_id, rank, id, score)."""
    if n1 <= 0:
        return _none(kw, emb)
    r = block_topk(kw, emb, n1, largest=True, q_id="keyword_id", c_id="id", **kwargs)
    return r.select(F.col("qid").alias("keyword_id"), "rank", F.col("cid").alias("id"), "score")


def farthest(kw: DataFrame, emb: DataFrame, n2: int = 1, **kwargs) -> DataFrame:
    """The n2 least similar texts per keyword (n2 = 0 gives no rows)."""
    if n2 <= 0:
        return _none(kw, emb)
    r = block_topk(kw, emb, n2, largest=False, q_id="keyword_id", c_id="id", **kwargs)
    return r.select(F.col("qid").alias("keyword_id"), "rank", F.col("cid").alias("id"), "score")


def nearest_to_center(emb: DataFrame, centers: DataFrame, blocks: int = 5, **kwargs) -> DataFrame:
    """The ``blocks`` points nearest (Euclidean) to each centre, over all
    points: (cluster, rank, id, dist)."""
    r = block_topk(centers, emb, blocks, metric="l2", largest=False, q_id="cluster", c_id="id",
                   q_vec="center", c_vec="embedding", **kwargs)
    return r.select(F.col("qid").alias("cluster"), "rank", F.col("cid").alias("id"), F.col("score").alias("dist"))


def answer_questions(questions: DataFrame, chunks: DataFrame, chunk_emb: DataFrame | None = None,
                     k: int = 10, dim: int = 64, **kw) -> DataFrame:
    """One top-k retrieval per question, with chunk metadata:
    (question_id, question, rank, chunk_id, filename, page, score)."""
    if chunk_emb is None:
        chunk_emb = embed_text(chunks, id_col="chunk_id", dim=dim)
    qv = embed_text(questions, id_col="question_id", text_col="question", dim=dim, corpus=chunks,
                    corpus_text_col="text")
    top = retrieve_topk(qv, chunk_emb, k=k, **kw)
    meta = chunks.select(F.col("chunk_id").alias("id"), "filename", "page")
    return (top.join(meta, "id")
            .join(questions, top["query_id"] == questions["question_id"])
            .select("question_id", "question", "rank", F.col("id").alias("chunk_id"), "filename", "page", "score"))


def answer_report(answers: DataFrame) -> DataFrame:
    """One formatted block per question: ``question: q``, then
    ``i.filename page: p`` with i from 0, the rule line and a blank line."""
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "filename", "page"))),
        lambda s: F.format_string("%d.%s page: %d\n", s["rank"] - 1, s["filename"], s["page"]))
    return (answers.groupBy("question_id", "question")
            .agg(F.concat(F.lit("question: "), F.first("question"), F.lit("\n"), F.array_join(lines, ""),
                          F.lit(REPORT_RULE + "\n\n")).alias("report"))
            .select("question_id", "report"))
