"""Exact pairwise vector work on packed blocks.

Both sides are hashed into blocks and packed into one row per block (ids +
flattened vector).  Every block of one side meets every block of the other
through an *equi-join on both block numbers* (the block-matrix-multiply
pattern), so one task sees exactly one pair of bounded blocks.  A side has at
most ``_grid`` blocks while these fit ``BLOCK_VALUES`` numbers each, so what is
moved grows with the rows and not with their square.  The task takes numpy
products of tiles and keeps a partial top-k per query row; a final
``row_number`` window (planned by Catalyst as WindowGroupLimit, partial before
the shuffle) merges them.  The partial top-k per block is exact: the global
top-k of a row is contained in the union of its per-block top-k.

Memory per task: two blocks, one tile of scores and the candidates of its rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_DIGITS = 12
BLOCK_VALUES = 1 << 22   # numbers in a block at most: 32 MB as doubles
TILE_ROWS, TILE_COLS = 256, 2048


def _pack(df: DataFrame, id_col: str, vec_col: str, n_blocks: int) -> DataFrame:
    b = df.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(int(n_blocks))).cast("int").alias("blk"),
                  F.col(id_col).alias("id"), numbers(df, vec_col).alias("v"))
    return (b.groupBy("blk").agg(F.collect_list(F.struct("id", "v")).alias("r"))
            .select("blk", F.transform("r", lambda x: x["id"]).alias("ids"),
                    F.flatten(F.transform("r", lambda x: x["v"])).alias("vec")))


def numbers(df: DataFrame, vec_col: str):
    """The vector column as it is moved: floats stay floats (half the bytes), all else is double."""
    kind = df.schema[vec_col].dataType.simpleString()
    return F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")


def _grid(spark) -> int:
    """Blocks of a side at most, while they are small enough: some pairs of blocks for each core."""
    return max(16, math.isqrt(4 * spark.sparkContext.defaultParallelism) + 1)


def _blocks_for(n: int, block_rows: int, dim: int | None = None, grid: int | None = None) -> int:
    """Blocks of about ``block_rows`` rows; of more rows than that where there would be more than ``grid`` of them."""
    least = max(1, math.ceil(n / max(1, block_rows)))
    if grid is None:
        return least
    most_rows = max(block_rows, BLOCK_VALUES // max(1, dim or 1))
    return max(min(least, grid), math.ceil(n / most_rows))


def block_pairs(left: DataFrame, right: DataFrame, n_left: int, n_right: int, a: str, b: str, half: bool = False) -> DataFrame:
    """Each row of ``left`` (one per number ``a``) beside each of ``right`` (one per ``b``);
    with ``half`` only a <= b.  Both are dealt out by both numbers, so pairs are spread evenly.
    A side of one block is sent to the tasks as that block: a copy of it for each of the other
    side's blocks would look as small to the planner, and go through the driver whole."""
    if n_left == 1 and n_right == 1:
        return left.join(right.withColumn(a, F.lit(0)).hint("merge"), a)
    if n_left == 1:
        return right.withColumn(a, F.lit(0)).join(F.broadcast(left), a)
    if n_right == 1 and not half:
        return left.withColumn(b, F.lit(0)).join(F.broadcast(right), b)
    x = left.withColumn(b, F.explode(F.sequence(F.col(a) if half else F.lit(0), F.lit(n_right - 1))))
    y = right.withColumn(a, F.explode(F.sequence(F.lit(0), F.col(b) if half else F.lit(n_left - 1))))
    return x.join(y.hint("merge"), [a, b])


def _unit(X):
    n = np.linalg.norm(X, axis=1)
    return np.divide(X, n[:, None], out=np.zeros_like(X), where=n[:, None] > 0)


def _codes(qids, cids):
    """Ids of both sides as numpy arrays that compare fast, or None where none is on both."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if not pc.any(pc.is_in(qids, value_set=cids)).as_py():
        return None
    if pa.types.is_integer(qids.type):
        return qids.to_numpy(zero_copy_only=False), cids.to_numpy(zero_copy_only=False)
    both = pc.fill_null(pa.concat_arrays([qids, cids.cast(qids.type)]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    return both[:len(qids)], both[len(qids):]


def _kernel(k, metric, largest, exclude_self):
    """Per pair of blocks: the k best of each query row (all, if k is None).  ``S`` is the
    score with the sign that makes larger better (l2: of the square); what is within rounding of the k-th
    of the first tile is a candidate, and candidates are ranked by the rounded score."""
    import pyarrow as pa
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(metric)
    sign = 1.0 if largest else -1.0

    def choose(rows, cols, score, idrank):
        key = -sign * np.round(score, RANK_DIGITS)
        order = np.lexsort((idrank[cols], key, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
        pos = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        keep = pos < k
        return rows[keep], cols[keep], score[keep]

    def tiles(Q, C, codes, r0):
        """(rows, cols, score) of the candidates of the query rows from ``r0`` on, by column tile."""
        q = Q[r0:r0 + TILE_ROWS]
        q2 = np.einsum("ij,ij->i", q, q)[:, None] if metric == "l2" else None
        lowest = np.finfo(np.float64).min    # -inf: no candidate
        least = None
        for c0 in range(0, len(C), TILE_COLS):
            c = C[c0:c0 + TILE_COLS]
            S = q @ c.T
            if metric == "l2":
                S = np.maximum(q2 + np.einsum("ij,ij->i", c, c)[None, :] - 2.0 * S, 0.0)
            S *= sign
            if not np.isfinite(S.sum()):
                S[~np.isfinite(S)] = -np.inf
            if codes is not None:
                S[codes[0][r0:r0 + TILE_ROWS, None] == codes[1][None, c0:c0 + TILE_COLS]] = -np.inf
            if least is None and k is not None and k < S.shape[1]:
                kth = np.partition(S, S.shape[1] - k, axis=1)[:, S.shape[1] - k]
                size = np.where(np.isfinite(kth), np.abs(kth), 0.0)
                least = np.maximum(kth - 4 * 10.0 ** -RANK_DIGITS * (1.0 + size), lowest)[:, None]
            rows, cols = np.nonzero(S >= (lowest if least is None else least))
            score = sign * S[rows, cols]
            yield rows + r0, cols + c0, np.sqrt(score) if metric == "l2" else score

    def run(batches):
        for rb in batches:
            for r in range(rb.num_rows):
                qa, ca = rb.column("qids")[r].values, rb.column("cids")[r].values
                if len(qa) == 0 or len(ca) == 0:
                    continue
                qids, cids = qa.to_numpy(zero_copy_only=False), ca.to_numpy(zero_copy_only=False)
                Q = rb.column("qvec")[r].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(qids), -1)
                C = rb.column("cvec")[r].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cids), -1)
                A, B = (_unit(Q), _unit(C)) if metric == "cosine" else (Q, C)
                codes = _codes(qa, ca) if exclude_self else None
                idrank = np.argsort(np.argsort(cids, kind="stable"), kind="stable") if k is not None else None
                for r0 in range(0, len(qids), TILE_ROWS):
                    found = tiles(A, B, codes, r0)
                    if k is not None:
                        rows, cols, score = (np.concatenate(x) for x in zip(*found))
                        found = [choose(rows, cols, score, idrank)] if len(rows) else []
                    for rows, cols, kept in found:
                        if not len(rows):
                            continue
                        if metric == "l2":   # q^2 + c^2 - 2qc cancels for long vectors; it only shortlists
                            kept = np.sqrt(np.square(Q[rows] - C[cols]).sum(axis=1))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(qids[rows]), pa.array(cids[cols]), pa.array(kept, type=pa.float64())],
                            names=["qid", "cid", "score"])
    return run


def _size(df: DataFrame, vec_col: str, n: int | None = None) -> tuple[int, int]:
    """(rows, longest vector)."""
    if n is None:
        n, dim = df.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    else:
        dim = df.agg(F.max(F.size(vec_col))).first()[0]
    return n, dim or 0


def block_topk(queries: DataFrame, corpus: DataFrame, k: int | None, metric: str = "cosine",
               largest: bool = True, exclude_self: bool = False, q_id: str = "id", c_id: str = "id",
               q_vec: str = "embedding", c_vec: str = "embedding", block_rows: int = 2048,
               n_queries: int | None = None, n_corpus: int | None = None) -> DataFrame:
    """(qid, cid, score, rank): the ``k`` best corpus rows per query row;
    with ``k`` None every pair as (qid, cid, score), unranked.  Ranking: score
    (descending when ``largest``), compared to ``RANK_DIGITS`` digits so that the
    last bits of a sum, which depend on its order, do not decide, then corpus
    id ascending.  l2 scores of the kept rows are direct differences.
    """
    nq, dim = _size(queries, q_vec, n_queries)
    nc = _size(corpus, c_vec)[0] if n_corpus is None else n_corpus
    grid = _grid(queries.sparkSession)
    bq, bc = _blocks_for(nq, block_rows, dim, grid), _blocks_for(nc, block_rows, dim, grid)
    if bq == 1 or bc == 1:   # one block goes to each of the other side, so these need not be few and stay small
        bq, bc = _blocks_for(nq, block_rows), _blocks_for(nc, block_rows)
    qp = _pack(queries, q_id, q_vec, bq).select(F.col("blk").alias("qblk"), F.col("ids").alias("qids"),
                                                  F.col("vec").alias("qvec"))
    cp = _pack(corpus, c_id, c_vec, bc).select(F.col("blk").alias("cblk"), F.col("ids").alias("cids"),
                                                 F.col("vec").alias("cvec"))
    pairs = block_pairs(qp, cp, bq, bc, "qblk", "cblk")
    qt = queries.schema[q_id].dataType.simpleString()
    ct = corpus.schema[c_id].dataType.simpleString()
    cand = pairs.select("qids", "qvec", "cids", "cvec").mapInArrow(
        _kernel(k, metric, largest, exclude_self), f"qid {qt}, cid {ct}, score double")
    if k is None:      # the full matrix: no ranking, so no per-query group is sorted
        return cand
    order = F.round("score", RANK_DIGITS).desc() if largest else F.round("score", RANK_DIGITS).asc()
    w = Window.partitionBy("qid").orderBy(order, F.col("cid").asc())
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
