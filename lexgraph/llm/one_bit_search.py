"""Nearest neighbours by cosine over randomly rotated one-bit codes.

Index: every vector is scaled to length one, the centre of a bounded sample is
taken off, a random rotation (drawn from a seed) is applied, and only the signs
are kept, packed eight to a byte, with three scalars: the length of the
residual, its alignment with its own code, and its product with the centre.

Search: the queries are a stated set, searched against all rows in blocks.
Rows and queries are dealt into stripes by a hash of their id; a cell of the
grid holds one stripe of each, both of bounded size, so a crowd of equal
vectors spreads like any rows.  In a cell the inner products are estimated from
the codes; the best estimates are computed exactly and give each query a
threshold; every row whose estimate plus its error bound reaches the threshold
is reranked exactly, in double precision, on the original vectors.  A cell
returns the best ``k`` of each query; a window merges them.

The bound holds for each row with the probability of ``EPSILON`` standard
deviations; measured recall on the given tables is in the README.

Defined cases: NULL, zero, non-finite vectors and vectors whose size is not the
most frequent one take no part, neither do NULL ids; rows with one id are one
row (the least vector); ties go to the smaller id; a query with fewer than
``k`` candidates returns them all; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgraph.llm.common import read, stored

TOP = 5
EVERY = 50
EPSILON = 2.6
SAMPLE = 4096
ROWS, QUERIES = 16_384, 2_048


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): the vectors that take part, one for each id."""
    v = F.col(vec_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0))
    return good.groupBy("id").agg(F.min("v").alias("v"))


def encode(rows, centre, turn):
    """(codes, length, alignment, with centre) of vectors, one per line."""
    import numpy as np
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    rest = unit - centre
    length = np.linalg.norm(rest, axis=1)
    turned = rest @ turn
    sign = turned >= 0
    align = np.abs(turned).sum(axis=1) / np.sqrt(rows.shape[1]) / np.maximum(length, 1e-30)
    return np.packbits(sign, axis=1), length, np.maximum(align, 1e-6), unit @ centre


def search_cell(ids, vecs, codes, length, align, with_centre, q_ids, q_vecs, centre, turn, k, epsilon, counts=None):
    """Best ``k`` (query, id, score) of each query among the rows of a cell."""
    import numpy as np
    n, dim = vecs.shape
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    norms = np.linalg.norm(vecs, axis=1)
    q_norms = np.linalg.norm(q_vecs, axis=1)
    units = q_vecs / q_norms[:, None]
    rests = units - centre
    turned = (rests @ turn).astype(np.float32)
    q_rest = np.linalg.norm(rests, axis=1)
    q_base = units @ centre - centre @ centre
    factor = (length / align / np.sqrt(dim)).astype(np.float32)
    spread = (length * np.sqrt(np.maximum(1 - align ** 2, 0)) / align * epsilon / np.sqrt(max(dim - 1, 1))).astype(np.float32)
    order_of = np.argsort(ids, kind="stable")
    sorted_ids = ids[order_of]
    first = min(n, 4 * k + 8)

    def exact(qi, oi):
        return np.einsum("ij,ij->i", vecs[oi], q_vecs[qi]) / (norms[oi] * q_norms[qi])

    found = []
    step = max(1, 2_000_000 // max(n, 1))
    for lo in range(0, len(q_ids), step):
        part = np.arange(lo, min(lo + step, len(q_ids)))
        estimate = (turned[part] @ signs.T) * factor + with_centre.astype(np.float32) + q_base[part, None].astype(np.float32)
        at = np.searchsorted(sorted_ids, q_ids[part])
        own = (at < n) & (sorted_ids[np.minimum(at, n - 1)] == q_ids[part])
        estimate[np.flatnonzero(own), order_of[at[own]]] = -np.inf
        best = np.argpartition(-estimate, first - 1, axis=1)[:, :first] if first < n else np.tile(np.arange(n), (len(part), 1))
        qi, oi = np.repeat(part, best.shape[1]), best.ravel()
        s = exact(qi, oi).reshape(best.shape)
        s[~np.isfinite(np.take_along_axis(estimate, best, axis=1))] = -np.inf
        kth = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(part), -np.inf)
        # the slack covers single-precision estimates; equal scores must all come through
        reach = estimate + spread * q_rest[part, None].astype(np.float32) >= (kth - 1e-5)[:, None]
        reach &= np.isfinite(estimate)
        qs, os_ = np.nonzero(reach)
        if counts is not None:
            counts.append((len(qs), reach.size))
        scores = np.concatenate([exact(part[qs[i:i + 100_000]], os_[i:i + 100_000])
                                 for i in range(0, len(qs), 100_000)] or [np.zeros(0)])
        order = np.lexsort((ids[os_], -scores, qs))
        qs, os_, scores = qs[order], os_[order], scores[order]
        rank = np.arange(len(qs)) - np.searchsorted(qs, qs)
        top = rank < k
        found.append((q_ids[part[qs[top]]], ids[os_[top]], scores[top]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, every: int = EVERY,
            epsilon: float = EPSILON, sample: int = SAMPLE, rows_per_stripe: int = ROWS,
            queries_per_stripe: int = QUERIES, seed: int = 11) -> DataFrame:
    """(query_id, rank, id, score) for the rows whose id is divisible by ``every``."""
    import numpy as np
    spark = vectors.sparkSession
    schema = "query_id long, id long, score double"
    base = stored(usable(vectors, id_col, vec_col))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double").withColumnRenamed("id", id_col)
    if sizes is None:
        return empty
    dim, n = sizes["d"], sizes["count"]
    base = base.filter(F.size("v") == dim)
    n_queries = base.filter(F.col("id") % every == 0).count()
    if not n_queries:
        return empty
    chosen = base.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample).select("v").collect()
    units = np.array([r["v"] for r in chosen], dtype=np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    centre = units.mean(axis=0)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]

    def index(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(-1, dim)
            codes, length, align, middle = encode(v, centre, turn)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length),
                 pa.array(align), pa.array(middle), pa.array([x.tobytes() for x in v], pa.binary())],
                names=["id", "code", "length", "align", "middle", "v"])

    coded = base.mapInArrow(index, "id long, code binary, length double, align double, middle double, v binary")
    stripes = -(-n // rows_per_stripe)
    lanes = -(-n_queries // queries_per_stripe)
    stripe = lambda of, m: F.pmod(F.xxhash64(F.lit("stripe"), of), F.lit(m)).cast("int")
    data = coded.withColumn("stripe", stripe(F.col("id"), stripes)) \
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    queries = coded.filter(F.col("id") % every == 0).select("id", "v", stripe(F.col("id") + 1, lanes).alias("lane")) \
        .withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

    def cell(rows, wanted):
        import pandas as pd
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        take = lambda c, t: np.frombuffer(b"".join(c), dtype=t)
        q, i, s = search_cell(
            rows["id"].to_numpy(), take(rows["v"], np.float64).reshape(-1, dim),
            take(rows["code"], np.uint8).reshape(len(rows), -1), rows["length"].to_numpy(), rows["align"].to_numpy(),
            rows["middle"].to_numpy(), wanted["id"].to_numpy(), take(wanted["v"], np.float64).reshape(-1, dim),
            centre, turn, k, epsilon)
        return pd.DataFrame({"query_id": q, "id": i, "score": s})

    part = data.groupBy("stripe", "lane").cogroup(queries.groupBy("stripe", "lane")).applyInPandas(cell, schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))
