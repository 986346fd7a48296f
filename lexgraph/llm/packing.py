"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens: its documents in input order, each its ids
and then the separator.  A window is ``window`` sequences long.  At each window
a queue is credited its target share of the window's tokens, serves the whole
tokens of its deficit, and carries the rest of the deficit on; queues are served
in a fixed order, one after another inside the window.  When a queue runs dry,
its share goes to the others in proportion to theirs, so every token is packed.
Documents are cut at window shares and at sequence ends.

The state of this round-robin after ``w`` windows has a closed form: a queue
has served ``floor(credit(w))`` tokens.  So no task waits for another: a
document needs only its start in its queue, which is a prefix sum over
(partition, source) token counts, and the credit line of each queue.  A hot
source is spread over all partitions like any other; documents are tokenised
once, written with their ids, and never shuffled.  The driver holds one number
for each source (targets are a table of that size anyway).

Defined cases: NULL or empty texts are the separator alone; a NULL source is
the queue of the empty name; repeated rows are packed each; an empty table
gives an empty result; other columns are ignored.  At most the last sequence is
not full; ``sequence_tokens`` is its number of tokens, and it needs padding only
when that is no power of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgraph.llm.common import chunks_of, read, stored
from lexgraph.llm.tokens import byte_tokens, vocabulary

LENGTH = 1024
WINDOW = 64
SEPARATOR = 0
MAX_BROADCAST = 1_000_000


class Schedule:
    """Closed form of the round-robin.  ``served(s, w)`` is what queue ``s`` has
    served before window ``w``; within a phase between two queues running dry
    its credit is a straight line, kept as integers ``(a + b * tokens) // d``."""

    def __init__(self, totals: list[int], shares: list[float] | None, window: int):
        self.totals, self.window = totals, window
        everything = sum(totals)
        want = [Fraction(x) for x in (shares if shares is not None else totals)]
        if any(x < 0 for x in want):
            raise ValueError("a target share is negative")
        at, credit = Fraction(0), [Fraction(0)] * len(totals)
        live = {s for s, t in enumerate(totals) if t}
        self.starts: list[Fraction] = []
        self.lines: list[list[tuple[int, int, int]]] = []
        while live:
            weight = {s: want[s] for s in live}
            if not any(weight.values()):  # only queues without a target are left
                weight = {s: Fraction(totals[s]) for s in live}
            total = sum(weight.values())
            slope = [weight.get(s, Fraction(0)) / total for s in range(len(totals))]
            self.starts.append(at)
            line = []
            for s in range(len(totals)):
                zero = credit[s] - slope[s] * at
                d = zero.denominator * slope[s].denominator
                line.append((int(zero * d), int(slope[s] * d), d))
            self.lines.append(line)
            step = min((totals[s] - credit[s]) / slope[s] for s in live if slope[s])
            at += step
            credit = [min(Fraction(t), c + k * step) for t, c, k in zip(totals, credit, slope)]
            live = {s for s in live if credit[s] < totals[s]}
        self.windows = -(-everything // window)
        self._kept: tuple[int, list[int], list[int]] = (-1, [], [])

    def served(self, s: int, w: int) -> int:
        tokens = w * self.window
        a, b, d = self.lines[bisect_right(self.starts, tokens) - 1][s]
        if w >= self.windows:
            return self.totals[s]
        return min(self.totals[s], (a + b * tokens) // d)

    def window_at(self, s: int, position: int) -> int:
        """The window that serves a token of queue ``s``."""
        lo, hi = 0, self.windows
        while lo < hi - 1:
            mid = (lo + hi) // 2
            if self.served(s, mid) <= position:
                lo = mid
            else:
                hi = mid
        return lo

    def place(self, s: int, w: int) -> tuple[int, int, int]:
        """Of queue ``s`` in window ``w``: its first token, the token after its
        last, and the place of the first one in the packed stream."""
        if self._kept[0] != w:
            lo = [self.served(q, w) for q in range(len(self.totals))]
            hi = [self.served(q, w + 1) for q in range(len(self.totals))]
            at, places = sum(lo), []
            for a, b in zip(lo, hi):
                places.append(at)
                at += b - a
            self._kept = (w, list(zip(lo, hi)), places)
        (a, b), at = self._kept[1][s], self._kept[2][s]
        return a, b, at


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, queue_col: str,
              separator: int = SEPARATOR) -> DataFrame:
    """(doc, queue, pid, start, n, ids): ``start`` counts the tokens of the same
    queue before the document in its partition."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        pid, before, tok = TaskContext.get().partitionId(), {}, byte_tokens(tokenizer)
        end = np.asarray([separator], dtype=tok.dtype).tobytes()
        for b in chunks_of(batches, 1_000, "text", 4 << 20):
            ids = [x + end for x in tok.encode([t or "" for t in b.column("text").to_pylist()])]
            queues = b.column("queue").to_pylist()
            counts = [len(x) // tok.dtype.itemsize for x in ids]
            starts = []
            for q, n in zip(queues, counts):
                starts.append(before.get(q, 0))
                before[q] = starts[-1] + n
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array(queues, pa.string()), pa.array([pid] * len(ids), pa.int64()),
                 pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc", "queue", "pid", "start", "n", "ids"])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(queue_col).cast("string"), F.lit("")).alias("queue"))
    return rows.mapInArrow(run, f"doc {kind}, queue string, pid long, start long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source",
         shares: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW,
         separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, ids, source.  ``shares`` gives target proportions by source (a
    source without one is served after the others); by default each source's
    share of all tokens, so every window has the mixture of the whole."""
    ready = stored(tokenised(docs, tokenizer, id_col, text_col, queue_col, separator))
    wide = byte_tokens(tokenizer).dtype.str
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ready.groupBy("queue", "pid").agg(F.sum("n").alias("n"))
    counts = stored(counts)
    totals = {r["queue"]: r["n"] for r in counts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    index = {q: i for i, q in enumerate(names)}
    amounts = [totals[q] for q in names]
    targets = None if shares is None else [shares.get(q, 0.0) for q in names]
    before = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("queue", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.count() <= MAX_BROADCAST:
        bases = F.broadcast(bases)
    placed = ready.join(bases, ["queue", "pid"]).select("doc", "queue", (F.col("start") + F.col("base")).alias("at"), "ids")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        plan = Schedule(amounts, targets, window * length)
        last = {}
        total = sum(amounts)
        for b in batches:
            out = [[] for _ in range(9)]
            docs_, queues, ats = (b.column(c).to_pylist() for c in ("doc", "queue", "at"))
            for doc, queue, at, raw in zip(docs_, queues, ats, b.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), dtype=wide).astype("<u4")
                s, n, done = index[queue], len(ids), 0
                w = last.get(s, -1)
                if w < 0 or not plan.served(s, w) <= at < plan.served(s, w + 1):
                    w = plan.window_at(s, at)
                while done < n:
                    lo, hi, first = plan.place(s, w)
                    if hi <= at + done:
                        w += 1
                        continue
                    g = first + at + done - lo
                    m = min(n - done, hi - at - done, length - g % length)
                    piece = ids[done:done + m].tobytes()
                    size = min(length, total - g // length * length)
                    for col, v in zip(out, (doc, done, m, zlib.crc32(piece), n, g // length, g % length, size, queue)):
                        col.append(v)
                    done += m
                last[s] = w
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], b.schema.field("doc").type)] + [pa.array(c, pa.int64()) for c in out[1:8]]
                + [pa.array(out[8], pa.string())],
                names=["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "queue"])

    return placed.mapInArrow(run, f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "sequence_id long, offset long, sequence_tokens long, queue string") \
        .withColumnsRenamed({"doc": id_col, "queue": queue_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary())
