"""Toxicity of whole texts by a bidirectional gated recurrent network.

A text is its lower-cased words.  Overlapping windows of ``SIZE`` words, half a
window apart, are all scored by the network of ``gru.py`` (word and character
inputs, two reading directions, attention pooling); the largest logit of a
text, calibrated, is its score.

Training uses a bounded sample: at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled
rows, chosen by a hash of the id among those whose crc32(id as text) mod 5 is
not 0, and at most ``MAX_WINDOWS`` windows of each, evenly spread.  A word's
evidence is its log odds over the sample's texts, for a text of the sample over those
of the other folds alone; a second pass of training leaves out windows of toxic texts that the first pass
finds clean, since a label marks a text and not each of its windows, and
prefers the highest windows of clean texts, which decide their scores.  The
network (about a megabyte) goes to the tasks with the function that uses it;
texts are scored where they lie, without a shuffle.

Defined cases: a text without a word (NULL, empty, blanks or punctuation only) holds
no evidence and gets the share of toxic labels, at most ``NO_WORDS``, so it is never
predicted toxic; several texts of one labelled id count with the least of them; rows without a label are scored like others; several labels of one id
count as toxic if one is; without labels of both kinds there is nothing to
learn and every score is the share of toxic labels, below one half if there are
none; repeated rows are scored each; other columns are kept (``reject_toxic``)
or left out.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.llm.common import chunks_of, read
from lexgraph.llm.gru import Network, laid_out, windows

SIZE, STRIDE = 64, 32
FOLDS = 5
MAX_TOXIC, MAX_CLEAN, MAX_WINDOWS = 1500, 2500, 24
VOCABULARY = 20_000
STEPS = (240, 200)
NO_WORDS = 0.25
CACHE = 300_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN):
    """[(fold, text, label)] of the sample; a bounded number of rows."""
    marked = labels.filter((fold(id_col) != 0) & F.col(label_col).isNotNull()) \
        .groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    order = [F.xxhash64(F.lit("toxicity sample"), F.col(id_col)), F.col(id_col)]
    chosen = marked.filter("__toxic = 1").orderBy(*order).limit(max_toxic) \
        .unionByName(marked.filter("__toxic = 0").orderBy(*order).limit(max_clean))
    joined = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # at most max_toxic + max_clean ids
    rows = joined.groupBy(fold(id_col).alias("fold"), F.col(id_col), "__toxic").agg(F.min(text_col).alias("text")) \
        .select("fold", id_col, "text", "__toxic").collect()
    rows.sort(key=lambda r: str(r[1]))
    return [(r[0], r[2], r[3]) for r in rows]


def _log_odds(present, labels: np.ndarray, size: int) -> np.ndarray:
    """Of each entry: how much likelier a toxic text holds it, smoothed; 0 for entry 0 (unknown words)."""
    count = np.zeros((2, size))
    for at, y in zip(present, labels, strict=True):
        count[y, at] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((count[1] + 3 * n[1] / n.sum()) / (n[1] + 3)) - np.log((count[0] + 3 * n[0] / n.sum()) / (n[0] + 3))
    odds[0] = 0
    return np.clip(odds, -3, 6).astype(np.float32)


def _by_fold(tokens, words, folds, known, odds):
    """Words told apart by the fold of the text: (tokens, words, their evidence)."""
    parts, spelled, evidence, size = [None] * len(tokens), [], [], 0
    for k in range(FOLDS):
        mine = [i for i in range(len(tokens)) if folds[i] == k]
        if not mine:
            continue
        flat = np.concatenate([tokens[i] for i in mine])
        used, local = np.unique(flat, return_inverse=True)
        for i, part in zip(mine, np.split(local, np.cumsum([len(tokens[i]) for i in mine])[:-1]), strict=True):
            parts[i] = (part + size).astype(np.int32)
        spelled += [words[w] for w in used]
        evidence.append(odds[k][known[used]])
        size += len(used)
    return parts, spelled or ["_"], np.concatenate(evidence) if size else np.zeros(1, np.float32)


def train(rows: list[tuple[int, str, int]], steps=STEPS, log=None) -> dict:
    """{"network", "a", "b"}, or {"constant"} when the labels are of one kind."""
    labels = np.array([r[2] for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return {"constant": float(labels.mean()) if len(labels) else 0.0}
    index: dict[str, int] = {}
    tokens = [np.array([index.setdefault(w, len(index)) for w in words_of(r[1])], np.int32) for r in rows]
    words = list(index) or ["_"]
    holds = np.zeros(len(words), np.int64)
    for t in tokens:
        holds[np.unique(t)] += 1
    common = np.argsort(-holds, kind="stable")[:VOCABULARY]
    common = common[holds[common] >= 3]
    net = Network([words[i] for i in common])
    known = np.zeros(len(words), np.int64)
    known[common] = np.arange(1, len(common) + 1)
    own_fold = np.array([r[0] for r in rows])
    held = [np.unique(known[t]) for t in tokens]
    net.evidence = _log_odds(held, labels, len(common) + 1)
    # a text's words are judged by the other folds alone, as a new text's will be
    tokens, words, evidence = _by_fold(tokens, words, own_fold, known, [
        _log_odds([h for h, f in zip(held, own_fold, strict=True) if f != k], labels[own_fold != k], len(common) + 1) for k in range(FOLDS)])
    lengths = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens) if len(tokens) else np.zeros(0, np.int32)
    start, length, text = windows(lengths, SIZE, STRIDE)
    calibrate = np.array([r[0] == 1 for r in rows])
    if len(set(labels[calibrate].tolist())) < 2 or len(set(labels[~calibrate].tolist())) < 2:  # nothing to hold out
        calibrate = np.ones(len(rows), bool)
        learn = np.ones(len(rows), bool)
    else:
        learn = ~calibrate
    order = np.arange(len(text)) - np.searchsorted(text, text)
    per = np.bincount(text, minlength=len(rows))[text]
    spread = (order * MAX_WINDOWS // per != (order - 1) * MAX_WINDOWS // per) | (per <= MAX_WINDOWS) | (order == 0)
    use = np.flatnonzero(spread & learn[text] & (length > 0))
    idx, mask = laid_out(flat, start[use], length[use], SIZE)
    y = labels[text[use]]
    if len(set(y.tolist())) < 2:
        return {"constant": float(labels.mean())}
    net.fit(words, idx, mask, y, steps[0], evidence=evidence, log=log)
    rows_x = net.rows(words, evidence)

    def logits(i, m):
        return np.concatenate([net.forward(rows_x, i[k:k + 2048], m[k:k + 2048]) for k in range(0, len(i), 2048)])

    found = logits(idx, mask)
    top = np.full(len(rows), -np.inf, np.float32)
    np.maximum.at(top, text[use], found)
    sure = (y == 0) | (found >= 0) | (found == top[text[use]])
    hard = np.flatnonzero((y[sure] == 0) & (found[sure] == top[text[use]][sure]))
    net.fit(words, idx[sure], mask[sure], y[sure], steps[1], rate=0.006, seed=5, hard=hard, evidence=evidence, log=log)
    rows_x = net.rows(words, evidence)
    use = np.flatnonzero(calibrate[text])
    idx, mask = laid_out(flat, start[use], length[use], SIZE)
    top = np.full(len(rows), -np.inf, np.float32)
    np.maximum.at(top, text[use], logits(idx, mask))
    calibrate &= lengths > 0
    a, b = _calibration(top[calibrate].astype(np.float64), labels[calibrate].astype(np.float64))
    return {"network": net, "a": a, "b": b, "no_words": min(float(labels.mean()), NO_WORDS)}


def _calibration(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale and offset with a light ridge; both kinds weigh by number."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        ga, gb = ((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 0.01 * b
        haa, hab, hbb = (w * x * x).sum() + 0.1, (w * x).sum(), w.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db) / 4)
        a, b = max(a - da / size, 0.05), b - db / size
    return float(a), float(b)


class Scorer:
    """Scores batches of texts; keeps the projected inputs of words it has met
    (bounded by ``CACHE`` words, which bounds memory and not results)."""

    def __init__(self, model: dict):
        self.model = model
        if "network" in model:
            self.net = model["network"]
            self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((4096, self.net.p["bx"].size), np.float32)

    def _learn(self, words: list[str]):
        n = len(self.index)
        if n + len(words) > len(self.rows):
            bigger = np.zeros((max(2 * len(self.rows), n + len(words)), self.rows.shape[1]), np.float32)
            bigger[:n] = self.rows[:n]
            self.rows = bigger
        self.rows[n:n + len(words)] = self.net.rows(words)
        self.index.update(zip(words, range(n, n + len(words))))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if "constant" in self.model:
            return np.full(len(texts), min(max(self.model["constant"], 0.0), 1.0))
        if len(self.index) > CACHE:
            self._reset()
        cut = [words_of(t) for t in texts]
        new = {w for t in cut for w in t if w not in self.index}
        if new or not self.index:
            self._learn(sorted(new) or ["_"])
        lengths = np.array([len(t) for t in cut])
        get = self.index.__getitem__
        flat = np.array([i for t in cut for i in map(get, t)], np.int64)
        start, length, text = windows(lengths, SIZE, STRIDE)
        top = np.full(len(texts), -np.inf, np.float32)
        for k in range(0, len(start), 4096):
            idx, mask = laid_out(flat, start[k:k + 4096], length[k:k + 4096], SIZE)
            np.maximum.at(top, text[k:k + 4096], self.net.forward(self.rows, idx, mask))
        z = self.model["a"] * top.astype(np.float64) + self.model["b"]
        return np.where(lengths > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), self.model["no_words"])


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score column added; every whole text is read."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # about a megabyte: its size is fixed by the parameters above
    schema = StructType(docs.schema.fields + [StructField(score_col, DoubleType())])

    def run(batches):
        import pyarrow as pa
        scorer = Scorer(shipped.value)
        for b in chunks_of(batches, 1_000, text_col, 4 << 20):
            s = scorer.scores(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(s, pa.float64())],
                                             names=list(b.schema.names) + [score_col])

    return docs.mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame, **options) -> dict:
    return train(training_rows(docs, labels, **options))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted), one row per document row."""
    scored = score(docs.select(id_col, text_col), trained(docs, labels, id_col=id_col, text_col=text_col), text_col)
    return scored.select(id_col, (fold(id_col) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(text_col).alias("text"))
    scored = score(rows, trained(docs, labels, id_col=id_col, text_col=text_col))
    return scored.filter(F.col("score") < 0.5).select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
