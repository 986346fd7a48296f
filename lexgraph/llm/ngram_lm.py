"""Language-model scores from Elias-Fano n-gram tries.

Tokens are blank-separated words, A-Z lower-cased, then one end token; the end
token of the text before is the first context.  The model interpolates bigrams
with unigrams: ``p(w|h) = (c(hw) + MU p(w)) / (c(h) + MU)``, and ``p(w)`` keeps the
mass of words seen once for the one unknown token.

The corpus is cut into blocks of documents: distinct words by their 64-bit hash,
and token numbers, packed.  Counting and look-up are one exchange, twice:

* words: each block sends its distinct words, with its training counts, to
  shards by hash; a shard adds up and answers every block with the totals;
* bigrams: each block sends its distinct pairs the same way; a shard builds a
  trie of the pairs seen in training and looks up all pairs it was sent.

A trie has three monotone Elias-Fano lists -- contexts, pointers to their runs of
successors, and successors numbered under their context -- and one byte a pair
for its probability, quantised on a logarithmic scale.  A pair is found by a
successor search among the contexts, and one within the context's run.  The
levels are packed bytes and are read where they lie.

Pairs are dealt to shards by a hash of the whole pair, so a very common word is
no hot key, and every block sends a pair once however often it holds it.
Shards and blocks have a bounded size, their number grows with the corpus; the
driver holds three totals.

Defined cases: a NULL or empty text is the end token alone; repeated rows are
learned and scored each; a NULL id is learned from; words of any length; without
training rows every token is unknown, with probability one; an empty table
gives an empty result; other columns are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.llm import elias_fano
from lexgraph.llm.common import read, stored

FOLDS = 10
MU = 30.0
BLOCK_TOKENS = 2_000_000
SHARD_KEYS = 3_000_000
LOW32 = np.uint64(0xFFFFFFFF)


class BigramTrie:
    """Packed levels: contexts, pointers, successors, probabilities."""

    @staticmethod
    def build(keys: np.ndarray, log_probs: np.ndarray, depth: float) -> bytes:
        """``keys``: sorted distinct ``context << 32 | successor``;
        ``log_probs`` between ``-depth`` and 0."""
        context = keys >> np.uint64(32)
        begin = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        rank = np.zeros(len(keys), np.uint64)
        rank[begin[1:]] = 1
        rank = np.cumsum(rank).astype(np.uint64)
        codes = np.rint(np.clip(-log_probs / max(depth, 1e-9), 0, 1) * 254).astype(np.uint8) + np.uint8(1)
        return b"".join([
            elias_fano.encode(context[begin], 1 << 32),
            elias_fano.encode(np.append(begin, len(keys)), len(keys) + 1),
            elias_fano.encode((rank << np.uint64(32)) | (keys & LOW32), max(1, len(begin)) << 32),
            codes.tobytes()])

    def __init__(self, raw: bytes):
        self.contexts = elias_fano.View(raw)
        at = self.contexts.size
        self.pointers = elias_fano.View(raw, at)
        at += self.pointers.size
        self.successors = elias_fano.View(raw, at)
        at += self.successors.size
        self.codes = np.frombuffer(raw, np.uint8, self.successors.n, at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Code of each key; 0 where the trie has none."""
        out = np.zeros(len(keys), np.uint8)
        if not self.contexts.n or not len(keys):
            return out
        context = keys >> np.uint64(32)
        at = self.contexts.successor(context)
        known = np.flatnonzero(at < self.contexts.n)
        known = known[self.contexts.access(at[known]) == context[known]]
        rank = at[known]
        lo, hi = self.pointers.access(rank).astype(np.int64), self.pointers.access(rank + 1).astype(np.int64)
        want = (rank.astype(np.uint64) << np.uint64(32)) | (keys[known] & LOW32)
        place = self.successors.successor(want, lo, hi)
        inside = place < hi
        known, place, want = known[inside], place[inside], want[inside]
        same = self.successors.access(place) == want
        out[known[same]] = self.codes[place[same]]
        return out


def log_prob_of(codes: np.ndarray, depth: float) -> np.ndarray:
    return -(codes.astype(np.float64) - 1) / 254 * depth


def _dealt(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """Indices of sorted keys by shard, each in key order."""
    x = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    shard = ((x ^ (x >> np.uint64(32))) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    return [order[a:b] for a, b in zip(cuts, cuts[1:])]


def _pack(a: np.ndarray) -> bytes:
    import zstandard
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(raw: bytes, dtype) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.decompress(raw), dtype=dtype)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def blocks_of(docs: DataFrame, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """Packed blocks of whole documents: (block, ids, lengths, held, words,
    tokens, n_distinct, n_tokens, n_train)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False)).alias("held"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext
        pid, n_block = TaskContext.get().partitionId(), 0
        id_type = None
        ids, lengths, held, parts, size, numbers = [], [], [], [], 0, _Numbers()

        def flush():
            nonlocal ids, lengths, held, parts, size, numbers, n_block
            if ids:
                # number 0 is the end token, the others follow the sorted hashes of their words
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
                order = np.argsort(hashes)
                new = np.empty(len(numbers) + 1, np.uint32)
                new[order + 1] = np.arange(1, len(numbers) + 1, dtype=np.uint32)
                new[0] = 0
                tokens = new[np.concatenate(parts)]
                train = sum(n for n, h in zip(lengths, held) if not h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pid << 24 | n_block], pa.int64()), pa.array([ids], pa.list_(id_type)),
                     pa.array([lengths], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                     pa.array([hashes[order].tobytes()], pa.binary()), pa.array([_pack(tokens)], pa.binary()),
                     pa.array([len(numbers) + 1], pa.int64()), pa.array([size], pa.int64()), pa.array([train], pa.int64())],
                    names=["block", "ids", "lengths", "held", "words", "tokens", "n_distinct", "n_tokens", "n_train"])
                n_block += 1
            ids, lengths, held, parts, size, numbers = [], [], [], [], 0, _Numbers()

        for b in batches:
            id_type = b.schema.field("id").type
            for i, h, raw in zip(b.column("id").to_pylist(), b.column("held").to_pylist(), b.column("text")):
                words = raw.as_py().lower().split()
                part = np.zeros(len(words) + 1, np.int64)
                part[:-1] = list(map(numbers.__getitem__, words))
                part[:-1] += 1
                ids.append(i)
                lengths.append(len(part))
                held.append(h)
                parts.append(part)
                size += len(part)
                if size >= block_tokens:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, f"block long, ids array<{kind}>, lengths array<bigint>, held array<boolean>, words binary, "
                                "tokens binary, n_distinct long, n_tokens long, n_train long")


END = np.uint64(0x656E64)


def _open(words: bytes, tokens: bytes, lengths, held):
    """(hashes with the end token at 0, token numbers, which are training tokens)."""
    hashes = np.append(END, np.frombuffer(words, np.uint64))
    numbers = _unpack(tokens, np.uint32).astype(np.int64)
    return hashes, numbers, np.repeat(~np.asarray(held, bool), np.asarray(lengths, np.int64))


def _pairs(hashes: np.ndarray, numbers: np.ndarray):
    """(distinct pair keys, number of each place's pair); the context of a
    place is the token before it, of the first place the end token."""
    short = hashes >> np.uint64(32)
    short[0] = END
    context = np.append(0, numbers[:-1])
    keys = (short[context] << np.uint64(32)) | short[numbers]
    return np.unique(keys, return_inverse=True)


def _sent(blocks: DataFrame, shards: int, pairs: bool) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for block, words, tokens, lengths, held in zip(*(b.column(c).to_pylist() for c in (
                    "block", "words", "tokens", "lengths", "held"))):
                hashes, numbers, train = _open(words, tokens, lengths, held)
                if pairs:
                    keys, place = _pairs(hashes, numbers)
                    counts = np.bincount(place[train], minlength=len(keys))
                else:
                    order = np.argsort(hashes)
                    keys, counts = hashes[order], np.bincount(numbers[train], minlength=len(hashes))[order]
                rows = [(s, at) for s, at in enumerate(_dealt(keys, shards)) if len(at)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                     pa.array([elias_fano.encode(keys[at], 1 << 64) for _, at in rows], pa.binary()),
                     pa.array([_pack(counts[at].astype("<u4")) for _, at in rows], pa.binary())],
                    names=["shard", "block", "keys", "counts"])

    wanted = blocks.select("block", "words", "tokens", "lengths", "held")
    return wanted.mapInArrow(run, "shard int, block long, keys binary, counts binary")


def _gather(pdf):
    """Keys of each row of a shard, and the distinct keys with their totals."""
    keys = [elias_fano.View(k).all() for k in pdf["keys"]]
    counts = np.concatenate([_unpack(c, "<u4") for c in pdf["counts"]]).astype(np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    begin = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return keys, every[begin], np.add.reduceat(counts[order], begin)


def _answers(pdf, kind, payloads, seen=0, once=0):
    import pandas as pd
    return pd.DataFrame({"block": pdf["block"], "kind": kind, "shard": pdf["shard"], "payload": payloads,
                         "seen": seen, "once": once})


ANSWER = "block long, kind int, shard int, payload binary, seen long, once long"


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU,
           block_tokens: int = BLOCK_TOKENS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one
    row per document row; log10 probabilities."""
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = stored(blocks_of(docs, id_col, text_col, block_tokens))
    size = blocks.agg(F.coalesce(F.sum("n_distinct"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)),
                      F.coalesce(F.sum("n_train"), F.lit(0))).first()
    word_shards, pair_shards = (max(16, -(-int(x) // shard_keys)) for x in size[:2])
    total = int(size[2])
    depth = float(np.log10(max(total, 10)))

    def add_words(pdf):
        keys, distinct, sums = _gather(pdf)
        totals = [_pack(sums[np.searchsorted(distinct, k)].astype("<u8")) for k in keys]
        return _answers(pdf, 0, totals, int((sums > 0).sum()), int((sums == 1).sum()))

    def add_pairs(pdf):
        keys, distinct, sums = _gather(pdf)
        learned = sums > 0
        trie = BigramTrie(BigramTrie.build(distinct[learned], np.log10(sums[learned] / max(total, 1)), depth))
        return _answers(pdf, 1, [_pack(trie.find(k)) for k in keys])

    words = stored(_sent(blocks, word_shards, False).groupBy("shard").applyInPandas(add_words, ANSWER))
    pairs = _sent(blocks, pair_shards, True).groupBy("shard").applyInPandas(add_pairs, ANSWER)
    per_shard = words.groupBy("shard").agg(F.max("seen").alias("seen"), F.max("once").alias("once"))
    sums = per_shard.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("once"), F.lit(0))).first()
    n_seen, n_once = int(sums[0]), int(sums[1])

    def score(own, answers):
        import pandas as pd
        out = []
        for block, ids, lengths, held, packed, tokens in zip(*(own[c] for c in ("block", "ids", "lengths", "held", "words", "tokens"))):
            hashes, numbers, _ = _open(packed, tokens, lengths, held)
            lengths = np.asarray(lengths, np.int64)
            got = {(k, s): p for k, s, p in zip(answers["kind"], answers["shard"], answers["payload"])}
            order = np.argsort(hashes)
            counts = np.zeros(len(hashes), np.int64)
            for s, at in enumerate(_dealt(hashes[order], word_shards)):
                if len(at):
                    counts[order[at]] = _unpack(got[0, s], "<u8")
            distinct, place = _pairs(hashes, numbers)
            codes = np.zeros(len(distinct), np.uint8)
            for s, at in enumerate(_dealt(distinct, pair_shards)):
                if len(at):
                    codes[at] = _unpack(got[1, s], np.uint8)
            base = np.log10((counts + 0.1) / (total + 0.1 * (n_seen + 1)))
            unknown = min(0.5, (n_once + 0.1) / (total + 0.1 * (n_seen + 1))) if total else 1.0
            single = np.where(counts > 0, (1 - unknown) * (counts + 0.1) / max(total + 0.1 * n_seen, 1e-9), unknown)
            joint = np.where(codes > 0, 10.0 ** log_prob_of(codes, depth) * total, 0.0)
            context = np.append(0, numbers[:-1])
            p = (joint[place] + mu * single[numbers]) / (counts[context] + mu)
            begin = np.cumsum(lengths) - lengths
            add = lambda x: np.add.reduceat(x, begin)
            out.append(pd.DataFrame({
                id_col: list(ids), "held_out": np.asarray(held, bool), "n_tokens": lengths,
                "n_known": add((counts[numbers] > 0).astype(np.int64)), "train_tokens": total,
                "base_score": add(base[numbers]), "score": add(np.log10(np.minimum(p, 1.0)))}))
        return pd.concat(out) if out else pd.DataFrame(columns=[id_col, "held_out", "n_tokens", "n_known", "train_tokens",
                                                                 "base_score", "score"])

    answers = words.unionByName(pairs).select("block", "kind", "shard", "payload")
    own = blocks.select("block", "ids", "lengths", "held", "words", "tokens")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        score, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"))
