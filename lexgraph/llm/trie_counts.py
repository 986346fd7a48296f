"""Token counts of whole texts under a unigram vocabulary.

A pre-token is a run of characters between spaces with the space mark before
it.  Its best segmentation is the one with the highest sum of piece scores (ties:
fewer pieces), found by a forward pass.  The distinct pre-tokens of a batch are
walked in sorted order, which is a depth-first walk of their trie: the forward
scores of a shared prefix are computed once, and the state after the last
character is the terminal count.  Counts are kept per Python worker (bounded),
documents only add them up.  No shuffle.

The vocabulary is a public piece file; a piece's score is the file's own.  Bytes
that no piece covers count one token for each byte of the character (byte
fallback), at a cost below every piece.

Defined cases: NULL or empty texts have no token; repeated rows are counted
each; very long pre-tokens cost time in proportion to their length; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgraph.llm.common import chunks_of, read

MARK = "▁"
CACHE = 400_000


def pieces(path: str) -> dict[str, float]:
    """Text pieces of a vocabulary file with their scores."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """Forward pass over pre-tokens in sorted order."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=0.0) - 10.0
        # every proper suffix of a piece: a match going left can stop where no piece ends so
        self.suffixes = {p[i:] for p in scores for i in range(len(p))}
        self.counts: dict[str, int] = {}
        self.shared = 0

    def _step(self, word: str, end: int, best: list, count: list) -> None:
        """State after ``end`` characters from the states before it."""
        c = word[end - 1]
        width = len(c.encode("utf-8", "surrogatepass"))
        top, n = best[end - 1] + self.floor * width, count[end - 1] + width
        scores, suffixes = self.scores, self.suffixes
        for begin in range(end - 1, max(-1, end - 1 - self.longest), -1):
            part = word[begin:end]
            s = scores.get(part)
            if s is not None:
                total = best[begin] + s
                if total > top or total == top and count[begin] + 1 < n:
                    top, n = total, count[begin] + 1
            elif part not in suffixes:
                break
        best.append(top)
        count.append(n)

    def learn(self, words) -> None:
        """Terminal counts of distinct pre-tokens, given without their mark."""
        best, count, last = [0.0], [0], ""
        for w in sorted(words):
            marked = MARK + w
            keep, most = 0, min(len(last), len(marked))
            while keep < most and last[keep] == marked[keep]:
                keep += 1
            del best[keep + 1:], count[keep + 1:]
            self.shared += keep
            for end in range(keep + 1, len(marked) + 1):
                self._step(marked, end, best, count)
            self.counts[w] = count[-1]
            last = marked

    def count_texts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        if len(self.counts) > CACHE:
            self.counts.clear()
        cut = [t.split(" ") if t else [] for t in texts]
        self.learn({w for t in cut for w in t}.difference(self.counts))
        get = self.counts.__getitem__
        return [(sum(map(get, t)), len(t)) for t in cut]


_LOADED: dict[str, Trie] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_pretokens), one row per document row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        if path not in _LOADED:
            _LOADED[path] = Trie(pieces(path))
        trie = _LOADED[path]
        for b in chunks_of(batches, 2_000, "text", 8 << 20):
            counted = trie.count_texts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([n for n, _ in counted], pa.int64()), pa.array([m for _, m in counted], pa.int64())],
                names=["id", "n_tokens", "n_pretokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_pretokens long").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), vocabulary())
