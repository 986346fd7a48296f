"""Token ids of whole texts by a public byte-level BPE vocabulary.

Splitting at spaces commutes with this vocabulary's pre-tokenisation where a
space is followed by a character that is no white space: the space always goes
with what follows.  So ids are looked up per space-led word, and the words not
seen before are encoded together, one text per batch, and cut apart by their
byte lengths; where the same vocabulary lies beside the file as ranks
(``.tiktoken``), that library, several times faster, encodes these words.
Texts outside that condition (runs of blanks, a blank at the end, rare
characters, very long words) go to the tokenizer whole.
"""

from __future__ import annotations

import re

import numpy as np

# Fixed value: characters whose class (letter, digit, blank) every Unicode version agrees on.
RARE = re.compile("[^\t\n\r -~\xa1-ɏ]")
LONG = 1000


def splits_at_spaces(text: str) -> bool:
    """Every space is followed by a character that is no blank (RARE ones aside)."""
    return not ("  " in text or " \n" in text or " \t" in text or " \r" in text or text.endswith(" ") or RARE.search(text))


class ByteTokens:
    def __init__(self, path: str, max_words: int = 500_000):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=False)
        size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.n_bytes = np.zeros(size, dtype=np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # one letter of the byte alphabet for each byte
        self.encode_words = self._by_ranks(path) or (lambda t: self.tok.encode(t, add_special_tokens=False).ids)
        self.words: dict[str, bytes] = {}
        self.max_words = max_words  # bounds memory, not results

    @staticmethod
    def _by_ranks(path: str):
        import base64
        import os
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken
        with open(ranks, "rb") as f:
            table = {base64.b64decode(token): int(i) for token, i in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                 special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        sizes = np.cumsum([len(w.encode("utf-8")) + 1 for w in words])
        ids = np.asarray(self.encode_words(" " + " ".join(words)), dtype=self.dtype)
        ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), sizes, side="left") + 1
        raw, width, at = ids.tobytes(), self.dtype.itemsize, 0
        for w, end in zip(words, (ends * width).tolist()):
            self.words[w] = raw[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``self.dtype``."""
        if len(self.words) > self.max_words:
            self.words.clear()
        cut = [t.split(" ") if splits_at_spaces(t) else None for t in texts]
        new: set[str] = set()
        for words in cut:
            if words is not None:
                new.update(words)
        new.difference_update(self.words)
        short = [w for w in new if 0 < len(w) < LONG]
        if short:
            self._learn(short)
        for w in new:
            if len(w) >= LONG:
                self.words[w] = self.ids(" " + w)
        get = self.words.__getitem__
        return [self.ids(t) if words is None else self.ids(words[0]) + b"".join(map(get, words[1:]))
                for t, words in zip(texts, cut)]


_LOADED: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    """One tokenizer, with its words, for each Python worker and path."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokens(path)
    return _LOADED[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
