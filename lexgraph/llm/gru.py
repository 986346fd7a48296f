"""A bidirectional gated recurrent network with attention pooling, in numpy.

Input of a position: the embedding of its word (when the word is known from
training), the mean embedding of the word's character n-grams, and the word's
evidence, a number that training does not change (its log odds).  Two gated
recurrent layers read the window in both directions, attention weighs the
positions, and one logit comes out.  Training is plain back-propagation with
Adam on windows; the same code runs on the driver (training on a bounded
sample) and in tasks (scoring).
"""

from __future__ import annotations

import numpy as np

GRAMS = (3, 4, 5)
BUCKETS = 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN = 6, 6, 8
TABLE_RATE = 0.1
ENOUGH = 0.004  # mean loss of recent batches at which training ends early


def char_grams(words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): hashed n-grams of ``<word>``, one run per word."""
    runs = [_char_grams(words[i:i + at_once]) for i in range(0, len(words), at_once)]
    if not runs:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    counts = np.concatenate([c for _, c in runs])
    return np.concatenate([k for k, _ in runs]), np.cumsum(counts) - counts


def _char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    keys, owner = [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ code[j:len(code) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = word[:len(h)] == word[n - 1:]
        keys.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
        owner.append(word[:len(h)][inside])
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    return keys[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def sums_by(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of the rows of ``values`` for each key below ``size``."""
    if values.shape[1] <= 8:
        return np.stack([np.bincount(keys, values[:, j], size) for j in range(values.shape[1])], axis=1).astype(np.float32)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    begin = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(keys):
        out[sorted_keys[begin]] = np.add.reduceat(values[order], begin, axis=0)
    return out


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, vocabulary: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM + 1, HIDDEN
        self.words = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: a word not in the vocabulary
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {
            "word": small(len(vocabulary) + 1, WORD_DIM), "char": small(BUCKETS, CHAR_DIM),
            "wx": (rng.standard_normal((d, 6 * h)) / np.sqrt(d)).astype(np.float32),
            "bx": np.zeros(6 * h, np.float32),
            "uf": (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "ub": (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "att": small(2 * h), "out": (rng.standard_normal(2 * h) * 0.5).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.p["word"][0] = 0
        self.evidence = np.zeros(len(vocabulary) + 1, np.float32)
        self.scale = np.float32(4.0)  # of the character mean, which one n-gram among many moves little

    # ------------------------------------------------------------- inputs
    def inputs(self, ids: np.ndarray, evidence: np.ndarray, grams: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Word embedding, mean n-gram embedding and evidence of each word."""
        mean = np.add.reduceat(self.p["char"][grams], starts, axis=0) / counts[:, None].astype(np.float32) * self.scale
        return np.hstack([self.p["word"][ids], mean, evidence[:, None]]).astype(np.float32)

    def rows(self, words: list[str], evidence: np.ndarray | None = None, at_once: int = 20_000) -> np.ndarray:
        """Projected input of each word; ``evidence`` replaces the network's own."""
        out = np.empty((len(words), self.p["bx"].size), np.float32)
        for i in range(0, len(words), at_once):
            part = words[i:i + at_once]
            ids = np.fromiter((self.words.get(w, 0) for w in part), np.int64, len(part))
            grams, starts = char_grams(part)
            counts = np.diff(np.append(starts, len(grams)))
            x = self.inputs(ids, self.evidence[ids] if evidence is None else evidence[i:i + len(part)], grams, starts, counts)
            out[i:i + len(part)] = self.projected(x)
        return out

    def projected(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["wx"] + self.p["bx"]

    # ------------------------------------------------------------ forward
    def forward(self, rows: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window; ``rows`` are projected inputs, ``idx`` (windows
        x positions) picks them, ``mask`` is 0 at positions past the end."""
        n, steps = idx.shape
        h = HIDDEN
        states = np.zeros((steps, n, 2 * h), np.float32)
        tape = []
        full = mask.all(axis=0)
        for name, part, order in (("uf", 0, range(steps)), ("ub", 1, range(steps - 1, -1, -1))):
            u, cell = self.p[name], np.zeros((n, h), np.float32)
            lane = np.ascontiguousarray(rows[:, part * 3 * h:(part + 1) * 3 * h])
            for t in order:
                gx, gh = lane[idx[:, t]], cell @ u
                rz = _sigmoid(gx[:, :2 * h] + gh[:, :2 * h])
                cand = np.tanh(gx[:, 2 * h:] + rz[:, :h] * gh[:, 2 * h:])
                new = cand + rz[:, h:] * (cell - cand)
                if not full[t]:
                    new = np.where(mask[:, t, None], new, cell)
                if keep:
                    tape.append((part, t, cell, rz, cand, gh[:, 2 * h:]))
                cell = new
                states[t, :, part * h:(part + 1) * h] = cell
        score = states @ self.p["att"]
        score = np.where(mask.T, score, np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight *= mask.T
        weight /= np.maximum(weight.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, weight, pooled, tape)) if keep else logit

    def gradients(self, rows_x, rows, idx, mask, labels, weights):
        logit, (states, weight, pooled, tape) = self.forward(rows, idx, mask, keep=True)
        n, h = len(labels), HIDDEN
        prob = _sigmoid(logit)
        d_logit = ((prob - labels) * weights / n).astype(np.float32)
        g = {"bias": np.array([d_logit.sum()], np.float32), "out": pooled.T @ d_logit}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_pooled[None] + d_score[:, :, None] * self.p["att"]
        g["att"] = np.einsum("tn,tnh->h", d_score, states)
        g["uf"], g["ub"] = np.zeros_like(self.p["uf"]), np.zeros_like(self.p["ub"])
        steps = idx.shape[1]
        d_lanes = np.empty((steps, n, 6 * h), np.float32)
        carry = {0: np.zeros((n, h), np.float32), 1: np.zeros((n, h), np.float32)}
        for part, t, cell, rz, cand, ghn in reversed(tape):
            name = "ub" if part else "uf"
            m = mask[:, t, None].astype(np.float32)
            dh = d_states[t, :, part * h:(part + 1) * h] + carry[part]
            live = dh * m
            r, z = rz[:, :h], rz[:, h:]
            d_cand = live * (1 - z) * (1 - cand * cand)
            d_z = live * (cell - cand) * z * (1 - z)
            d_r = d_cand * ghn * r * (1 - r)
            d_gx = np.hstack([d_r, d_z, d_cand])
            d_gh = np.hstack([d_r, d_z, d_cand * r])
            g[name] += cell.T @ d_gh
            carry[part] = dh * (1 - m) + live * z + d_gh @ self.p[name].T
            d_lanes[t, :, part * 3 * h:(part + 1) * 3 * h] = d_gx
        d_rows = sums_by(idx.T.ravel(), d_lanes.reshape(-1, 6 * h), len(rows))
        g["bx"] = d_rows.sum(axis=0)
        g["wx"] = rows_x.T @ d_rows
        loss = float(np.mean(weights * (np.logaddexp(0, logit) - labels * logit)))
        return g, d_rows @ self.p["wx"].T, loss

    def fit(self, words: list[str], idx: np.ndarray, mask: np.ndarray, labels: np.ndarray, steps: int, batch: int = 128,
            rate: float = 0.01, seed: int = 3, hard: np.ndarray | None = None,
            evidence: np.ndarray | None = None, log=None) -> None:
        """Adam on class-balanced batches of windows (``idx`` into ``words``;
        masked positions may hold any valid index, ``evidence`` is of each of ``words``); half of the clean windows
        of a batch come from ``hard`` when given.  The tables, which can learn
        single windows by heart, move slowly."""
        rng = np.random.default_rng(seed)
        ids_all = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        evidence_all = self.evidence[ids_all] if evidence is None else evidence
        grams, starts = char_grams(words)
        ends = np.append(starts[1:], len(grams))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        recent = 1.0
        pos, neg = np.flatnonzero(labels > 0.5), np.flatnonzero(labels <= 0.5)
        for step in range(1, steps + 1):
            clean = rng.choice(neg, batch // 2)
            if hard is not None and len(hard):
                clean[::2] = rng.choice(hard, len(clean[::2]))
            pick = np.concatenate([rng.choice(pos, batch // 2), clean])
            used, local = np.unique(idx[pick], return_inverse=True)
            local = local.reshape(idx[pick].shape)
            counts = ends[used] - starts[used]
            at = np.repeat(starts[used] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            own = grams[at]
            begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
            x = self.inputs(ids_all[used], evidence_all[used], own, begin, counts)
            g, dx, loss = self.gradients(x, self.projected(x), local, mask[pick], labels[pick].astype(np.float32),
                                         np.ones(len(pick), np.float32))
            g["word"] = sums_by(ids_all[used], dx[:, :WORD_DIM], len(self.p["word"]))
            g["word"][0] = 0
            spread = dx[:, WORD_DIM:WORD_DIM + CHAR_DIM] / counts[:, None].astype(np.float32) * self.scale
            g["char"] = sums_by(own, np.repeat(spread, counts, axis=0), BUCKETS)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            shrink = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
            lr = rate * min(1.0, step / 20) * (0.1 + 0.9 * (1 - step / steps))
            for k, v in g.items():
                v = v * shrink
                first[k] += np.float32(0.1) * (v - first[k])
                second[k] += np.float32(0.01) * (v * v - second[k])
                up = first[k] / np.float32(1 - 0.9 ** step) / (np.sqrt(second[k] / np.float32(1 - 0.99 ** step)) + np.float32(1e-6))
                self.p[k] -= np.float32(lr * TABLE_RATE if k in ("word", "char") else lr) * up
            recent = 0.9 * recent + 0.1 * loss
            if log and step % 50 == 0:
                log(step, recent)
            if step > 40 and recent < ENOUGH:
                break


def windows(lengths: np.ndarray, size: int, stride: int):
    """Overlapping windows over texts laid end to end: (start, length, text).
    Every position lies in a window; a text without words has one empty window."""
    per = np.maximum(1, 1 + -(-np.maximum(lengths - size, 0) // stride))
    text = np.repeat(np.arange(len(lengths)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.cumsum(lengths) - lengths
    local = np.minimum(k * stride, np.maximum(lengths[text] - size, 0))
    return begin[text] + local, np.minimum(lengths[text], size), text


def laid_out(tokens: np.ndarray, start: np.ndarray, length: np.ndarray, size: int):
    """(indices, mask) of windows; positions past the end point at token 0."""
    at = start[:, None] + np.arange(size)
    mask = np.arange(size) < length[:, None]
    if not len(tokens):
        return np.zeros(at.shape, np.int64), mask
    return tokens[np.where(mask, at, 0)], mask
