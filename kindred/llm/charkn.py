"""Interpolated Kneser-Ney models over the characters of words, one per class, held in sorted hash arrays.

A word is scored as the characters of ``word + end`` given up to ``order - 1``
characters before each, where the word's start is one of them. The n-grams of
all classes share one sorted array of 64-bit hashes per order, with a matrix of
log-probabilities (n-gram x class) and one of back-off weights (context x
class), so that one binary search serves every class.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

START, END = 1, 2  # control characters never occur inside a word of ordinary text; equal ones only share counts
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), np.uint64(len(columns)), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    return h


def characters(words: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each character to predict, the last ``order`` characters up to it (oldest first); offsets of the words."""
    size = np.asarray(pa.compute.utf8_length(words), dtype=np.int64)
    text = "".join(words.to_pylist())
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(size + order)])
    line = np.zeros(starts[-1], np.uint32)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(size)) * order + order - 1, size)
    line[place] = flat
    line[starts[:-1] + order - 2] = START
    line[starts[1:] - 1] = END
    offsets = np.concatenate([[0], np.cumsum(size + 1)])
    ends = np.arange(offsets[-1]) + np.repeat(np.arange(len(size)) * (order - 1) + order - 1, size + 1)
    return [line[ends - k] for k in range(order - 1, -1, -1)], offsets


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class CharKN:
    order: int
    classes: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # by order, 1 first
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0

    @classmethod
    def fit(cls, words: pa.Array, counts: np.ndarray, classes: list[str], order: int, shared: int = 0, discount: float = 0.75) -> CharKN:
        """counts: words x classes. The orders up to ``shared`` use the counts of all classes together."""
        self = cls(order, classes)
        cols, offsets = characters(words, order)
        weight = np.repeat(counts.astype(np.float64), np.diff(offsets), axis=0)
        levels = []
        for n in range(order, 0, -1):
            h = _hash(cols[-n:])
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            c = np.stack([np.bincount(inverse, weight[:, k], len(keys)) for k in range(len(classes))], 1) if len(keys) else np.zeros((0, len(classes)))
            cols = [x[first] for x in cols[-n:]]
            levels.append((keys, cols, c))
            weight = (c > 0).astype(np.float64)  # a lower order counts the distinct characters before it
        size = len(levels[-1][0]) + 1
        self.floor = float(-np.log(size))
        lower = None
        for n, (keys, cols, c) in enumerate(reversed(levels), 1):
            if n <= shared:
                c = np.repeat(c.sum(1, keepdims=True), len(classes), 1)
            context = _hash(cols[:-1]) if n > 1 else np.zeros(len(keys), np.uint64)
            ctx, where = np.unique(context, return_inverse=True)
            total = np.stack([np.bincount(where, c[:, k], len(ctx)) for k in range(len(classes))], 1)
            kinds = np.stack([np.bincount(where, (c[:, k] > 0).astype(float), len(ctx)) for k in range(len(classes))], 1)
            if n == 1:
                below = np.full(c.shape, np.exp(self.floor))
            else:
                at, _ = _find(self.keys[-1], _hash(cols[1:]))
                below = np.exp(lower[at])
            seen = total > 0
            gamma = np.where(seen, discount * kinds / np.where(seen, total, 1), 1.0)
            share = np.maximum(c - discount, 0) / np.where(seen, total, 1)[where]
            lower = np.log(share + gamma[where] * below)
            self.keys.append(keys)
            self.logp.append(lower)
            self.contexts.append(ctx)
            self.back.append(np.log(np.maximum(gamma, 1e-300)))
        return self

    def score(self, words: pa.Array, at_once: int = 30_000) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-likelihood of each word under each class, and its number of predicted characters."""
        found = [self._score(words.slice(k, at_once)) for k in range(0, max(len(words), 1), at_once)]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def _score(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cols, offsets = characters(words, self.order)
        n = int(offsets[-1])
        out = np.zeros((n, len(self.classes)))
        left = np.arange(n)
        for k in range(self.order, 0, -1):
            here = [c[left] for c in cols[-k:]]
            at, ok = _find(self.keys[k - 1], _hash(here))
            out[left[ok]] += self.logp[k - 1][at[ok]]
            left, here = left[~ok], [x[~ok] for x in here]
            if not len(left):
                break
            context = _hash(here[:-1]) if k > 1 else np.zeros(len(left), np.uint64)
            at, ok = _find(self.contexts[k - 1], context)
            out[left[ok]] += self.back[k - 1][at[ok]]
        else:
            out[left] += self.floor
        total = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(out, 0)])
        return total[offsets[1:]] - total[offsets[:-1]], np.diff(offsets)
