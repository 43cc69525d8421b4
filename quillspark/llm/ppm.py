"""Prediction by partial matching over bytes with frozen statistics, for several classes at once.

A context tree of one class counts, for every context of up to ``order`` bytes, the bytes that followed it. A symbol is
coded in the longest context that knows it; each longer context costs an escape (method C: a context with t
occurrences of d different symbols escapes with d / (t + d)). Counts do not change while scoring, so the code length of
a symbol in a context is a fixed number: trees are flattened into sorted arrays of hashed contexts, one column a class.
Contexts start at the white space before a word, so the code length of a word is fixed as well and is computed once.
"""

from __future__ import annotations

import re

import numpy as np

ORDER = 5
#: Words whose code lengths are remembered at a time.
KNOWN_WORDS = 1 << 18
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SEED = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def _hash(x: np.ndarray, byte: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (byte.astype(np.uint64) + np.uint64(1))) * _MUL
        return x ^ (x >> np.uint64(32))


def _bytes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the words, each word after one blank; the word number and the place in the word of each byte."""
    data = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
    size = np.array([len(x) for x in data], np.int64)
    word = np.repeat(np.arange(len(data)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    return np.frombuffer(b"".join(data), np.uint8), word, place


def _contexts(b: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the ``k`` bytes before each position, for k = 0 .. order; positions too early keep their shorter context."""
    out = [np.full(len(b), _SEED)]
    for k in range(1, order + 1):
        h = np.full(len(b), _SEED ^ np.uint64(k * 0x51_7CC1))
        for j in range(k, 0, -1):
            prev = np.zeros(len(b), np.uint8)
            prev[j:] = b[:-j] if j else b
            h = _hash(h, prev)
        out.append(h)
    return out


class Model:
    """Frozen trees of all classes: per order, the code lengths of known (context, symbol) pairs and the escape costs of
    known contexts, in bits, one column a class."""

    def __init__(self, names: list[str], words: list[dict[str, int]], order: int = ORDER):
        """``words[c]``: how often each word occurs in the training text of class c."""
        self.names, self.order = names, order
        n = len(names)
        parts = []
        for c, counts in enumerate(words):
            b, word, place = _bytes_of(list(counts))
            times = np.array(list(counts.values()), np.int64)[word] if counts else np.zeros(0, np.int64)
            parts.append((b, place, times))
        b, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        times, cls = np.concatenate([p[2] for p in parts]), np.repeat(np.arange(n), [len(p[0]) for p in parts])
        ctx = _contexts(b, place, order)
        self.base = 8.0
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(order + 1):
            ok = place >= k  # the context lies inside the word and its blank
            pair, sym = _hash(ctx[k][ok], b[ok]), b[ok]
            keys, at = np.unique(pair, return_inverse=True)
            count = np.zeros((len(keys), n))
            np.add.at(count, (at, cls[ok]), times[ok])
            cx, own = np.unique(ctx[k][ok], return_inverse=True)
            of_pair = np.zeros(len(keys), np.int64)
            of_pair[at] = own
            total, kinds = np.zeros((len(cx), n)), np.zeros((len(cx), n))
            np.add.at(total, of_pair, count)
            np.add.at(kinds, of_pair, (count > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(count / (total + kinds)[of_pair])
            if k == 0:
                lower = np.full((len(keys), n), self.base)
            else:  # what the shorter context costs for the same symbol
                first = np.zeros(len(keys), np.int64)
                first[at] = np.flatnonzero(ok)
                lower = self._cost(k - 1, [c[first] for c in ctx], b[first])
            cost = np.where(count > 0, seen, escape[of_pair] + lower)
            self.pairs.append((keys, cost.astype(np.float32)))
            self.escapes.append((cx, escape.astype(np.float32)))
        self.known: dict[str, int] = {}
        self.costs = np.zeros((0, n), np.float32)

    def _cost(self, most: int, ctx: list[np.ndarray], sym: np.ndarray) -> np.ndarray:
        """Code lengths of symbols, with contexts of up to ``most`` bytes."""
        cost = np.full((len(sym), len(self.names)), self.base)
        for k in range(most + 1):
            keys, bits = self.pairs[k]
            if not len(keys):  # nothing was learnt at this length
                continue
            h = _hash(ctx[k], sym)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            cx, esc = self.escapes[k]
            own = np.minimum(np.searchsorted(cx, ctx[k]), len(cx) - 1)
            there = (cx[own] == ctx[k])[:, None]
            cost = np.where(hit[:, None], bits[at], cost + np.where(there, esc[own], 0.0))
        return cost

    def word_costs(self, words: list[str]) -> np.ndarray:
        """Bits of each word in each class (the blank before it included)."""
        if not words:
            return np.zeros((0, len(self.names)))
        new = list(set(words).difference(self.known))
        if new:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
                self.costs = self.costs[:0]
                new = list(set(words))
            fresh = []
            for start in range(0, len(new), 20_000):
                some = new[start : start + 20_000]
                b, word, place = _bytes_of(some)
                ctx = _contexts(b, place, self.order)
                for k in range(1, self.order + 1):  # no context reaches back over the blank
                    ctx[k] = np.where(place >= k, ctx[k], np.uint64(k))
                bits = self._cost(self.order, ctx, b)
                fresh.append(np.add.reduceat(bits, np.flatnonzero(place == 0), axis=0).astype(np.float32))
            self.known.update(zip(new, range(len(self.costs), len(self.costs) + len(new))))
            self.costs = np.concatenate([self.costs, *fresh])
        return self.costs[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].astype(np.float64)


def text_words(text: str) -> list[str]:
    """Words of a text as the models count them: lower-case letter runs, apostrophes inside kept."""
    return [w.lower() for w in _WORD.findall(text)]
