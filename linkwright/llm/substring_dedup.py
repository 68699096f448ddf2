"""Removal of word windows that an earlier document holds, by an FM-index per shard.

A shard's index is built over the contexts dealt to it (see repeats.py): suffix
order by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix of
packed bits with counts for every 64.  The same contexts are streamed through
it from right to left: each step is one backward-search step by one word, after
which the match is cut back to `window` words, so the interval always is that
of the current window; it is reported where it holds a smaller document.

Defined results: a null text has no words; a null doc_id is neither smaller nor
larger than any other, so such rows stay whole and remove nothing; rows of one
doc_id do not remove each other's words; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.repeats import HOT_CONTEXTS, Unit, covered, keyed, repeated, with_found
from linkwright.llm.runtime import arrow_map, batch
from linkwright.llm.words import SPACE, chunks, words

WINDOW = 50
GRAM = 12


class WaveletMatrix:
    """place(symbol, i) in the stable sort of the sequence by symbol, level by level from the top bit."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.before, self.zeros = levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = i >> 6
            ones = self.before[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i


class FMIndex:
    """Index of several sequences; each ends with a mark of its own, less than every word."""

    def __init__(self, contents: list[np.ndarray], window: int):
        self.window = window
        size = np.array([len(c) for c in contents])
        self.end = np.cumsum(size + 1) - 1
        self.names, ids = np.unique(np.concatenate(contents), return_inverse=True)
        marks = len(contents)
        text = np.empty(int(size.sum()) + marks, np.int64)
        is_mark = np.zeros(len(text), bool)
        is_mark[self.end] = True
        text[is_mark], text[~is_mark] = np.arange(marks), ids + marks
        self.text = text
        order, at_depth = self.sorted_suffixes(text)
        self.order = order
        symbols = np.where(is_mark, 0, text - marks + 1)
        self.levels = max(1, int(symbols.max()).bit_length())
        self.tree = WaveletMatrix(symbols[order - 1], self.levels)
        self.symbols = symbols
        counts = np.bincount(symbols)
        every = np.arange(len(counts))
        # smaller symbols, less where the symbol's own places begin in the tree
        self.shift = np.cumsum(counts) - counts - self.tree.place(every, np.zeros(len(counts), np.int64))
        # groups of suffixes that agree on their first `window` words
        fresh = np.ones(len(text), bool)
        fresh[1:] = at_depth[order[1:]] != at_depth[order[:-1]]
        self.group = np.cumsum(fresh) - 1
        self.bound = np.append(np.flatnonzero(fresh), len(text))

    def sorted_suffixes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by prefix doubling, and for each suffix the class of its first `window` symbols."""
        n, rank, k, at_depth = len(text), text, 1, None
        while True:
            if at_depth is None and 2 * k > self.window:
                after = np.minimum(np.arange(n) + self.window - k, n - 1)
                at_depth = np.unique(rank * n + rank[after], return_inverse=True)[1]
            follow = np.zeros(n, np.int64)
            follow[: n - k] = rank[k:] + 1
            key = rank * (n + 1) + follow
            order = np.argsort(key, kind="stable")
            fresh = np.zeros(n, np.int64)
            fresh[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            k *= 2
            if at_depth is not None and rank[order[-1]] == n - 1:
                return order, at_depth

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the matches with one word more on the left."""
        return self.shift[symbol] + self.tree.place(symbol, low), self.shift[symbol] + self.tree.place(symbol, high)

    def window_groups(self) -> list[np.ndarray]:
        """For each sequence, the group of suffixes that each of its windows matches, by backward search."""
        first = np.concatenate([[0], self.end[:-1] + 1])
        many = self.end - first - self.window + 1
        out = [np.empty(max(m, 0), np.int64) for m in many]
        who = np.flatnonzero(many > 0)
        low, high = np.zeros(len(who), np.int64), np.full(len(who), len(self.text))
        at = self.end[who]
        while len(who):
            at = at - 1
            low, high = self.step(self.symbols[at], low, high)
            full = at <= self.end[who] - self.window
            group = self.group[low]
            low, high = np.where(full, self.bound[group], low), np.where(full, self.bound[group + 1], high)
            for w, a, g in zip(who[full].tolist(), (at - first[who])[full].tolist(), group[full].tolist(), strict=True):
                out[w][a] = g
            left = at > first[who]
            who, at, low, high = who[left], at[left], low[left], high[left]
        return out


def smallest_holders(contents: list, weights: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each content, the smallest document with a content that holds it."""
    index = FMIndex([np.asarray(c, np.int64) for c in contents], window)
    holder = np.searchsorted(index.end, index.order, "left")
    least = np.minimum.reduceat(weights[holder], index.bound[:-1])
    return [least[g] for g in index.window_groups()]


def remove_seen(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by a space) and kept_sha256 of every row."""
    docs = keyed(docs)
    unit = Unit("words", window, gram)
    found = repeated(docs.filter(F.col("doc_id").isNotNull()), unit, F.min("doc_id"), F.min, smallest_holders, lambda v: v < F.col("doc_id"), hot_contexts)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows):
                w = words(part.column(1), SPACE, lower=False)
                data = w.data.tobytes()
                start, end = w.start.tolist(), w.end.tolist()
                out: list[list] = [[], [], [], []]
                for i, (doc, items) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    gone = covered(b - a, items or [], window, lambda v, doc=doc: v < doc)
                    stay = np.flatnonzero(~gone) + a
                    kept = b" ".join([data[start[j] : end[j]] for j in stay.tolist()])
                    for to, v in zip(out, (b - a, int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()), strict=True):
                        to.append(v)
                yield batch(schema, part.column(0), *out)

        return each

    return arrow_map(with_found(docs, found), "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string", make)
