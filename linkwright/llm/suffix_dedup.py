"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `window` bytes, by
most-significant-digit passes of eight bytes each; a group that has shrunk to
one suffix is done.  What is still together after the last digit are exactly
the repeated windows.  The first two digits of this sort are hashes (anchor and
context, see repeats.py): they deal suffixes out and settle most groups without
reading their bytes again.

Defined results: a null text is empty; every row is a document, so equal rows
repeat each other whatever their doc_id; texts shorter than the window stay
whole; an empty table gives no rows.
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
from linkwright.llm.words import chunks, ranges, text_bytes

WINDOW = 200
GRAM = 48


def radix_counts(contents: list[bytes], weights: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each content, how often it occurs: the sum of its holders' weights."""
    size = np.array([len(c) for c in contents])
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(contents) + bytes(8), np.uint8).astype(np.uint64)
    digits = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        digits |= data[k : len(data) - 7 + k] << np.uint64(56 - 8 * k)
    many = size - window + 1
    starts = ranges(first, many)
    value = np.repeat(weights, many)
    weight = value.copy()
    todo, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, window, 8):
        digit = digits[starts[todo] + depth]
        if window - depth < 8:
            digit >>= np.uint64(8 * (8 - window + depth))
        order = np.lexsort((digit, group))
        todo, group, digit = todo[order], group[order], digit[order]
        fresh = np.ones(len(todo), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(fresh) - 1
        together = np.bincount(group)[group] > 1 if len(group) else np.empty(0, bool)
        todo, group = todo[together], group[together]
    if len(todo):
        group = np.unique(group, return_inverse=True)[1]
        value[todo] = np.bincount(group, weight[todo]).astype(np.int64)[group]
    return np.split(value, np.cumsum(many)[:-1])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and kept_sha256 of every row."""
    docs = keyed(docs)
    unit = Unit("bytes", window, gram)
    found = repeated(docs, unit, F.count("*"), F.sum, radix_counts, lambda v: v > 1, hot_contexts)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows):
                data, at = text_bytes(part.column(1))
                out: list[list] = [[], [], [], [], []]
                for i, items in enumerate(part.column(2).to_pylist()):
                    own = data[at[i] : at[i + 1]]
                    gone = covered(len(own), items or [], window, lambda v: v > 1)
                    kept = own[~gone].tobytes()
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    for to, v in zip(out, (len(own), int(gone.sum()), spans, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                        to.append(v)
                yield batch(schema, part.column(0), *out)

        return each

    return arrow_map(with_found(docs, found), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string", make)
