"""Benchmark decontamination by winnowing.

Any window of `width` words holds width - k + 1 k-grams, and the least hash
among those is a fingerprint of it.  Documents and benchmark items keep the
least k-gram hash of each such window, so whatever window they share, they
share its fingerprint: no shared span of `width` words is missed.  Where a
document's fingerprint is one of the benchmark's, the hit is extended to every
window around it and each is compared with the benchmark's windows word for
word.  Items shorter than `width` are one window of their own length; these are
looked up among the document's n-grams of that length.

The benchmark is read in blocks of at most BLOCK_WORDS words; each block is
broadcast once and all documents pass over it, so a benchmark of any size is
done with bounded memory.  Documents are never shuffled.

Defined results: null or wordless texts have no words and are never hit; items
without words have no window; items of equal id count once, and a null id is
not counted as an item though its words are hit; every row of `documents` gives
a row, repeated or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linkwright.llm.runtime import arrow_map, arrow_type, batch, id_type, rest_of, saved
from linkwright.llm.words import ALNUM, Rolling, chunks, mix, ranges, sliding_min, words

WIDTH = 10
GRAM = 5
#: Benchmark words that are broadcast at once.
BLOCK_WORDS = 2_000_000


class Windows:
    """The windows of one length of a block of items: distinct hashes, one place of each, the items that hold it."""

    def __init__(self, hashes: np.ndarray, place: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, hashes))
        hashes, place, item = hashes[order], place[order], item[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        self.hashes, self.place = hashes[fresh], place[fresh]
        own = fresh.copy()
        own[1:] |= item[1:] != item[:-1]
        self.items = item[own]
        self.first = np.append(np.searchsorted(hashes[own], self.hashes), len(self.items))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash among the distinct ones, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


class Block:
    """What documents are compared with: word hashes of some items, their windows and fingerprints."""

    def __init__(self, items: list[tuple[object, str | None]], width: int, gram: int):
        self.width, self.gram = width, gram
        w = words(pa.array([t for _, t in items], pa.string()), ALNUM)
        self.words = w.hash
        self.ids = [None if i is None else str(i) for i, _ in items]
        size = np.diff(w.first)
        rolling = Rolling(mix(w.hash), seed=2)
        self.windows: dict[int, Windows] = {}
        for n in {*np.unique(size[(size > 0) & (size < width)]).tolist(), width}:
            chosen = np.flatnonzero(size >= width if n == width else size == n)
            start = ranges(w.first[chosen], size[chosen] - n + 1)
            self.windows[n] = Windows(rolling.spans(start, start + n), start, np.repeat(chosen, size[chosen] - n + 1))
        # the least gram of each full window, by the very rule that documents follow
        grams = rolling.grams(gram)
        starts = ranges(w.first[np.flatnonzero(size >= width)], size[size >= width] - width + 1)
        least = sliding_min(grams, width - gram + 1)
        self.prints = np.unique(grams[least[starts]]) if len(starts) else np.empty(0, np.uint64)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts' words: which are hit; pairs of text and item number."""
        hit = np.zeros(len(hashes) + 1, np.int64)
        texts, items = [], []
        rolling = Rolling(mix(hashes), seed=2)
        size = np.diff(first)
        for n, windows in self.windows.items():
            starts = ranges(first[:-1], np.maximum(size - n + 1, 0))
            if not len(starts) or not len(windows.hashes):
                continue
            if n == self.width:  # only windows whose fingerprint the benchmark has
                grams = rolling.grams(self.gram)
                least = sliding_min(grams, n - self.gram + 1)[starts]
                at = np.minimum(np.searchsorted(self.prints, grams), len(self.prints) - 1)
                starts = starts[(self.prints[at] == grams)[least]]
            found = windows.find(rolling.spans(starts, starts + n))
            starts, found = starts[found >= 0], found[found >= 0]
            if not len(starts):
                continue
            steps = np.arange(n)
            same = (hashes[starts[:, None] + steps] == self.words[windows.place[found][:, None] + steps]).all(axis=1)
            starts, found = starts[same], found[same]
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + n, -1)
            # each distinct window counts once in a text before its items are listed
            text = np.searchsorted(first, starts, "right") - 1
            pairs = np.unique(np.stack([text, found], axis=1), axis=0)
            many = windows.first[pairs[:, 1] + 1] - windows.first[pairs[:, 1]]
            texts.append(np.repeat(pairs[:, 0], many))
            items.append(windows.items[ranges(windows.first[pairs[:, 1]], many)])
        return np.cumsum(hit)[:-1] > 0, np.concatenate([*texts, np.empty(0, np.int64)]), np.concatenate([*items, np.empty(0, np.int64)])


def blocks(benchmark: DataFrame, most: int) -> list[DataFrame]:
    """The benchmark in parts of about `most` words; one part if it is no larger."""
    sized = benchmark.select("item_id", "text", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    n = -(-(sized.agg(F.sum("n")).first()[0] or 0) // (2 * most)) or 1  # a word is at least a letter and a gap
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [sized.filter(part == i).select("item_id", "text") for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, gram: int = GRAM, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_words, spans (word ranges hit, merged) and items (ids as strings, sorted), a row for each document.

    Columns named in `carry`, but for the text, come along in one struct, `rest`.
    """
    spark = docs.sparkSession
    kind = arrow_type(docs)
    schema = pa.schema([("doc_id", kind), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
    ddl = f"doc_id {id_type(docs)}, text string, n_words long, spans array<array<bigint>>, items array<string>"
    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"), *rest_of(carry))
    if carry:
        ddl += f", rest {out.schema['rest'].dataType.simpleString()}"
        schema = schema.append(pa.field("rest", to_arrow_type(out.schema["rest"].dataType)))
    parts = blocks(benchmark, block_words)
    for b, part in enumerate(parts):
        shared = spark.sparkContext.broadcast(part.collect())

        def make(shared=shared):
            block = Block([tuple(r) for r in shared.value], width, gram)

            def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for chunk in chunks(rows):
                    yield batch(schema, *marked(block, chunk))

            return each

        out = arrow_map(out, ddl, make)
        if b + 1 < len(parts):
            out = saved(out, "decontaminate")
    return out


def marked(block: Block, chunk: pa.RecordBatch) -> list:
    w = words(chunk.column(1), ALNUM)
    hit, text, item = block.hits(w.hash, w.first)
    spans, items = chunk.column(3).to_pylist(), chunk.column(4).to_pylist()
    for i in np.unique(np.searchsorted(w.first, np.flatnonzero(hit), "right") - 1).tolist():
        own = hit[w.first[i] : w.first[i + 1]].copy()
        for a, b in spans[i]:
            own[a:b] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        spans[i] = edges.reshape(-1, 2).tolist()
        items[i] = sorted({*items[i], *(block.ids[j] for j in item[text == i].tolist() if block.ids[j] is not None)})
    return [chunk.column(0), chunk.column(1), np.diff(w.first), spans, items, *chunk.columns[5:]]


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    found = contamination(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
