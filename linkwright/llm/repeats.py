"""Repeated windows across documents: what the two exact substring operators share.

Every window of n units (bytes or words) holds n - g + 1 g-grams; the one of
least hash is its anchor.  Equal windows have equal anchors at equal places, so
windows need comparing only where anchors are equal.  Consecutive windows with
one anchor make a run, whose content, at most 2n - g units, is its context:

* runs are counted by (anchor, context), which merges copies before any shuffle
  gets large, however many there are;
* an anchor with one context is settled: its windows repeat as the context does;
* the contexts of other anchors are dealt by anchor to shards of bounded size,
  where the operator's own index compares their windows by content;
* an anchor with over HOT_CONTEXTS contexts could outgrow a shard, so its
  windows are dealt by their own hash of 128 bits and summed before the shuffle.

Only content that some other run's anchor shares is ever read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.runtime import arrow_map, batch, fetched, saved
from linkwright.llm.words import SPACE, Rolling, byte_values, chunks, mix, ranges, sliding_min, text_bytes, words

HOT_CONTEXTS = 2000
#: Contexts of one shard, on average.
SHARD_CONTEXTS = 6000


class Unit:
    """Bytes or words of texts: their values, as hashes, and each text's first."""

    def __init__(self, kind: str, window: int, gram: int):
        self.kind, self.window, self.gram = kind, window, gram

    def values(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "bytes":
            data, at = text_bytes(texts)
            return byte_values(data), at
        w = words(texts, SPACE, lower=False)
        return mix(w.hash), w.first

    def runs(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """text, first and last window start in it, anchor and context of every run."""
        values, first = self.values(texts)
        size = np.maximum(np.diff(first) - self.window + 1, 0)
        starts = ranges(first[:-1], size)
        if not len(starts):
            none = np.empty(0, np.int64)
            return none, none, none, none, none
        text = np.repeat(np.arange(len(size)), size)
        grams = Rolling(values, seed=4).grams(self.gram)
        anchor = sliding_min(grams, self.window - self.gram + 1)[starts]
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(starts)) - 1
        a, b, p = starts[begin], starts[end], anchor[begin]
        context = mix(Rolling(values, seed=5).spans(a, b + self.window) ^ mix((p - a).astype(np.uint64)))
        own = first[:-1][text[begin]]
        return text[begin], a - own, b - own, grams[p].view(np.int64), context.view(np.int64)

    def content(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What a shard compares: the bytes themselves, or the words' hashes."""
        if self.kind == "bytes":
            return text_bytes(texts)
        w = words(texts, SPACE, lower=False)
        return w.hash.view(np.int64), w.first


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text; rows with both equal have equal results."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("key"))


def occurrences(docs: DataFrame, unit: Unit) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("anchor", pa.int64()), ("context", pa.int64())])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows):
                text, a, b, anchor, context = unit.runs(part.column(1))
                if len(text):
                    text = pa.array(text)
                    yield batch(schema, part.column(0).take(text), part.column(2).take(text), a, b, anchor, context)

        return each

    return arrow_map(docs, "doc_id long, key long, a int, b int, anchor long, context long", make)


def contents(docs: DataFrame, chosen: DataFrame, unit: Unit) -> DataFrame:
    """anchor, context, weight and content of each chosen context, read from the document named with it."""
    wanted = chosen.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "context", "weight", "a", "b")).alias("wanted"))
    kind = pa.binary() if unit.kind == "bytes" else pa.list_(pa.int64())
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("weight", pa.int64()), ("content", kind)])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows, "text"):
                values, first = unit.content(part.column(0))
                out: list[list] = [[], [], [], []]
                for i, items in enumerate(part.column(1).to_pylist()):
                    for x in items:
                        own = values[first[i] + x["a"] : first[i] + x["b"] + unit.window]
                        for to, v in zip(out, (x["anchor"], x["context"], x["weight"], own.tobytes() if unit.kind == "bytes" else own), strict=True):
                            to.append(v)
                yield batch(schema, *out)

        return each

    joined = fetched(docs, saved(wanted, "wanted")).select("text", "wanted")
    return arrow_map(joined, f"anchor long, context long, weight long, content {'binary' if unit.kind == 'bytes' else 'array<bigint>'}", make)


def by_window_hash(hot: DataFrame, unit: Unit, combine: Callable[[str], Column]) -> DataFrame:
    """Values of each context's windows, for anchors with too many contexts for a shard."""
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("at", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("weight", pa.int64())])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for anchor, context, weight, content in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                values = byte_values(np.frombuffer(content, np.uint8)) if unit.kind == "bytes" else mix(np.array(content, np.int64).view(np.uint64))
                w1, w2 = (Rolling(values, seed=s).grams(unit.window).view(np.int64) for s in (6, 7))
                n = len(w1)
                yield batch(schema, np.full(n, anchor), np.full(n, context), np.arange(n), w1, w2, np.full(n, weight))

        return each

    windows = saved(arrow_map(hot, "anchor long, context long, at int, w1 long, w2 long, weight long", make), "windows")
    summed = windows.groupBy("w1", "w2").agg(combine("weight").alias("value"))
    return windows.join(summed, ["w1", "w2"]).groupBy("anchor", "context").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("marks"))


def repeated(docs: DataFrame, unit: Unit, weigh: Column, combine: Callable[[str], Column], compare: Callable, keep: Callable[[Column], Column], hot_contexts: int = HOT_CONTEXTS, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_id, key and found: (a, b, whole, marks) of its runs with a window to remove.

    A context's weight is `weigh` over its runs and a window's value is
    `combine` over the weights of the contexts that hold it: `whole` where all
    windows of a run agree, else marks, one for each window.  compare(contents,
    weights, window) gives a shard's values.  keep(value) says which runs stay.
    """
    runs = saved(occurrences(docs, unit), "runs")
    kinds = saved(runs.groupBy("anchor", "context").agg(weigh.alias("weight"), F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "a", "b")).alias("one")), "contexts")
    shared = kinds.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1").drop("total")
    shared = saved(kinds.drop("n").join(shared, "anchor"), "shared")
    single = shared.filter("kinds = 1").select("anchor", "context", F.col("weight").alias("whole"), F.lit(None).cast("array<bigint>").alias("marks"))
    several = shared.filter("kinds > 1").select("anchor", "context", "weight", "kinds", "one.*")
    # a repeated row is read twice, which `distinct` mends
    read = saved(contents(docs, several, unit).distinct(), "contents")
    over = several.filter(F.col("kinds") > hot_contexts).select("anchor").distinct()
    hot = read.join(over, "anchor", "left_semi")
    cool = read.join(over, "anchor", "left_anti")
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-read.count() // shard_contexts))

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        marks = compare(rows["content"].tolist(), rows["weight"].to_numpy(np.int64), unit.window)
        return pd.DataFrame({"anchor": rows["anchor"], "context": rows["context"], "marks": marks})

    dealt = cool.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
    marked = dealt.applyInPandas(compared, "anchor long, context long, marks array<bigint>")
    if hot.take(1):
        marked = marked.unionByName(by_window_hash(hot, unit, combine))
    verdicts = single.unionByName(marked.select("anchor", "context", F.lit(None).cast("long").alias("whole"), "marks"))
    keeps = F.coalesce(keep(F.col("whole")), F.exists("marks", keep))
    found = runs.join(verdicts, ["anchor", "context"]).filter(keeps)
    return found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("a", "b", "whole", "marks")).alias("found"))


def covered(size: int, found: list[dict], window: int, keep: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Which of a text's units some window to remove covers."""
    edge = np.zeros(size + 1, np.int64)
    for x in found:
        starts = np.arange(x["a"], x["b"] + 1)
        starts = starts[keep(np.full(len(starts), x["whole"]) if x["marks"] is None else np.array(x["marks"]))]
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:-1] > 0


def with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text and found of every row."""
    return fetched(docs, saved(found, "found"), "left").select("doc_id", "text", "found")
