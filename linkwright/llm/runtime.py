"""Shared-storage checkpoints, bounded broadcasts and ranks for the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.checkpoint import saved, shared_folder


def release() -> None:
    """What the allocators keep of freed buffers goes back: a worker outlives its task, and its memory counts while later ones run."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(c := ctypes.CDLL(None), "malloc_trim"):
        c.malloc_trim(0)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """mapInArrow with state for each task: make() is called once in it, its result for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)
        each = batch = None
        release()

    return df.mapInArrow(run, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def arrow_type(df: DataFrame, column: str = "doc_id") -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def rest_of(carry: tuple[str, ...]) -> list[Column]:
    """One struct `rest` of the columns named, without the text, or nothing."""
    return [F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry if c != "text"]).alias("rest")] if carry else []


def columns_of(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from the text and the `rest` that came along."""
    return found.select(*[F.col("text" if c == "text" else f"rest.`{c}`").alias(c) for c in docs.columns])


def shuffle_tasks(spark: SparkSession, rows: int, each: int = 200_000) -> int:
    """Partitions for so many rows: never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


#: Rows of two or three numbers that are broadcast; beyond it the texts are shuffled instead.
BROADCAST_ROWS = 300_000


def fetched(docs: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """docs (doc_id, text, key) joined with wanted by doc_id (null-safe) and key.

    If the wanted keys are few (counted, not guessed), they are broadcast so
    that no other text enters the shuffle; if they aren't, both sides shuffle.
    """
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.key") == F.col("w.key"))
    if wanted.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        joined = docs.alias("d").join(wanted.alias("w"), same, how)
        return joined.drop(F.col("w.doc_id"), F.col("w.key"))
    keys = F.broadcast(wanted.select("doc_id", "key")).alias("w")
    own = docs.alias("d").join(keys, same, "left_semi")
    out = own.alias("d").join(wanted.alias("w"), same).drop(F.col("w.doc_id"), F.col("w.key"))
    if how == "left":
        rest = docs.alias("d").join(keys, same, "left_anti")
        out = out.unionByName(rest, allowMissingColumns=True)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Spark frees the shuffle files of frames that are no longer held once Python and the driver's JVM have collected them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `rank`, gapless from 0 in the given order, without a single-partition sort.

    Rows are dealt by ranges of the order and numbered within each part; the
    driver sees one count for each part.
    """
    spark: SparkSession = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in order]
    dealt = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)
    dealt = dealt.withColumn("_at", F.monotonically_increasing_id())
    kept = saved(dealt.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_in")).drop("_at"), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())
    base, total = {}, 0
    for part, n in counts:
        base[part], total = total, total + n
    if not base:
        return kept.select("*", F.lit(0).cast("long").alias("rank")).drop("_part", "_in")
    table = F.create_map(*[F.lit(x).cast("long") for kv in base.items() for x in kv])
    return kept.withColumn("rank", table[F.col("_part")] + F.col("_in")).drop("_part", "_in")


__all__ = ["BROADCAST_ROWS", "columns_of", "fetched", "free_shuffles", "arrow_map", "arrow_type", "batch", "id_type", "numbered", "release", "rest_of", "saved", "shared_folder", "shuffle_tasks"]
