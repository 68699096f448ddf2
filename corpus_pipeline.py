"""Corpus preparation in five stages, each written as Parquet and read again by the next.

run(spark, sf_dir) applies all of them to the documents; STAGES lists them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm.decontaminate import contamination
from linkwright.llm.jaccard_join import join_components
from linkwright.llm.language import UNKNOWN, identify
from linkwright.llm.packing import pack_documents
from linkwright.llm.pii import redacted, spans
from linkwright.llm.queries import remainder, table, tokenizer_path
from linkwright.llm.runtime import columns_of, saved

#: Near-duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are `und` (no text, or no letter in it) go; which language the others are in, and whether that is ambiguous, decides nothing here."""
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    found = identify(docs, ~held_out, carry=tuple(docs.columns))
    return columns_of(found.filter(F.col("lang_pred") != UNKNOWN), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one of smallest doc_id stays, and of its repeated rows the first as JSON.

    Documents without words stay; a null doc_id counts as the largest.  Only
    rows that repeat both doc_id and text are shuffled with their texts.
    """
    members = join_components(docs, SHINGLE, PERCENT).groupBy("part", "doc_id", "key").agg(F.count("*").alias("copies"))
    members = saved(members, "members")
    first = members.filter("part IS NOT NULL").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "copies")).alias("m"))
    keep = first.select("m.doc_id", "m.key", "m.copies").union(members.filter("part IS NULL").select("doc_id", "key", "copies"))
    keep = saved(keep, "keep").alias("k")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")  # the text in it
    own = docs.select(rest, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key")).alias("d")
    found = own.join(keep, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.key") == F.col("k.key")))
    kept = found.filter("copies = 1").select("rest")
    if keep.filter("copies > 1").take(1):
        again = found.filter("copies > 1").groupBy("d.doc_id", "d.key").agg(F.min_by("rest", F.to_json("rest")).alias("rest"))
        kept = kept.union(again.select("rest"))
    return kept.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return columns_of(found.filter(F.size("spans") == 0), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in the texts are replaced by their kinds; n_chars follows.  A null text stays null."""
    found = spans(docs, carry=tuple(docs.columns))
    clean = F.when(F.col("text").isNotNull(), redacted("concat(accepted, secrets)"))
    found = found.select("rest", clean.alias("text"))
    out = columns_of(found, docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in windows."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("packing", packing)]

#: Classifiers, components and packing are beyond SQL; the operators of all stages have tests against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
