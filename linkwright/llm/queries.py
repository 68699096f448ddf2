"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.decontaminate import contaminated_documents

    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.language import identify

    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    found = identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op4_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.vptree import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.substring_dedup import remove_seen

    return remove_seen(table(spark, sf_dir, "documents")).drop("kept")


def op7_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.hmm import score

    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.jaccard_join import join_components

    return join_components(table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from linkwright.llm import oracles

    return oracles.ORACLES
