"""Skill search and ranked full-text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_skill(entities: DataFrame, skill: str) -> DataFrame:
    return entities.filter(F.exists("skills", lambda s: F.lower(s["value"]) == skill.lower()))


def searchable(entities: DataFrame) -> DataFrame:
    """id and text of every entity: name, skills, then company and title of each job."""
    jobs = F.flatten(F.transform(F.coalesce("experience", F.array().cast("array<struct<company:string,title:string>>")), lambda x: F.array(x["company"], x["title"])))
    words = F.concat(F.array("full_name.value"), F.transform("skills", lambda s: s["value"]), jobs)
    return entities.select(F.col("candidate_id").alias("id"), F.array_join(F.filter(words, lambda w: w != ""), " ").alias("text"))


def ranked(found: DataFrame) -> DataFrame:
    """Best score first, ties to the smaller id."""
    return found.orderBy(F.desc("score"), "id")


def terms_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")


def inverted_index(texts: DataFrame) -> DataFrame:
    """id, term and tf of texts (id, text)."""
    return texts.select("id", F.explode(terms_of("text")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score of the texts that hold every term of the query; a larger score is better."""
    sizes = index.groupBy("id").agg(F.sum("tf").alias("size"))
    stats = sizes.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    hits = index.filter(F.col("term").isin([q.lower() for q in query]))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(df), "term").join(sizes, "id").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return joined.groupBy("id").agg(F.sum(score).alias("score"), F.count("*").alias("held")).filter(F.col("held") == len(set(q.lower() for q in query))).select("id", "score")


def bm25_of_texts(texts: DataFrame, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score as `bm25` gives them, straight from texts (id, text), a row each: only one row of counts is shuffled."""
    asked = sorted({q.lower() for q in query})

    def times(term: str) -> Column:
        return F.size(F.filter("terms", lambda t: t == term))

    rows = texts.select("id", terms_of("text").alias("terms")).filter(F.size("terms") > 0)
    rows = rows.select("id", F.size("terms").alias("size"), *[times(q).alias(f"tf{i}") for i, q in enumerate(asked)])
    stats = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    held = rows.filter(" AND ".join(f"tf{i} > 0" for i in range(len(asked)))).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(asked)):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        score += F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return held.select("id", score.alias("score"))
