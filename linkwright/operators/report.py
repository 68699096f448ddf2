"""Health summary and readable explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.columns import two_digits

ALL_SOURCES = ("recruiter.csv", "github_api", "ats.json")


def three_way(entities: DataFrame) -> Column:
    """Whether some value of the entity is held by all three sources."""
    wanted = F.array(*[F.lit(s) for s in ALL_SOURCES])
    covers = lambda sources: F.size(F.array_except(wanted, sources)) == 0
    lists = [F.exists(f, lambda x: covers(x["sources"])) for f in ("emails", "phones", "skills")]
    found = F.coalesce(covers(F.col("full_name.sources")), F.lit(False)) | F.coalesce(covers(F.col("location.sources")), F.lit(False))
    for one in lists:
        found = found | one
    return found


def summary(entities: DataFrame) -> DataFrame:
    """One row: entities, with an address, with github, mean confidence, flagged, agreed by three sources."""
    return entities.agg(
        F.count("*").alias("total"), F.count_if(F.size("emails") > 0).alias("with_email"), F.count_if(F.col("github").isNotNull()).alias("with_github"),
        F.bround(F.avg("overall_confidence"), 6).alias("avg_confidence"), F.count_if("needs_human_review").alias("flagged"), F.count_if(three_way(entities)).alias("three_way"))


# The sentences of an explanation.
NO_NAME, RULE = "Unknown", "-" * 47
ONLY_LANGUAGES = """  - all derived from github_api repo languages - lower confidence by design,
    since "wrote code in X" is weaker evidence than a stated/verified skill"""
LOW_SCORE = ", below review threshold after informativeness discount — see /suggest-duplicates for full breakdown)"


def flagged(entities: DataFrame) -> DataFrame:
    return entities.filter("needs_human_review")


def top_skills(entities: DataFrame, keep: int = 8) -> DataFrame:
    """candidate_id and the names of the most certain skills, earlier ones first among equals."""
    order = F.array_sort(F.transform("skills", lambda s: F.struct((-s["confidence"]).alias("c"), s["first"].alias("first"), s["value"].alias("value"))))
    return entities.select("candidate_id", F.transform(F.slice(order, 1, keep), lambda s: s["value"]).alias("skills"))


def agreement(support: Column) -> Column:
    """Who says so: each source once, in order of arrival, with its own best confidence."""
    each = F.transform(F.array_sort(F.transform(support, lambda s: F.struct(s["at"], s["source"], s["c"]))), lambda s: F.concat(s["source"], F.lit(" ("), two_digits(s["c"]), F.lit(")")))
    n = F.size(each)
    return (F.when(n == 1, F.concat(F.lit("from "), F.get(each, F.lit(0)), F.lit(" only"))).when(n == 2, F.concat(F.lit("agreed by "), F.array_join(each, " and ")))
            .when(n > 2, F.concat(F.lit("agreed by "), F.array_join(F.slice(each, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(each, -1))))


def explanations(entities: DataFrame, conflicts: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """candidate_id and text of every entity: name, first address, place, skills, review verdict and probable duplicates.

    A field's conflicts take the place of its agreement, each lost value once a
    source, by value and source.  `duplicates` are pairs (a, b, score) of any
    threshold; a pair is told on both sides, best score first.
    """
    say = lambda c: F.concat(F.lit('conflicting value "'), c["value"], F.lit('" also seen from '), c["source"])
    lost = conflicts.groupBy("cluster", "field").agg(F.concat(F.lit("(penalized: "), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("value", "source"))), say), "; "), F.lit(")")).alias("lost"))
    lost = lost.groupBy("cluster").agg(*[F.max(F.when(F.col("field") == f, F.col("lost"))).alias(f"lost_{f}") for f in ("full_name", "location", "emails")])
    e = entities.join(lost, "cluster", "left").withColumn("email", F.get("emails", F.lit(0)))

    def told(title: str, field: str, against: str) -> Column:
        it = F.col(field)
        quote = F.lit("" if field == "location" else '"')
        head = F.concat(F.lit(f"{title}: "), quote, it["value"], quote)
        return F.when(F.coalesce(it["value"], F.lit("")) != "", F.concat(head, F.lit("\n  - confidence "), two_digits(it["confidence"]), F.lit(" - "), F.coalesce(F.col(against), agreement(it["support"])), F.lit("\n")))

    nameless = F.coalesce("full_name.value", F.lit("")) == ""
    checks = [(nameless, "missing: full_name"), (F.size("emails") == 0, "missing: emails"), (F.size("phones") == 0, "missing: phone")]
    checks += [(F.col(f"lost_{f}").isNotNull(), f"low-agreement: {f}") for f in ("location", "full_name", "emails")]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in checks]))
    sources = F.array_distinct(F.flatten(F.transform("skills", lambda s: s["sources"])))
    from_where = F.when(sources == F.array(F.lit("github_api")), F.lit(ONLY_LANGUAGES)).otherwise(F.concat(F.lit("  - derived from "), F.size(sources).cast("string"), F.lit(" sources")))
    skills = F.array_join(F.transform("skills", lambda s: F.concat(s["value"], F.lit(" ("), two_digits(s["confidence"]), F.lit(")"))), ", ")
    overall = two_digits(F.col("overall_confidence"))
    lines = [
        F.concat(F.lit("Candidate: "), F.coalesce("full_name.value", F.lit(NO_NAME)), F.lit(" (confidence: "), overall, F.lit(")")), F.lit(RULE),
        told("full_name", "full_name", "lost_full_name"), told("primary email", "email", "lost_emails"), told("location", "location", "lost_location"),
        F.when(F.size("skills") > 0, F.concat(F.lit("skills ("), F.size("skills").cast("string"), F.lit("): "), skills, F.lit("\n"), from_where, F.lit("\n"))),
        F.concat(F.lit("! overall_confidence "), overall, F.when(F.col("needs_human_review"), F.concat(F.lit(" - FLAGGED FOR REVIEW ("), F.array_join(reasons, "; "), F.lit(")"))).otherwise(F.lit(" - no flags")))]
    if duplicates is not None:
        e = e.join(duplicate_lines(entities, duplicates), "cluster", "left")
        lines.append(F.col("duplicates"))
    return e.select("candidate_id", F.concat_ws("\n", *lines).alias("explanation"))


def duplicate_lines(entities: DataFrame, duplicates: DataFrame) -> DataFrame:
    """cluster and its lines on probable duplicates, from both sides of every pair."""
    sides = duplicates.select(F.col("a").alias("cluster"), F.col("b").alias("other"), "score").unionByName(duplicates.select(F.col("b").alias("cluster"), F.col("a").alias("other"), "score"))
    names = entities.select(F.col("cluster").alias("other"), F.coalesce("full_name.value", F.lit("")).alias("name"))
    tail = F.when(F.col("score") >= 0.6, F.lit(" — flagged for review)")).otherwise(F.lit(LOW_SCORE))
    line = F.concat(F.lit('  ! Possible duplicate of "'), F.col("name"), F.lit('" (score '), two_digits(F.col("score")), tail)
    each = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "other", line.alias("line"))))
    return sides.join(names, "other").groupBy("cluster").agg(F.array_join(F.transform(each, lambda x: x["line"]), "\n").alias("duplicates"))


def accuracy(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: keys found, missing and extra, and the share of equal values of each field among those found."""
    joined = expected.alias("e").join(actual.alias("a"), F.col(f"e.{key}") == F.col(f"a.{key}"), "full_outer")
    both = F.col(f"e.{key}").isNotNull() & F.col(f"a.{key}").isNotNull()
    equal = [F.avg(F.when(both, F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")).cast("int"))).alias(f"{f}_accuracy") for f in fields]
    return joined.agg(F.count_if(both).alias("found"), F.count_if(F.col(f"a.{key}").isNull()).alias("missing"), F.count_if(F.col(f"e.{key}").isNull()).alias("extra"), *equal)
