"""Values of one entity from many records: grouping, winners, conflicts, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions import columns as C
from linkwright.functions.constants import DISAGREEMENT_PENALTY, SOURCE_PRIORITY

LIST_FIELDS = ("emails", "phones", "skills")


def values(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, field, value, source, confidence and ord (arrival) of every value of normalised records."""
    one = lambda field, col, conf: F.array(F.struct(F.lit(field).alias("field"), F.col(col).alias("value"), conf.alias("confidence"), F.lit(0).alias("pos")))
    skills = F.transform("skills", lambda s, i: F.struct(F.lit("skills").alias("field"), s.alias("value"), F.coalesce("skill_base", "base").alias("confidence"), i.alias("pos")))
    more = lambda field, col, conf: F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(field).alias("field"), x.alias("value"), F.col(conf).alias("confidence"), (i + 1).alias("pos")))
    all_values = F.concat(one("full_name", "name", F.col("base")), one("emails", "email", F.col("email_confidence")), one("phones", "phone", F.col("base")), one("location", "location", F.col("base")), more("emails", "more_emails", "email_confidence"), more("phones", "more_phones", "base"), skills)
    rows = records.join(clusters, "ext_seq").select("cluster", "ext_seq", "source", F.explode(all_values).alias("v"))
    return rows.select("cluster", "v.field", "v.value", "source", "v.confidence", F.struct("ext_seq", "v.pos").alias("ord")).filter("value IS NOT NULL")


def supported(vals: DataFrame) -> DataFrame:
    """One row for each (cluster, field, spelling group): last spelling, noisy-or of the best confidence of each source, priority, first arrival, and each source with its confidence and place."""
    key = F.lower(F.trim("value"))
    by_source = vals.withColumn("k", key).groupBy("cluster", "field", "k", "source").agg(
        F.max("confidence").alias("c"), F.min("ord").alias("first"), F.max("ord").alias("last"), F.max_by("value", "ord").alias("value"))
    priority = F.coalesce(C.literal_map(SOURCE_PRIORITY)[F.col("source")], F.lit(0.0))
    grouped = by_source.groupBy("cluster", "field", "k").agg(
        F.max_by("value", "last").alias("value"), F.min("first").alias("first"), F.max(priority).alias("priority"),
        F.array_sort(F.collect_list(F.struct("source", "c", F.col("first").alias("at")))).alias("support"))
    confidences = F.transform("support", lambda s: s["c"])
    alone = F.get(confidences, F.lit(0))
    return grouped.withColumn("confidence", C.clamp(F.when(F.size("support") == 1, alone).otherwise(C.noisy_or(confidences))))


def list_fields(groups: DataFrame) -> DataFrame:
    """cluster, field, value, confidence and first of list fields: every group stays, none conflicts."""
    return groups.filter(F.col("field").isin(*LIST_FIELDS)).select("cluster", "field", "value", "confidence", "first", F.transform("support", lambda s: s["source"]).alias("sources"), "support")


def scalar_fields(groups: DataFrame) -> DataFrame:
    """The same with `won`: of a scalar field's groups the one of highest source priority, then first arrival; confidence is lowered where others disagree."""
    scalar = groups.filter(~F.col("field").isin(*LIST_FIELDS))
    whole = Window.partitionBy("cluster", "field")
    ranked = scalar.withColumn("rn", F.row_number().over(whole.orderBy(F.desc("priority"), "first"))).withColumn("n", F.count("*").over(whole))
    lowered = F.when(F.col("n") > 1, F.col("confidence") * DISAGREEMENT_PENALTY).otherwise(F.col("confidence"))
    return ranked.select("cluster", "field", "value", C.clamp(lowered).alias("confidence"), "support", "first", (F.col("rn") == 1).alias("won"))


def conflicts(vals: DataFrame, scalars: DataFrame) -> DataFrame:
    """cluster, field, value, source and confidence: one row for each value that lost, as each source gave it."""
    lost = scalars.filter(~F.col("won")).select("cluster", "field", F.col("value").alias("shown"), F.lower(F.trim("value")).alias("k"))
    return vals.withColumn("k", F.lower(F.trim("value"))).join(lost, ["cluster", "field", "k"]).select("cluster", "field", F.col("shown").alias("value"), "source", "confidence")


def links(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster and github: the link of highest source priority, the later of equals."""
    priority = F.coalesce(C.literal_map(SOURCE_PRIORITY)[F.col("source")], F.lit(0.0))
    rows = records.join(clusters, "ext_seq").filter("github IS NOT NULL")
    return rows.groupBy("cluster").agg(F.max_by("github", F.struct(priority, "ext_seq")).alias("github"))


def experience(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster and experience: distinct (company, title) in order of first arrival."""
    rows = records.join(clusters, "ext_seq").filter("company IS NOT NULL OR title IS NOT NULL")
    once = rows.groupBy("cluster", "company", "title").agg(F.min("ext_seq").alias("first"))
    return once.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "company", "title"))), lambda x: F.struct(x["company"].alias("company"), x["title"].alias("title"))).alias("experience"))


def education(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster and education: distinct institutions in order of first arrival."""
    rows = records.join(clusters, "ext_seq").select("cluster", "ext_seq", F.posexplode("education").alias("pos", "institution"))
    once = rows.groupBy("cluster", "institution").agg(F.min(F.struct("ext_seq", "pos")).alias("first"))
    return once.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "institution"))), lambda x: x["institution"]).alias("education"))


def entities(records: DataFrame, clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """One row an entity: ids, fields with confidences, lists, links, experience, education, overall confidence and review flag."""
    vals = values(records, clusters)
    groups = supported(vals)
    scalars = scalar_fields(groups)
    won = scalars.filter("won").groupBy("cluster").agg(*[
        F.max(F.when(F.col("field") == f, F.struct("value", "confidence", F.transform("support", lambda s: s["source"]).alias("sources"), "support"))).alias(f) for f in ("full_name", "location")])
    item = F.struct("first", "value", "confidence", "sources", "support")
    lists = list_fields(groups).groupBy("cluster").agg(*[F.array_sort(F.collect_list(F.when(F.col("field") == f, item))).alias(f) for f in LIST_FIELDS])
    out = ids
    for part in (won, lists, links(records, clusters), experience(records, clusters), education(records, clusters)):
        out = out.join(part, "cluster", "left")
    for f in LIST_FIELDS:
        out = out.withColumn(f, F.coalesce(F.col(f), F.array().cast(lists.schema[f].dataType)))
    best = lambda f: F.coalesce(F.array_max(F.transform(f, lambda x: x["confidence"])), F.lit(0.0))
    skill_mean = F.when(F.size("skills") > 0, F.aggregate("skills", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size("skills")).otherwise(0.0)
    overall = (F.coalesce(F.col("full_name.confidence"), F.lit(0.0)) + best("emails") + best("phones") + skill_mean) / 4.0
    out = out.withColumn("overall_confidence", F.bround(C.clamp(overall), 3))
    flag = (F.col("overall_confidence") < 0.5) | (F.coalesce(F.col("full_name.value"), F.lit("")) == "") | (F.size("emails") == 0)
    return out.withColumn("needs_human_review", flag)
