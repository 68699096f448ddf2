"""The whole run: sources to entities, suggestions and statistics; with a store, identity persists across runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwright.operators.checkpoint import saved
from linkwright.operators.extract import ats_records, csv_records, normalized, profile_records, resume_records
from linkwright.operators.linkage import bridging_conflicts, cluster_ids, greedy_clusters, identifiers, prioritized_owner
from linkwright.operators.project import default_projection
from linkwright.operators.resolve import conflicts, entities, scalar_fields, supported, values
from linkwright.operators.store import Store
from linkwright.operators.suggest import suggestions
from linkwright.operators.validate import validated


@dataclass
class Result:
    entities: DataFrame
    conflicts: DataFrame
    suggestions: DataFrame
    output: DataFrame
    stats: DataFrame


def all_records(csv: DataFrame | None = None, ats: DataFrame | None = None, resumes: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Normalised records of all sources, in arrival order: recruiter rows, ATS rows, resumes, then the profiles that these link to."""
    parts = [read(rows) for read, rows in ((csv_records, csv), (ats_records, ats), (resume_records, resumes)) if rows is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if profiles is not None:
        out = out.unionByName(profile_records(profiles, out), allowMissingColumns=True)
    return normalized(out)


def run(records: DataFrame, store: Store | None = None, threshold: float = 0.6) -> Result:
    clusters = greedy_clusters(records)
    ids = cluster_ids(records, clusters)
    keyed = identifiers(records).join(clusters, "ext_seq")
    index = store.read("identity") if store else None
    if index is not None:
        owner = prioritized_owner(keyed, index)
        ids = ids.join(owner, "cluster", "left").withColumn("candidate_id", F.coalesce("owner", "candidate_id")).drop("owner")
        alerts = bridging_conflicts(keyed, index).join(owner, "cluster").select(
            F.col("owner").alias("primary_candidate_id"), F.array_remove("owners", F.col("owner")).alias("bridged_candidate_ids"), F.lit("exact_identifier_bridge").alias("reason"), F.lit(0.95).alias("score"))
        store.append("alerts", alerts)
    if store:
        owned = keyed.join(ids.select("cluster", "candidate_id"), "cluster").select("kind", "value", "candidate_id", "ext_seq")
        owned = saved(owned, "owned")
        members, clusters, ids, turn = with_stored(records, clusters, ids, store)
        changed = saved(entities(members, clusters, ids), "changed")
        vals = values(members, clusters)
        # the records are the source of truth, so they are stored before what is made of them
        store.upsert("records", members, RECORD_KEY, "ext_seq")
        store.upsert("entities", changed, ["candidate_id"], "cluster")
        store.upsert("identity", owned.withColumn("ext_seq", F.col("ext_seq") + turn * RUN_STEP), ["kind", "value"], "ext_seq")
        found = store.read("entities")
    else:
        found = entities(records, clusters, ids)
        vals = values(records, clusters)
    stats = records.agg(F.count("*").alias("processed")).join(found.agg(F.count("*").alias("merged")))
    return Result(found, conflicts(vals, scalar_fields(supported(vals))), suggestions(found, threshold), validated(default_projection(found)), stats)


#: Places of one run's records, above all of the run before.
RUN_STEP = 1 << 42
#: A record that comes again takes its former place.
RECORD_KEY = ["candidate_id", "source", "ext_id"]


def with_stored(records: DataFrame, clusters: DataFrame, ids: DataFrame, store: Store) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The new records and all stored ones of the entities that they belong to; their clusters and ids; the run's number.

    An entity has one cluster, however many the run found for it, so nothing that
    was stored is lost.  Stored records come first, in the order in which they came.
    """
    old = store.read("records")
    last = None if old is None else old.agg(F.max("ext_seq")).first()[0]
    turn = 0 if last is None else last // RUN_STEP + 1
    new = records.join(clusters, "ext_seq").join(ids.select("cluster", "candidate_id"), "cluster").drop("cluster").withColumn("ext_seq", F.col("ext_seq") + turn * RUN_STEP)
    if old is not None:
        touched = new.select("candidate_id").distinct()
        new = old.join(touched, "candidate_id", "left_semi").unionByName(new, allowMissingColumns=True)
    place = Window.partitionBy(*RECORD_KEY)
    latest = new.withColumn("_n", F.row_number().over(place.orderBy(F.desc("ext_seq")))).withColumn("_first", F.min("ext_seq").over(place))
    members = saved(latest.filter("_n = 1").drop("ext_seq", "_n").withColumnRenamed("_first", "ext_seq"), "members")
    clusters = members.withColumn("cluster", F.min("ext_seq").over(Window.partitionBy("candidate_id"))).select("ext_seq", "cluster", "candidate_id")
    owner = clusters.select("cluster", F.col("candidate_id").alias("owner")).distinct()
    clusters = saved(clusters.select("ext_seq", "cluster"), "clusters")
    ids = cluster_ids(members, clusters).drop("candidate_id").join(owner, "cluster").select("cluster", "join_key", F.col("owner").alias("candidate_id"))
    return members, clusters, ids, turn


def records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkwright.sources.derived import derived

    return all_records(derived(spark, sf_dir, "csv"), derived(spark, sf_dir, "ats"))
