"""Identity: identifiers, clusters, stable ids, and the index that persists across runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions import columns as C
from linkwright.operators.components import connected_components


def identifiers(records: DataFrame) -> DataFrame:
    """kind, value and ext_seq of every identifier of normalised records."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("github", F.lower(F.trim("github"))), ("email", F.lower(F.trim("email"))), ("phone", F.col("phone")))])
    more = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    pairs = F.concat(pairs, more("email", "more_emails"), more("phone", "more_phones"))
    return records.select("ext_seq", F.explode(pairs).alias("i")).select("i.*", "ext_seq").filter("value <> ''").distinct()


def component_clusters(records: DataFrame) -> DataFrame:
    """ext_seq and cluster (the smallest ext_seq reachable through shared identifiers) of every record.

    A record meets its identifier's first holder only, so the edges grow with the records, not with their pairs.
    """
    ids = identifiers(records)
    first = ids.groupBy("kind", "value").agg(F.min("ext_seq").alias("dst"))
    edges = ids.join(first, ["kind", "value"]).filter("ext_seq <> dst").select(F.col("ext_seq").alias("src"), "dst")
    found = connected_components(edges)
    return records.select("ext_seq").join(found.withColumnRenamed("node", "ext_seq"), "ext_seq", "left").select("ext_seq", F.coalesce("component", "ext_seq").alias("cluster"))


def greedy_clusters(records: DataFrame) -> DataFrame:
    """ext_seq and cluster (its first record) by arrival: a record joins the earliest cluster that holds one of its identifiers.

    Clusters never cross components, so each component of several records is
    replayed by itself.
    """
    components = component_clusters(records)
    several = components.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    keys = identifiers(records).groupBy("ext_seq").agg(F.collect_list(F.concat_ws(":", "kind", "value")).alias("keys"))

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        owners: dict[str, list[int]] = {}
        firsts: list[int] = []
        out = []
        for seq, keys in rows.sort_values("ext_seq")[["ext_seq", "keys"]].itertuples(index=False):
            joined = min((c for k in keys for c in owners.get(k, ())), default=len(firsts))
            if joined == len(firsts):
                firsts.append(seq)
            for k in keys:
                held = owners.setdefault(k, [])
                if joined not in held:
                    held.append(joined)
            out.append((seq, firsts[joined]))
        return pd.DataFrame(out, columns=["ext_seq", "cluster"])

    inside = components.join(several, "cluster", "left_semi").join(keys, "ext_seq")
    replayed = inside.groupBy("cluster").applyInPandas(replay, "ext_seq long, cluster long")
    alone = components.join(several, "cluster", "left_anti").select("ext_seq", "cluster")
    return alone.unionByName(replayed)


def cluster_ids(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, join_key and candidate_id: version-5 UUID of the first github link, else address, else phone, else record id."""
    rows = records.join(clusters, "ext_seq")
    first = lambda c: F.min_by(c, F.when(c.isNotNull() & (c != ""), F.col("ext_seq")))
    agg = rows.groupBy("cluster").agg(first(F.lower(F.trim("github"))).alias("g"), first(F.lower(F.trim("email"))).alias("e"), first(F.col("phone")).alias("p"), first(F.col("ext_id")).alias("x"))
    key = F.coalesce(*[F.concat(F.lit(f"{k}:"), c) for k, c in (("github", "g"), ("email", "e"), ("phone", "p"), ("ext", "x"))])
    return agg.select("cluster", key.alias("join_key"), C.uuid5_oid(key).alias("candidate_id"))


def kind_rank(kind):
    return F.when(kind == "github", 0).when(kind == "email", 1).otherwise(2)


def prioritized_owner(cluster_ids_: DataFrame, index: DataFrame) -> DataFrame:
    """cluster and owner: the index's entity for the first identifier it knows, github before address before phone."""
    hits = cluster_ids_.join(index.select("kind", "value", "candidate_id"), ["kind", "value"])
    order = Window.partitionBy("cluster").orderBy(kind_rank(F.col("kind")), "ext_seq", "value")
    return hits.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("cluster", F.col("candidate_id").alias("owner"))


def bridging_conflicts(cluster_ids_: DataFrame, index: DataFrame) -> DataFrame:
    """cluster and owners (sorted) of every cluster whose identifiers belong to several entities."""
    hits = cluster_ids_.join(index.select("kind", "value", "candidate_id"), ["kind", "value"])
    return hits.groupBy("cluster").agg(F.array_sort(F.collect_set("candidate_id")).alias("owners")).filter(F.size("owners") > 1)


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """existing with new's rows put in; of several new rows of one key the last by `order` stays."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    latest = new.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")
    return existing.join(latest.select(*key), key, "left_anti").unionByName(latest.select(*existing.columns))
