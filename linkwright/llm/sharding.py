"""Balanced label propagation: linked documents drawn to common shards of equal size.

Every document starts in the shard it hashes to itself, so linked ones start apart
and shards even.  In each round a document asks for the shard where most of its neighbours are,
if it gains links by that.  Moves between two shards are let through as far as
they are matched by moves the other way or by free capacity, so sizes stay
even; the driver sees one number for each pair of shards.  Half of the documents
move in a round, which keeps neighbours from changing places for ever.

Law `rows`: in the end what the rounds left apart of one group (the documents of
one home) takes the label that most of it has, documents are numbered by
(label, group, doc_id) and cut into shards whose counts are at most one apart; a cut divides a group at most
once for each border, and a group larger than a shard fills several.

Defined results: null texts are of size 1 and equal to each other; rows of one
doc_id have one label but places of their own; rows with a null doc_id have no
links; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.runtime import numbered, saved

SHARDS = 16
ROUNDS = 4
#: Share by which a label may exceed its even part while moving.
SLACK = 0.02


def equal_text_links(docs: DataFrame) -> DataFrame:
    """src, dst: each document with the least one of equal text; a star for each group, whatever its size."""
    rows = docs.filter("doc_id IS NOT NULL")
    group = F.struct(F.xxhash64("text"), F.crc32(F.col("text").cast("binary")), F.length("text"))
    keyed = rows.select("doc_id", group.alias("g"))
    hubs = keyed.groupBy("g").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(hubs, "g").filter("doc_id <> hub").select(F.col("hub").alias("src"), F.col("doc_id").alias("dst")).distinct()


def propagate(links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """node, home (its least neighbour or itself) and label for every linked document."""
    both = saved(links.select("src", "dst").union(links.select("dst", "src")).distinct(), "links")
    home = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("home"))
    labels = saved(home.withColumn("label", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")), "labels")
    for turn in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("vote")), "dst").groupBy(F.col("src").alias("node"), "vote").agg(F.count("*").alias("n"))
        asked = votes.join(labels, "node").groupBy("node").agg(
            F.max_by("vote", F.struct("n", -F.col("vote"))).alias("wish"), F.max("n").alias("most"),
            F.max(F.when(F.col("vote") == F.col("label"), F.col("n")).otherwise(0)).alias("has"), F.first("label").alias("label"))
        turned = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        movers = saved(asked.filter((F.col("most") > F.col("has")) & turned).select("node", "label", "wish"), "movers")
        wanted = {(r["label"], r["wish"]): r["n"] for r in movers.groupBy("label", "wish").agg(F.count("*").alias("n")).collect()}
        if not wanted:
            break
        sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
        room = {s: max(0.0, (1 + SLACK) * sum(sizes.values()) / shards - sizes.get(s, 0)) / shards for s in range(shards)}
        share = {f"{a}>{b}": min(1.0, (min(n, wanted.get((b, a), 0)) + room[b]) / n) for (a, b), n in wanted.items()}
        quota = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
        drawn = F.pmod(F.xxhash64("node", F.lit(-1 - turn)), F.lit(1_000_000)) / 1e6
        let = movers.filter(drawn < quota[F.concat_ws(">", "label", "wish")]).select("node", "wish")
        labels = saved(labels.join(let, "node", "left").select("node", "home", F.coalesce("wish", "label").alias("label")), "labels")
    return labels


def gathered(labels: DataFrame) -> DataFrame:
    """labels with every node at the label that most nodes of its home have, the least one of equals."""
    most = labels.groupBy("home", "label").agg(F.count("*").alias("n")).groupBy("home").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return labels.select("node", "home").join(most, "home").select("node", "home", "label")


def shard(docs: DataFrame, links: DataFrame | None = None, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    labels = gathered(propagate(equal_text_links(docs) if links is None else links, shards, rounds))
    joined = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    free = F.pmod(F.xxhash64(F.coalesce("doc_id", "g")), F.lit(shards)).cast("int")
    placed = joined.select("doc_id", "size", "text_crc32", "g", F.coalesce("label", free).alias("label"), F.coalesce("home", "doc_id").alias("home"))
    ranked = numbered(placed, "label", "home", "g", "doc_id")
    n = ranked.count()
    q, r = divmod(n, shards)
    rank = F.col("rank")
    large = rank < r * (q + 1)
    at = F.when(large, F.floor(rank / (q + 1))).otherwise(r + F.floor((rank - r * (q + 1)) / max(q, 1)))
    slot = F.when(large, rank % (q + 1)).otherwise((rank - r * (q + 1)) % max(q, 1))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), at.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
