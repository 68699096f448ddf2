"""Exact components of the self-join of documents by the Jaccard similarity of their word shingles.

Components are exact; links aren't listed.  Once two sets are known to be in one
component they are no longer compared, so a link between them may never be made.

Order all shingles with the frequent ones last.  If two sets are similar, the
first shingle they share is among the first d + 1 of both, where d is the most
a set can lack.  So a set is indexed under its first d + 1 shingles as long as
these are rare.  Only a set of at most d rare shingles can first meet another
in the frequent ones.  For these the prefix is extended to all its frequent
shingles, and instead of single ones, combinations are indexed: shingles fall
into G classes by hash, and all that a set has of one class make one key.
Similar sets differ in at most H < G shingles, so G - H classes are equal in
both, and one of those isn't empty unless the set has G - H empty classes; such
(tiny) sets are indexed under single shingles as well.  G goes by size band, and
a set uses its own band's and the next lower one's.  Every link has a key in
common, whichever shingles are called frequent; that choice rests on counts over all rows.

Candidates must first pass a sketch of parities: it differs in at most as many
bits as the sets in shingles, so it drops unlike pairs and never a link.  It has
at least as many bits as the set has shingles, so that sets with half of their
shingles in common seldom pass.  Keys carry it folded to BRIEF words; the whole
one is met by each pair once.

Sets are compared in rounds.  In the first, every key's members meet one hub; in
later ones those of crowded keys meet HUBS of other components.  What links
joins components; keys that hold one component are done.  After the rounds,
members of different components meet, so groups of near copies never make all
their pairs: each round leaves fewer of them outside their group's component.  Sets that share many crowded keys meet under the least of
these: a key skips a pair that is seen to share a lesser one.  Equal sets are
merged before anything else.

Defined results: texts without words, or null, have an empty set, link with
nothing and are their own component; a null doc_id takes part but names no
component (unless all of its component are null); repeated rows share their
set's component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.runtime import arrow_map, batch, fetched, saved
from linkwright.llm.words import SPACE, Rolling, chunks, mix, words
from linkwright.operators.components import connected_components

#: Rows with a shingle from which it is frequent; the most frequent ones, of whom at most so many are broadcast.
OFTEN, FREQUENT = 16, 2_000_000
#: Rounds in which members meet hubs, at most; they end when no crowded key is open.  Hubs of a crowded key in the later ones.
HUB_ROUNDS, HUBS = 3, 12
#: Words of the sketch that every key of a set carries, at most.
BRIEF = 8
#: Members from which a key is crowded; a set's least crowded keys, so many at most, go with each of its members.
CROWD, LOW = 64, 16


class Measure:
    """Similarity of at least percent / 100 over shingles of `size` words."""

    def __init__(self, size: int, percent: int):
        self.size, self.percent = size, percent
        bounds = [1]
        while bounds[-1] < 1 << 40:  # whoever is similar to a set of one band is in it or beside it
            bounds.append(bounds[-1] * 100 // percent + 1)
        self.bounds = np.array(bounds)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        w = words(texts, SPACE)
        rolling = Rolling(mix(w.hash), seed=2)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a <= self.size:
                yield rolling.spans(np.array([a]), np.array([b])) if b > a else np.empty(0, np.uint64)
            else:
                start = np.arange(a, b - self.size + 1)
                yield np.unique(rolling.spans(start, start + self.size))

    def sketch(self, shingles: np.ndarray, most: int = 1 << 40) -> np.ndarray:
        """Parities of the shingles that fall on each bit: two sets' sketches differ in no more bits than the sets in shingles."""
        n = min(most, 1 << (len(shingles) // 64).bit_length())
        bit = mix(shingles ^ np.uint64(0x5EED)) & np.uint64(64 * n - 1)
        odd = (np.bincount(bit.astype(np.int64), minlength=64 * n) & 1).astype(np.uint8)
        return np.packbits(odd, bitorder="little").view(np.int64)

    def lacking(self, n: int) -> int:
        return n - -(-n * self.percent // 100)

    def keys(self, shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """What a set is indexed under."""
        n, d = len(shingles), self.lacking(len(shingles))
        if not n:
            return shingles
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
            often = frequent[at] == shingles
        else:
            often = np.zeros(n, bool)
        rare = shingles[~often]
        if len(rare) > d:
            return rare[: d + 1]
        common = shingles[often]
        out = [rare]
        single = False
        band = int(np.searchsorted(self.bounds, n, "right")) - 1
        for level in {band, max(0, band - 1)}:
            most = int(self.bounds[level + 2]) - 1
            differing = 2 * most * (100 - self.percent) // (100 + self.percent)
            classes = differing + max(2, differing // 4)
            of = (mix(common ^ np.uint64(0xC0FFEE)) % np.uint64(classes)).astype(np.int64)
            order = np.argsort(of, kind="stable")  # shingles stay sorted in each class
            fresh = np.ones(len(of), bool)
            fresh[1:] = np.diff(of[order]) > 0
            begin = np.flatnonzero(fresh)
            rolling = Rolling(common[order], seed=3)
            made = rolling.spans(begin, np.append(begin[1:], len(of)))
            out.append(mix(made ^ mix((of[order][begin] * 64 + level).astype(np.uint64))))
            single |= classes - len(begin) >= classes - differing
        if single:
            out.append(common[: d + 1 - len(rare)])
        return np.unique(np.concatenate(out))


def frequent_shingles(docs: DataFrame, measure: Measure, often: int) -> np.ndarray:
    """Shingles of at least `often` rows, sorted; if over FREQUENT, the limit rises until they fit.

    A row counts for its first 2 (d + 1) shingles: its prefix ends there unless half of them are frequent.
    """
    schema = pa.schema([("shingle", pa.int64())])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows):
                yield batch(schema, np.concatenate([s[: 2 * measure.lacking(len(s)) + 2] for s in measure.sets(part.column(0))]).view(np.int64))

        return each

    counted = arrow_map(docs.select("text"), "shingle long", make).groupBy("shingle").count().filter(F.col("count") >= often)
    counted = saved(counted.select("shingle", F.floor(F.log2("count") * 8).alias("step")), "shingles")
    total, least = 0, None
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["step"]
    kept = counted.filter(F.col("step") >= least).select("shingle").toPandas()["shingle"] if least is not None else np.empty(0, np.int64)
    return np.sort(np.asarray(kept, np.int64).view(np.uint64))


def indexed(docs: DataFrame, measure: Measure, frequent: np.ndarray) -> DataFrame:
    """doc_id, key (of the row), node (hash of the set), n (its size), keys, sketch and brief (the sketch of at most BRIEF words)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("brief", pa.list_(pa.int64()))])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows):
                sets = list(measure.sets(part.column(1)))
                node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
                yield batch(schema, part.column(0), part.column(2), node, [len(s) for s in sets], [measure.keys(s, shared.value).view(np.int64) for s in sets], [measure.sketch(s) for s in sets], [measure.sketch(s, BRIEF) for s in sets])

        return each

    return arrow_map(docs, "doc_id long, key long, node long, n long, keys array<bigint>, sketch array<bigint>, brief array<bigint>", make)


def sets_of(docs: DataFrame, wanted: DataFrame, measure: Measure) -> DataFrame:
    """node and its shingles, for each wanted (doc_id, key, node)."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows, "text"):
                yield batch(schema, part.column(1), [s.view(np.int64) for s in measure.sets(part.column(0))])

        return each

    return arrow_map(fetched(docs, wanted).select("text", "node"), "node long, shingles array<bigint>", make)


def verified(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """Those pairs (a, b) whose sets are similar."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            good = []
            left, right = rows.column(2), rows.column(3)
            lv, rv = left.values.to_numpy(), right.values.to_numpy()
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            for i in range(rows.num_rows):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= measure.percent * (len(x) + len(y) - both))
            kept = np.flatnonzero(good)
            if len(kept):
                kept = pa.array(kept)
                yield batch(schema, rows.column(0).take(kept), rows.column(1).take(kept))

        return each

    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return arrow_map(full.select("a", "b", "x", "y"), "a long, b long", make)


def may_be_similar(measure: Measure, sketch: str) -> Column:
    """Whether sizes and sketches of the joined sets x and y allow for similarity; never false if they are similar."""
    x, y = F.col(f"x.{sketch}"), F.col(f"y.{sketch}")

    def folded(s: Column) -> Column:
        half = (F.size(s) / 2).cast("int")
        return F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda a, b: a.bitwiseXOR(b))

    def bits(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m)

    differing = F.when(F.size(x) == F.size(y), bits(x, y)).when(F.size(x) == 2 * F.size(y), bits(folded(x), y)).when(F.size(y) == 2 * F.size(x), bits(x, folded(y))).otherwise(0)
    most = (F.col("x.n") + F.col("y.n")) * (100 - measure.percent) / (100 + measure.percent)
    sizes = (F.col("x.n") * 100 >= F.col("y.n") * measure.percent) & (F.col("y.n") * 100 >= F.col("x.n") * measure.percent)
    return (F.col("x.node") != F.col("y.node")) & sizes & (differing <= most)


def not_met_before() -> Column:
    """Whether the joined sets x and y aren't seen to share a key less than this one; never false at the least one that they share."""
    return F.coalesce(F.array_min(F.array_intersect("x.low", "y.low")) >= F.col("at"), F.lit(True))


def links(docs: DataFrame, sets_table: DataFrame, measure: Measure) -> tuple[DataFrame | None, DataFrame | None]:
    """Links between different sets, enough of them to give all components; components of the linked sets."""
    one = sets_table.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("one"))
    one = saved(one.select("node", "one.*"), "nodes")
    # each distinct set is indexed once: by the row that stands for it
    chosen = sets_table.alias("s").join(one.alias("o"), (F.col("s.node") == F.col("o.node")) & F.col("s.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("s.key") == F.col("o.key"))).select("s.*")
    chosen = saved(chosen, "chosen")
    index = chosen.select("node", F.explode("keys").alias("at"))
    shared = index.groupBy("at").agg(F.count("*").alias("members")).filter("members > 1").select("at", (F.col("members") >= CROWD).alias("crowded"))
    held = saved(index.join(shared, "at").distinct(), "held")
    low = held.filter("crowded").groupBy("node").agg(F.slice(F.array_sort(F.collect_set("at")), 1, LOW).alias("low"))
    nodes = chosen.select("node", "n", "sketch", "brief").dropDuplicates(["node"])
    members = held.join(nodes.drop("sketch").join(low, "node", "left"), "node")
    members = saved(members.withColumn("low", F.when(F.col("crowded"), F.col("low"))).withColumn("part", F.col("node")).drop("crowded"), "members")
    known, found, components, sets, seen = None, None, None, None, None
    for turn in range(HUB_ROUNDS + 1):
        last = turn == HUB_ROUNDS or turn > 0 and not members.filter("low IS NOT NULL").take(1)
        if last:
            pairs = members.alias("x").join(members.alias("y"), "at").filter((F.col("x.part") != F.col("y.part")) & (F.col("x.node") < F.col("y.node")))
            pairs = pairs.filter(may_be_similar(measure, "brief") & not_met_before())
        else:
            met = members if turn == 0 else members.filter("low IS NOT NULL")
            each = F.array(*[F.min_by(F.struct("node", "n", "brief", "part"), F.xxhash64("node", F.lit(turn * HUBS + i))) for i in range(HUBS if turn else 1)])
            hub = met.groupBy("at").agg(each.alias("hubs")).select("at", F.explode(F.array_distinct("hubs")).alias("hub")).select("at", "hub.*")
            pairs = met.alias("x").join(hub.alias("y"), "at").filter((F.col("x.part") != F.col("y.part")) & may_be_similar(measure, "brief"))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        whole = pairs.join(nodes.alias("x"), F.col("a") == F.col("x.node")).join(nodes.alias("y"), F.col("b") == F.col("y.node"))
        pairs = saved(whole.filter(may_be_similar(measure, "sketch")).select("a", "b"), "pairs")
        if pairs.take(1):
            needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            if known is not None:
                needed = needed.join(known, "node", "left_anti")
            needed = saved(needed, "needed")
            read = saved(sets_of(docs, saved(one.join(needed, "node", "left_semi"), "wanted"), measure), "sets")
            sets = read if sets is None else sets.unionByName(read)
            known = needed if known is None else known.unionByName(needed)
            new = saved(verified(pairs, sets, measure).distinct(), "links")
            seen = pairs if seen is None else seen.unionByName(pairs)
            found = new if found is None else found.unionByName(new)
            components = connected_components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        if last:
            break
        # keys whose members are all of one component are done
        named = members.drop("part")
        if components is None:
            members = named.withColumn("part", F.col("node"))
        else:
            named = named.join(components.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
            open_keys = named.groupBy("at").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("at")
            members = saved(named.join(open_keys, "at", "left_semi"), "members")
    return found, components


def join_components(docs: DataFrame, size: int, percent: int, often: int = OFTEN) -> DataFrame:
    """doc_id, key, n_shingles, part and component_id of every row; key is xxhash64 of its text."""
    measure = Measure(size, percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("key"))
    table = saved(indexed(docs, measure, frequent_shingles(docs, measure, often)), "indexed")
    _, components = links(docs, table, measure)
    rows = table.select("doc_id", "key", "node", F.col("n").alias("n_shingles"))
    if components is None:
        rows = rows.withColumn("part", F.col("node"))
    else:
        rows = rows.join(components.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    rows = saved(rows, "parts")
    least = rows.filter("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "part", "left").select("doc_id", "key", "n_shingles", "part", F.coalesce("component_id", "doc_id").alias("component_id"))


__all__ = ["Measure", "join_components"]
