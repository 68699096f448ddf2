"""Nearest neighbours by largest inner product with vantage-point trees, one tree a shard.

A vector of norm at most R is lifted by one coordinate onto the sphere of
radius R, and queries are scaled to R; there a larger inner product is a
smaller distance, so the triangle inequality bounds what a subtree can hold.  A
subtree is visited if its bound is at most `factor` times the query's distance
to its k-th nearest so far: factor 1 is exact search, less visits less.  The
vantage point is the one of a few that spreads the others' distances most.

Vectors are dealt to shards by their nearest pivot, so that near ones share a
tree and whole trees are pruned at their root; cells of many vectors are split
evenly.  Before the search each query gets a floor, its k-th best product within
a sample of vectors, which no shard needs to go below; what a shard reports is
at least as good.  The sample and the pivots decide what is pruned and where
vectors lie, never what is found at factor 1.

Scores are sums in component order in double precision, so equal vectors have
equal scores wherever they are computed.  Bounds are computed on vectors divided
by their largest component; a shard has a tree for every 2^32 of magnitude, so
one huge vector doesn't blur the others, and where products leave the range of
doubles nothing is pruned.  Queries come in blocks of bounded bytes, each
broadcast once and searched in every shard.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component, and rows with a null id, take no part; vectors meet only
others of their length; of several rows with a query's id the least vector is
the query, and none of them is its candidate; other repeated rows are
candidates each; ties go to the smaller id, also where products overflow to an
infinity or vanish to 0 (one that is not a number ranks last); other columns don't
matter; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkwright.llm.runtime import arrow_map, saved

K = 20
FACTOR = 1.0
LEAF = 96
#: Vectors of one tree, on average; pivots, at most; vectors of the sample that gives the floors.
SHARD_VECTORS, PIVOTS, SAMPLE = 8192, 1024, 4096
#: Bytes of the queries searched at once.
QUERY_BYTES = 32 << 20
#: Vantage points tried, and vectors each is tried on.
TRIED, TRIED_ON = 4, 64
#: Binary orders of magnitude that share a tree.
BAND = 32


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, summed in component order."""
    out = np.zeros((len(a), len(b)))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j, None] * b[None, :, j]
    return out


def ranked(scores: np.ndarray) -> np.ndarray:
    """Scores as they are ordered: what is not a number comes last."""
    return np.where(np.isnan(scores), -np.inf, scores)


class Tree:
    """Vectors of similar magnitude; search() goes on from what was found in others."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf = ids[order], vectors[order], leaf
        self.unit = float(np.abs(self.vectors).max())
        self.plain = self.vectors / self.unit
        norms = np.linalg.norm(self.plain, axis=1)
        self.radius = float(norms.max())
        self.lift = np.sqrt(np.maximum(self.radius**2 - norms**2, 0))
        self.random = np.random.default_rng(len(ids))
        self.root = self.build(np.arange(len(ids)))

    def away(self, at: np.ndarray, vantage: int) -> np.ndarray:
        inner = self.plain[at] @ self.plain[vantage] + self.lift[at] * self.lift[vantage]
        return np.sqrt(np.maximum(2 * self.radius**2 - 2 * inner, 0))

    def build(self, at: np.ndarray):
        """A leaf's rows, or the vantage point and two halves with the range of their distances to it."""
        if len(at) <= self.leaf:
            return at
        some = at[self.random.integers(0, len(at), TRIED_ON)]
        vantage = max(at[self.random.integers(0, len(at), TRIED)].tolist(), key=lambda v: (float(self.away(some, v).std()), -v))
        away = self.away(at, vantage)
        order = np.argsort(away, kind="stable")
        half = len(at) // 2
        sides = []
        for part in (order[:half], order[half:]):
            sides.append((self.build(np.sort(at[part])), float(away[part].min()), float(away[part].max())))
        return vantage, sides

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = FACTOR, floor: np.ndarray | None = None, before: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and scores of each query's k nearest, its own id left out, and which of these places are taken; `before` is such a result."""
        self.q_ids, self.q = ids, queries
        unit = np.abs(queries).max(axis=1)
        plain = queries / unit[:, None]
        norms = np.linalg.norm(plain, axis=1)
        self.scaled = plain * (self.radius / norms)[:, None]
        # a product in units of the lifted space; nothing is pruned where products may leave the range of doubles
        exponent = np.log2(unit) + np.log2(self.unit)
        self.prunes = np.abs(exponent) < 900
        with np.errstate(all="ignore"):
            self.scale = np.where(self.prunes, (self.radius / norms) / unit / self.unit, 0.0)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        if before is None:
            before = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), bool)
        self.found, self.best, self.taken = before
        self.visit(self.root, np.arange(len(ids)), factor)
        return self.found, self.best, self.taken

    def reach(self, who: np.ndarray) -> np.ndarray:
        """Distance to each query's k-th nearest so far, infinite if that isn't known."""
        worst = np.maximum(np.where(self.taken[who, -1], ranked(self.best[who, -1]), -np.inf), self.floor[who])
        known = self.prunes[who] & np.isfinite(worst)
        with np.errstate(all="ignore"):
            inner = np.where(known, worst * self.scale[who], 0.0)
        return np.where(known, np.sqrt(np.maximum(2 * self.radius**2 - 2 * inner, 0)), np.inf)

    def visit(self, node, who: np.ndarray, factor: float) -> None:
        if isinstance(node, np.ndarray):
            self.scan(node, who)
            return
        vantage, sides = node
        inner = self.scaled[who] @ self.plain[vantage]  # the queries' lifted coordinate is 0
        away = np.sqrt(np.maximum(2 * self.radius**2 - 2 * inner, 0))
        near_first = away <= sides[0][2]
        for turn in (0, 1):
            for side in (0, 1):
                tree, low, high = sides[side]
                mine = near_first if (side == 0) == (turn == 0) else ~near_first
                bound = np.maximum(low - away, away - high)
                go = mine & ~(bound > factor * self.reach(who) + 1e-6 * self.radius)
                if go.any():
                    self.visit(tree, who[go], factor)

    def scan(self, at: np.ndarray, who: np.ndarray) -> None:
        score = products(self.q[who], self.vectors[at])
        own = self.q_ids[who][:, None] == self.ids[at][None]
        order_by = np.where(own, -np.inf, ranked(score))
        worst = np.where(self.taken[who, -1], ranked(self.best[who, -1]), -np.inf)
        better = order_by.max(axis=1) >= np.maximum(worst, self.floor[who])
        who, score, own = who[better], score[better], own[better]
        if not len(who):
            return
        k = self.best.shape[1]
        all_scores = np.concatenate([self.best[who], score], axis=1)
        all_ids = np.concatenate([self.found[who], np.broadcast_to(self.ids[at], score.shape)], axis=1)
        taken = np.concatenate([self.taken[who], ~own & (ranked(score) >= self.floor[who][:, None])], axis=1)
        order = np.lexsort((all_ids, -ranked(all_scores), np.isnan(all_scores), ~taken), axis=1)[:, :k]
        self.best[who] = np.take_along_axis(all_scores, order, axis=1)
        self.found[who] = np.take_along_axis(all_ids, order, axis=1)
        self.taken[who] = np.take_along_axis(taken, order, axis=1)


def banded(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> list[Tree]:
    """A tree for each band of magnitudes, the largest first."""
    band = np.floor(np.log2(np.abs(vectors).max(axis=1)) / BAND).astype(int)
    return [Tree(ids[band == b], vectors[band == b], leaf) for b in sorted(set(band.tolist()), reverse=True)]


def floors(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th largest product with the sample's vectors but its own id's; -inf if there are fewer."""
    out = np.full(len(ids), -np.inf)
    if len(sample) < k:
        return out
    for i in range(0, len(ids), 512):
        score = ranked(products(queries[i : i + 512], sample))
        score[ids[i : i + 512, None] == sample_ids[None]] = -np.inf
        out[i : i + 512] = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v and dim of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: F.coalesce(x, F.lit(0.0)) != 0)
    return rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(sound).withColumn("dim", F.size("v"))


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_dimension(rows: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {int(d): (part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_list()).astype(np.float64)) for d, part in rows.groupby("dim")}


def with_cells(rows: DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """rows with `cell`, the number of the pivot of their length that is nearest in direction."""
    shared = rows.sparkSession.sparkContext.broadcast({d: v / np.maximum(np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1) * np.abs(v).max(axis=1), 1e-300)[:, None] for d, (_, v) in pivots.items()})
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("dim", pa.int32()), ("cell", pa.int32())])

    def make():
        def each(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            dims = part.column(2).to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for d in np.unique(dims).tolist():
                if d in shared.value:
                    own = np.flatnonzero(dims == d)
                    x = matrix(part.column(1).take(pa.array(own)))
                    cell[own] = ((x / np.abs(x).max(axis=1, keepdims=True)) @ shared.value[d].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.list_(pa.float64())), part.column(2).cast(pa.int32()), pa.array(cell)], schema=schema)

        return each

    return arrow_map(rows.select("vec_id", "v", "dim"), "vec_id long, v array<double>, dim int, cell int", make)


def searching(shared, k: int, factor: float):
    """The search of one shard: shared holds, by dimension, the ids, vectors and floors of a block of queries."""

    def searched(part: pd.DataFrame) -> pd.DataFrame:
        own = shared.value.get(int(part["dim"].iloc[0]))
        if own is None:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, queries, floor = own
        result = None
        for tree in banded(part["vec_id"].to_numpy(np.int64), np.stack(part["v"].to_list()).astype(np.float64)):
            result = tree.search(ids, queries, k, factor, floor, result)
        found, scores, taken = result
        return pd.DataFrame({"query_id": np.repeat(ids, taken.sum(axis=1)), "vec_id": found[taken], "score": scores[taken]})

    return searched


def nearest(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest rows."""
    spark = vectors.sparkSession
    rows = saved(usable(vectors), "vectors")
    n = rows.count()
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.*")
    queries = saved(queries, "queries")
    size = queries.agg(F.sum("dim").cast("long")).first()[0] or 0
    blocks = max(1, -(-8 * size // QUERY_BYTES))
    # drawn by a hash over all rows; each drawn set is bounded
    drawn = F.pmod(F.xxhash64("vec_id", "v", F.lit(5)), F.lit(max(1, n // SAMPLE))) == 0
    sample = by_dimension(rows.filter(drawn).orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).toPandas())
    many = min(PIVOTS, max(1, -(-n // shard_vectors)))
    celled = saved(with_cells(rows, {d: (i[:many], v[:many]) for d, (i, v) in sample.items()}), "cells")
    parts = {(r["dim"], r["cell"]): -(-r["n"] // shard_vectors) for r in celled.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    several = F.create_map(*[F.lit(x) for (d, c), p in parts.items() if p > 1 for x in (f"{d}:{c}", p)]) if any(p > 1 for p in parts.values()) else None
    split = F.lit(1) if several is None else F.coalesce(several[F.concat_ws(":", "dim", "cell")], F.lit(1))
    dealt = celled.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), split))
    found = None
    for b in range(blocks):
        asked = by_dimension(queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas())
        shared = spark.sparkContext.broadcast({d: (i, q, floors(i, q, *sample.get(d, (i[:0], q[:0])), k)) for d, (i, q) in asked.items()})
        part = saved(dealt.groupBy("dim", "cell", "part").applyInPandas(searching(shared, k, factor), "query_id long, vec_id long, score double"), "nearest")
        found = part if found is None else found.unionByName(part)
    worth = F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    order = Window.partitionBy("query_id").orderBy(worth.desc(), F.isnan("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
