import numpy as np
from pyspark.sql import functions as F

from linkwright.llm.vptree import Tree, nearest


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")


def product(x, y):
    total = 0.0  # sum() would compensate for rounding
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        total += a * b
    return total


def brute(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            found = sorted((-product(x, y), i) for i, y in good if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_exact_against_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + 0.3 * r.normal(size=8)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700 + i, rows[5][1]) for i in range(90)] + [(-20, rows[7][1]), (800, None), (820, []), (840, [0.0] * 8), (860, [float("nan")] * 8), (880, [None] * 8), (900, [float("inf")] * 8), (920, [1.0, 2.0]), (940, [2.0, 1.0]), (None, rows[3][1])]
    found = {}
    for x in sorted(nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect(), key=lambda x: x["rank"]):
        found.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert found == brute(rows, 20)


def test_relaxed_search_recalls_most():
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 16))
    x = centres[r.integers(0, 30, 3000)] + 0.2 * r.normal(size=(3000, 16))
    ids = np.arange(3000)
    exact = Tree(ids, x).search(ids[:100], x[:100], 10, 1.0)[0]
    close = Tree(ids, x).search(ids[:100], x[:100], 10, 0.7)[0]
    want = np.argsort(-(x[:100] @ x.T - 1e9 * (ids[:100, None] == ids)), axis=1)[:, :10]
    assert (np.sort(exact) == np.sort(want)).all()
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(close, want, strict=True)]) > 0.9


def test_extreme_magnitudes(spark):
    """Products that overflow, vanish or are not a number; one huge vector among ordinary ones; queries that repeat with unlike vectors."""
    r = np.random.default_rng(6)
    x = r.normal(size=(260, 6))
    for scale in (1e160, 1e-170, 1e-300):
        rows = [(i, v.tolist()) for i, v in enumerate(x * scale)]
        assert search(spark, rows) == plain(rows)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1e200] * 6), (1001, [1e-200] * 6), (1020, [1e300, -1e300, 1e300, 1e300, -1e300, 1e300]), (1040, [1e-5, 0.0, 0.0, 0.0, 0.0, 0.0])]
    assert search(spark, rows) == plain(rows)
    rows = [(i, v.tolist()) for i, v in enumerate(x[:50])] + [(20, x[60].tolist()), (20, x[61].tolist())]
    least = {20: min(v for i, v in rows if i == 20)}
    want = {q: sorted(((-product(np.array(least.get(q, rows[q][1])), np.array(y)), i) for i, y in rows if i != q))[:20] for q in (0, 20, 40)}
    assert search(spark, rows) == {q: [(i, -s) for s, i in found] for q, found in want.items()}


def plain(rows, k=20):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            with np.errstate(all="ignore"):
                found = [(product(np.array(x), np.array(y)), i) for i, y in rows if i != q]
            found.sort(key=lambda f: (np.isnan(f[0]), -np.nan_to_num(f[0], nan=-np.inf, posinf=np.inf, neginf=-np.inf), f[1]))
            out[q] = [(i, s if s == s else None) for s, i in found[:k]]
    return out


def search(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {}
    for x in sorted(nearest(table, F.col("vec_id") % 20 == 0, **options).collect(), key=lambda x: x["rank"]):
        out.setdefault(x.query_id, []).append((x.vec_id, x.score if x.score == x.score else None))
    return out


def test_many_shards_and_a_hot_vector(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(20, 6))
    x = centres[r.integers(0, 20, 900)] + 0.1 * r.normal(size=(900, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900 + i, x[3].tolist()) for i in range(450)]
    assert search(spark, rows, shard_vectors=64) == plain(rows)


def test_empty(spark):
    assert nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
