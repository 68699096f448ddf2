import random

import numpy as np
import pytest

from linkwright.llm import jaccard_join
from linkwright.llm.jaccard_join import Measure, join_components
from tests.llm.helpers import documents, random_texts, space_words


def shingles(text, k):
    w = space_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(x), find(i)) for i, x in enumerate(sets)}


def near_copies(seed):
    r = random.Random(seed)
    texts = random_texts(seed, 50, most=200)
    for _ in range(6):  # families around the threshold
        base = r.choice([t for t in texts if t and len(t.split()) > 30]).split()
        for _ in range(8):
            own = list(base)
            for _ in range(r.randint(1, max(1, len(own) // 40))):
                own[r.randrange(len(own))] = f"x{r.randrange(9)}"
            texts.append(" ".join(own))
    return texts + ["one", "ONE", "one two three four five", "one two three four six"]


@pytest.mark.parametrize("k,percent,often", [(4, 85, 16), (5, 80, 1), (5, 80, 3)])
def test_components_against_brute_force(spark, k, percent, often):
    texts = near_copies(k)
    rows = join_components(documents(spark, texts), k, percent, often).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, k, percent)


def test_crowded_keys_against_brute_force(spark, monkeypatch):
    """Every key is crowded here, and a member names few of its set's keys."""
    monkeypatch.setattr(jaccard_join, "CROWD", 2)
    monkeypatch.setattr(jaccard_join, "LOW", 3)
    texts = near_copies(11)
    rows = join_components(documents(spark, texts), 4, 85, 3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, 4, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_a_key(percent):
    r = np.random.default_rng(percent)
    measure = Measure(4, percent)
    pool = r.integers(1, 1 << 63, 3000).astype(np.uint64)
    for often in (0.0, 0.5, 0.97, 1.0):
        frequent = np.sort(pool[: int(len(pool) * often)])
        for n in [1, 2, 3, 5, 6, 7, 8, 13, 20, 40, 77, 150, 400]:
            for _ in range(30):
                x = r.choice(pool, n, replace=False)
                lost = r.integers(0, measure.lacking(n) + 1)
                y = x[lost:]
                more = r.choice(pool, r.integers(0, n // 5 + 1), replace=False)
                y = np.unique(np.concatenate([y, more]))
                x = np.unique(x)
                both = len(np.intersect1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    assert len(np.intersect1d(measure.keys(x, frequent), measure.keys(y, frequent))), (n, often)


def test_empty_and_null_ids(spark):
    assert join_components(documents(spark, []), 4, 85).count() == 0
    docs = documents(spark, ["a b c d e", "a b c d e", None]).selectExpr("if(doc_id = 0, null, doc_id) as doc_id", "text", "1 as key", "2 as node")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in join_components(docs, 4, 85).collect()) == [(0, 1), (1, 1), (2, 2)]
