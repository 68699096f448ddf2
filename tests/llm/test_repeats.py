import hashlib
from collections import Counter

import numpy as np
import pytest

from linkwright.llm.substring_dedup import remove_seen, smallest_holders
from linkwright.llm.suffix_dedup import radix_counts, remove_repeats
from tests.llm.helpers import documents, random_texts, space_words

TEXTS = random_texts(11, 60) + ["é" * 300, "x" * 199, "x" * 200, "y" * 201]


def brute_bytes(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[s : s + n] for t in raw for s in range(len(t) - n + 1))
    out = {}
    for d, t in enumerate(raw):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - n + 1):
            if seen[t[s : s + n]] > 1:
                gone[s : s + n] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(bool(gone[i] and (i == 0 or not gone[i - 1])) for i in range(len(gone)))
        out[d] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(texts, n):
    own = [space_words(t, False) for t in texts]
    least = {}
    for d, w in enumerate(own):
        for s in range(len(w) - n + 1):
            least.setdefault(tuple(w[s : s + n]), d)
    out = {}
    for d, w in enumerate(own):
        gone = set()
        for s in range(len(w) - n + 1):
            if least[tuple(w[s : s + n])] < d:
                gone |= set(range(s, s + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_bytes_against_brute_force(spark, hot):
    rows = remove_repeats(documents(spark, TEXTS), hot_contexts=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_bytes(TEXTS, 200)


@pytest.mark.parametrize("hot", [2000, 1])
def test_words_against_brute_force(spark, hot):
    rows = remove_seen(documents(spark, TEXTS), hot_contexts=hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute_words(TEXTS, 50)


def test_rows_of_one_id_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(80))
    docs = documents(spark, [long, long]).selectExpr("1L as doc_id", "text", "1 as key", "2 as a").unionByName(
        documents(spark, [long]).selectExpr("cast(null as bigint) as doc_id", "text", "1 as key", "2 as a"))
    assert [r.n_removed for r in remove_seen(docs).collect()] == [0, 0, 0]
    assert {r.n_removed for r in remove_repeats(docs).collect()} == {len(long)}
    assert remove_repeats(documents(spark, [])).count() == remove_seen(documents(spark, [])).count() == 0


@pytest.mark.parametrize("window", [5, 8, 50])
def test_shard_indexes(window):
    r = np.random.default_rng(window)
    base = r.integers(0, 3, 90)
    contents = [np.concatenate([r.integers(0, 3, r.integers(0, 4)), base[s : s + window + int(r.integers(0, 6))], r.integers(0, 3, 4)]) for s in r.integers(0, 30, 40)]
    weights = r.permutation(len(contents))
    least, count = {}, Counter()
    for c, w in zip(contents, weights, strict=True):
        for s in range(len(c) - window + 1):
            g = tuple(c[s : s + window])
            least[g] = min(w, least.get(g, 99))
            count[g] += 1
    for c, a, b in zip(contents, smallest_holders(contents, weights, window), radix_counts([bytes(c.tolist()) for c in contents], np.ones(len(contents), np.int64), window), strict=True):
        for s in range(len(c) - window + 1):
            assert a[s] == least[tuple(c[s : s + window])] and b[s] == count[tuple(c[s : s + window])]
