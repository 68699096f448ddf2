import hashlib
import random

import pytest

from linkwright.llm.decontaminate import contaminated_documents
from tests.llm.helpers import alnum_words, documents, random_texts


def brute(texts, items):
    out = {}
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(i)
    for d, t in enumerate(texts):
        w = alnum_words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[g]
        ids = sorted(str(i) for i in found if i is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_against_brute_force(spark, block_words):
    texts = random_texts(5, 40)
    r = random.Random(2)
    items = []
    for i in range(25):
        own = r.choice([t for t in texts if t]).split()
        s = r.randrange(len(own))
        items.append((i % 23, " ".join(own[s : s + r.choice([1, 3, 9, 10, 11, 40])])))
    items += [(None, "hot " * 12), (40, None), (41, " . "), (42, "A! b,c"), (43, "none of this " * 5)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = contaminated_documents(documents(spark, texts), benchmark, block_words=block_words).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute(texts, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated_documents(documents(spark, []), none).count() == 0
    row = contaminated_documents(documents(spark, ["a b"]), none).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)
