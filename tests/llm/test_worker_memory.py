"""Workers live on after their tasks: what they keep counts to the executor while later stages run."""

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from linkwright.llm.packing import WordTokenizer
from linkwright.llm.queries import tokenizer_path
from linkwright.llm.runtime import arrow_map


def own_mb(pid):
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_places_against_a_dict():
    from linkwright.llm.words import Places

    r = np.random.default_rng(4)
    places, plain = Places(), {}
    pool = np.concatenate([r.integers(0, 1 << 63, 30_000).astype(np.uint64), np.arange(5_000, dtype=np.uint64) << np.uint64(40)])  # the latter share all low bits
    for _ in range(40):
        some = np.unique(r.choice(pool, r.integers(0, 3_000)))
        found = places.find(some)
        assert found.tolist() == [plain.get(k, -1) for k in some.tolist()]
        new = some[found < 0]
        plain.update(zip(new.tolist(), range(len(plain), len(plain) + len(new)), strict=True))
        places.add(new)
    assert len(places) == len(plain) and places.find(pool).tolist() == [plain.get(k, -1) for k in pool.tolist()]


def test_memory_of_many_distinct_words():
    """200,000 words that are all new: what is kept of them, what they take meanwhile and how many one call encodes."""
    r = random.Random(5)
    texts = pa.array([" ".join("".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(2_000)) for _ in range(100)])
    tokenizer, sizes = WordTokenizer(tokenizer_path()), []
    encode = tokenizer.encode
    tokenizer.encode = lambda found, **options: sizes.append(len(found[0].split())) or encode(found, **options)
    tracemalloc.start()
    ids, at = tokenizer(texts)
    ids, at = len(ids), len(at)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert ids > 200_000 and at == 101
    assert kept < 16 << 20 and most < 80 << 20
    assert max(sizes) < 20_000


def test_worker_gives_back_what_its_task_took(spark):
    def make():
        import os
        import sys

        before = own_mb(os.getpid())

        def each(rows):
            taken = [bytes(1000) for _ in range(100_000)]
            sys._last_taken = taken[-1]  # holds the heap's end
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "mb": [before]})

        return each

    (row,) = arrow_map(spark.range(1).coalesce(1), "pid long, mb double", make).collect()
    assert own_mb(row.pid) - row.mb < 50
