import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkwright.llm.language import BUCKETS, CHUNK_ROWS, Codes, codewords, features, fit, identify
from linkwright.llm.words import chunks

SYLLABLES = {"en": "the and ing tion er th".split(), "de": "sch ung ein über ß lich".split(), "fr": "eau é ier tre oi ç".split(), "xx": "кат дом ра".split()}


def labelled(spark, seed, n=240):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        text = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 40)))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang))
    rows += [(n, None, "en"), (n + 1, "", "de"), (n + 2, "123 !!! €", "fr"), (n + 3, "éàü", None), (n + 4, "the thing and the other", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))


def test_held_out_accuracy(spark):
    docs = labelled(spark, 1)
    rows = identify(docs, F.col("doc_id") % 4 != 2).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.doc_id % 4 == 2 and r.doc_id < 240]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3 and by[244].lang_pred == "en" and by[243].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 245


def test_without_training_rows(spark):
    assert {r.lang_pred for r in identify(labelled(spark, 2, 5), F.lit(False)).collect()} == {"und"}
    assert identify(labelled(spark, 2, 5).limit(0), F.lit(True)).count() == 0
    one = labelled(spark, 3, 9).filter("lang = 'en' or doc_id > 8")
    assert {r.lang_pred for r in identify(one.filter("lang is null or lang = 'en'"), F.lit(True)).collect()} <= {"en", "und"}


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 30):
        code = codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n


def test_languages_of_repeated_texts_are_learnt(spark):
    rows = [(f"{word} {word}ly", f"l{i}") for i, word in enumerate("alpha bravo charlie delta echo foxtrot golf hotel".split()) for _ in range(45)]
    rows += [("the hot text of all", "hot")] * 2000 + [(f"rare {i}", "rare") for i in range(3)] + [("12 34", "none")] * 50
    codes = fit(spark.createDataFrame(rows, "text string, lang string"), 10)
    assert codes.languages == ["hot", *[f"l{i}" for i in range(8)], "rare"]


def test_decoding_against_brute_force():
    r = np.random.default_rng(2)
    y = np.arange(60) % 6
    x = r.random((100, BUCKETS)) * (r.random((6, BUCKETS)) < 0.2)[np.arange(100) % 6]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    codes = Codes(["a", "b", "c", "d", "e", "f"], x[:60].astype(np.float16), y, epochs=2)
    x = x[60:]
    best, share, gap = codes.decode(x)
    for i in range(len(x)):
        margin = x[i] @ codes.weights + codes.bias
        losses = [sum(float(np.logaddexp(0, -c * m)) * t for c, m, t in zip(code, margin, trust, strict=True)) for code, trust in zip(codes.code, codes.trust, strict=True)]
        order = np.argsort(losses)
        assert best[i] == order[0]
        assert np.isclose(gap[i], losses[order[1]] - losses[order[0]], atol=1e-3)
        assert np.isclose(share[i], 1 / sum(np.exp(losses[order[0]] - v) for v in losses), atol=1e-3)


def test_memory_of_many_tiny_texts():
    """A batch of 10,000 two-byte texts takes as much as one of CHUNK_ROWS."""
    rows = pa.RecordBatch.from_pydict({"text": ["ab"] * 10_000})
    tracemalloc.start()
    for part in chunks(rows, rows=CHUNK_ROWS):
        features(part.column(0))
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_ties_long_and_tiny_texts_and_clashing_names(spark):
    rows = [(i, f"{'alpha' if i % 2 else 'omega'} {i}", f"l{i % 2}", "s", 0.5, True, "x") for i in range(40)]
    rows += [(100, "alpha " * 200_000, None, "s", 0.5, True, "x"), (101, "a", None, "s", 0.5, True, "x"), (101, "a", None, "s", 0.5, True, "x"), (None, "omega", None, "s", 0.5, True, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, ambiguous boolean, rest string")
    found = identify(docs, F.col("doc_id") < 40, carry=tuple(docs.columns)).collect()
    assert len(found) == len(rows) and all(r.rest.lang_pred == "s" and r.rest.rest == "x" for r in found)
    by = {r.doc_id: r.lang_pred for r in found}
    assert by[100] == "l1" and by[None] == "l0"
    assert len({r.score for r in found if r.doc_id == 101}) == 1
    same = spark.createDataFrame([(i, "same text", f"l{i % 2}") for i in range(40)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.ambiguous) for r in identify(same, F.lit(True)).collect()} <= {("l0", True), ("l1", True)}
