import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linkwright.llm import hmm
from tests.llm.helpers import documents, random_texts, space_words


def expected(model, sequences):
    """Expected counts by the plain forward and backward recursions over whole sequences."""
    sums = hmm.Expected(*model.emit.shape)
    for x in sequences:
        e = model.emit[x]
        a, b = np.zeros_like(e), np.ones_like(e)
        for t in range(len(x)):
            a[t] = e[t] * (model.start if t == 0 else a[t - 1] @ model.step)
            a[t] /= a[t].sum()
        for t in range(len(x) - 2, -1, -1):
            b[t] = model.step @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = a * b / (a * b).sum(axis=1, keepdims=True)
        sums.start += p[0]
        np.add.at(sums.emit, x, p)
        for t in range(len(x) - 1):
            xi = a[t][:, None] * model.step * (e[t + 1] * b[t + 1])
            sums.step += xi / xi.sum()
    return sums


def same(a, b, tolerance):
    return all(np.allclose(getattr(a, f), getattr(b, f), rtol=tolerance, atol=tolerance / 100) for f in ("start", "step", "emit"))


def test_counts_of_long_sequences_are_those_of_whole_ones():
    r = np.random.default_rng(1)
    sizes = [1, 255, 511, 512, 513, 700, 1025, 1500, 3]
    sequences = [r.integers(0, 40, n) for n in sizes]
    model = hmm.first_model(np.full(40, 1 / 40), 4)
    model.step = r.dirichlet(np.full(4, 0.5), 4)
    sums = hmm.Expected(40, 4)
    sums.add(model, np.concatenate(sequences), np.concatenate([[0], np.cumsum(sizes)]))
    assert same(sums, expected(model, sequences), 1e-9)
    assert np.isclose(sums.step.sum(), sum(sizes) - len(sizes))


def test_every_pass_reads_all_training_documents(spark):
    r = random.Random(3)
    # what stands beyond a text's first 1,024 words is unlike its beginning
    texts = [" ".join([f"a{r.randrange(30)}" for _ in range(1100)] + [f"b{r.randrange(30)}" for _ in range(400)]) for _ in range(4)]
    texts += [" ".join(f"{'cd'[i % 2]}{r.randrange(20)}" for _ in range(6)) for i in range(40)]
    docs = documents(spark, texts)
    counts = hmm.word_counts(docs)
    vocab = hmm.vocabulary(counts, 1000)
    rows = hmm.encoded(docs, F.lit(False), vocab)
    sequences = [np.array(x.tokens) for x in rows.select("tokens").collect()]
    model = hmm.first_model(vocab.prior(), 3)
    for _ in range(hmm.PASSES):
        model = expected(model, sequences).model(vocab.prior())
    found = hmm.train(rows, vocab, 3).model
    # with all words frequent an unknown word takes the open class's place
    assert same(hmm.Model(found.start, found.step, found.emit), model, 1e-3)


def brute(rows, states, frequent, passes):
    """All columns, with plain dictionaries and recursions over every word of its own."""
    words = {i: [*space_words(t), None] for i, (_, t, _) in enumerate(rows)}
    training = [i for i, r in enumerate(rows) if not r[2]]
    counts = Counter(w for i in training for w in words[i])
    total, types = sum(counts.values()), len(counts)
    out = []
    for i, (doc, _, held) in enumerate(rows):
        base = sum(np.log10((counts[w] + 1) / (total + types + 1)) for w in words[i])
        out.append((doc, held, len(words[i]), sum(w in counts for w in words[i]), total, base))
    return out, words, counts


def test_counts_and_scores_against_brute_force(spark):
    """Nulls, empty texts, repeated rows, null ids, words outside the frequent ones, clashing names."""
    texts = random_texts(5, 40) + ["one two " * 1500, "ONE two \u00e9", "never seen before at all"]
    held = [i % 7 == 2 for i in range(len(texts))]
    rows = [(i if i % 11 else None, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))]
    rows += [rows[3], rows[3], (9999, "never never seen", True)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, held boolean, score int, tokens int")
    want, words, counts = brute(rows, 3, 50, 3)
    vocab = hmm.vocabulary(hmm.word_counts(docs.filter(~F.col("held"))), 50)
    sequences = hmm.encoded(docs, F.col("held"), vocab)
    trained = hmm.train(sequences, vocab, 3, 3)
    found = hmm.score(docs, F.col("held"), 3, 50, 3).collect()
    key = lambda r: tuple(str(x) for x in r)
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found], key=key)
    assert got == sorted([(*w[:5], round(w[5], 6)) for w in want], key=key)
    # the model's emissions, word by word, and the forward recursion over them
    place = {int(h): i for i, h in enumerate(vocab.words.tolist())}
    rare = {r.word: (r.n, r.steps) for r in trained.rare.collect()}
    total = vocab.tokens + vocab.types + 1
    assert len(rare) == len(counts) - 50 and sum(n for n, _ in rare.values()) == vocab.tokens - int(vocab.counts.sum())
    table = {h: trained.emissions(np.array([n]), np.array([s]), total)[0] for h, (n, s) in rare.items()}
    assert np.allclose(trained.model.emit.sum(axis=0) + sum(table.values()), 1)
    scores = []
    for i in range(len(rows)):
        hashes = hmm.token_hashes(pa.array([rows[i][1]], pa.string()))[0]
        a, log = trained.model.start, 0.0
        for t, h in enumerate(hashes.tolist()):
            e = trained.model.emit[place[h]] if h in place else table.get(int(np.uint64(h).view(np.int64)), trained.model.emit[-1])
            a = (a if t == 0 else a @ trained.model.step) * e
            log += np.log10(a.sum())
            a = a / a.sum()
        scores.append((rows[i][0], rows[i][2], round(log, 5)))
    assert sorted([(r.doc_id, r.held_out, round(r.score, 5)) for r in found], key=key) == sorted(scores, key=key)


def test_no_training_documents_and_empty_table(spark):
    docs = documents(spark, ["a b", None])
    rows = hmm.score(docs, F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(abs(r.score) < 1e-9 for r in rows)
    assert hmm.score(documents(spark, []), F.lit(False)).count() == 0


def test_states_beat_the_base(spark):
    r = random.Random(4)
    texts = [" ".join(f"{'xyz'[i % 3]}{r.randrange(60)}" for _ in range(50)) for i in range(300)]
    rows = hmm.score(documents(spark, texts), F.col("doc_id") % 7 == 2, frequent=90).collect()
    held = [x for x in rows if x.held_out]
    assert sum(x.score > x.base_score + 5 for x in held) > 0.9 * len(held)
