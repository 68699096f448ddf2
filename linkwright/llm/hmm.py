"""Hidden Markov language model over words.

Training words are counted over all training documents.  Baum-Welch: each pass
sums the expected counts of all training documents, every one read whole, and
re-estimates the model.  For speed a pass walks all documents of a batch at once,
long ones in segments; the state is carried over their borders in both
directions, so the counts are those of whole sequences.

The FREQUENT most frequent words have emissions of their own throughout; they are
a broadcast of bounded size.  During the passes all others share one open class.
The last pass gathers expected counts for every training word, rare ones in a
table keyed by word that grows with the corpus; from it each rare word gets
emissions of its own, by how its occurrences were shared out among the states (in
255ths).  A word of count c has probability (c + 1) / (N + V + 1) times a factor
for each state; the states' sums over all training words and one unknown word are
taken over the whole table, so each state spreads exactly one unit of probability.
Scoring joins the documents' rare words with the table and runs the scaled
forward recursion over the whole sequence.

Defined results: a null text is empty, so it is its end token alone; a null doc_id
is kept; repeated rows are scored and counted once for each row; of words of equal
count those of smaller hash are frequent, which changes no contracted count; a very
long text is one sequence; other columns don't matter; without training documents
every word has probability one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.runtime import arrow_map, arrow_type, batch, free_shuffles, id_type, saved
from linkwright.llm.words import SPACE, Lookup, chunks, ranges, words

STATES = 6
#: Words with emissions of their own.
FREQUENT = 1 << 17
#: Passes over all training documents.
PASSES = 8
#: Tokens of the segments that a pass walks at once; results don't depend on it.
SEGMENT = 512
#: Tokens of a batch of a pass, and of scoring.
BATCH_TOKENS = 600_000
#: Steps in which a rare word's share of each state is kept.
STEPS = 255
#: Tokens of a task in a pass, unless there are fewer tasks than twice the cores.
TASK_TOKENS = 20_000_000
#: Counts by which a word's share in each state is drawn to the state's share of all words.
SHRINKAGE = 4.0
#: Distinct words a task counts before it hands them on.
TASK_WORDS = 1_000_000
#: Rare words whose expected counts a task holds before it hands them on.
TASK_RARE = 300_000
END = np.uint64(0x9AE16A3B2F90404F)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, an end after each text's; first[i]: where text i begins."""
    w = words(texts, SPACE)
    out = np.insert(w.hash, w.first[1:], END)
    return out, w.first + np.arange(len(w.first))


def word_counts(training: DataFrame) -> DataFrame:
    """word (its hash), n: over all texts, an end token for each included."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def merged():
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        for rows in batches:
            for part in chunks(rows, most=2 << 20):
                k, c = np.unique(token_hashes(part.column(0))[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > TASK_WORDS:
                    k, c = merged()
                    keys, counts, held = [k], [c], len(k)
                    if held > TASK_WORDS // 2:
                        yield batch(schema, k.view(np.int64), c)
                        keys, counts, held = [], [], 0
        if held:
            k, c = merged()
            yield batch(schema, k.view(np.int64), c)

    return training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The frequent words with their counts, and the corpus totals."""

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int

    def base(self) -> np.ndarray:
        """log10 of each frequent word's probability in the add-one unigram model."""
        return np.log10((self.counts + 1) / (self.tokens + self.types + 1))

    def open_total(self) -> int:
        return int(self.tokens - self.counts.sum()) + (self.types - len(self.words)) + 1

    def prior(self) -> np.ndarray:
        """Probability of each frequent word, and at the end of the open class."""
        return np.append(self.counts + 1.0, self.open_total()) / (self.tokens + self.types + 1)


def vocabulary(counts: DataFrame, frequent: int) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toPandas()
    return Vocabulary(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), int(total[0]), int(total[1]))


def encoded(docs: DataFrame, held_out: Column, vocab: Vocabulary, packed: bool = False) -> DataFrame:
    """row, doc_id, held_out, tokens (numbers of frequent words; their count for the open class) and rare (hashes of the rest).

    packed: tokens are bytes, four a token, little-endian, which Spark hands on as they are.
    """
    kind = arrow_type(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vocab.words)
    schema = pa.schema([("doc_id", kind), ("held_out", pa.bool_()), ("tokens", pa.binary() if packed else pa.list_(pa.int32())), ("rare", pa.list_(pa.int64()))])

    def make():
        find = Lookup(shared.value)
        opened = len(shared.value)

        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows):
                hashes, first = token_hashes(part.column(1))
                code = find(hashes)
                rare = code < 0
                code[rare] = opened
                before = np.concatenate([[0], np.cumsum(rare)])
                tokens = packed_lists(first, code) if packed else pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(code, pa.int32()))
                others = pa.ListArray.from_arrays(pa.array(before[first], pa.int32()), pa.array(hashes[rare].view(np.int64)))
                yield batch(schema, part.column(0), part.column(2), tokens, others)

        return each

    out = arrow_map(docs.select("doc_id", "text", held_out.alias("held_out")), f"doc_id {id_type(docs)}, held_out boolean, tokens {'binary' if packed else 'array<int>'}, rare array<bigint>", make)
    return saved(out.select(F.monotonically_increasing_id().alias("row"), "*"), "encoded")


@dataclass
class Model:
    start: np.ndarray  # K
    step: np.ndarray  # K x K
    emit: np.ndarray  # words x K


def first_model(prior: np.ndarray, states: int) -> Model:
    """Sticky transitions and, for each state, the words' overall distribution shaken by a fixed seed."""
    noise = np.random.default_rng(7).gamma(2.0, size=(len(prior), states))
    emit = prior[:, None] * noise
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def padded(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens by time, then sequence, sequences by decreasing length; how many run at each time; their order."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    most = int(size.max()) if len(size) else 0
    running = np.searchsorted(-size[order], -np.arange(most), "left")
    flat = np.empty(int(size.sum()), np.int64)
    at = 0
    begin = first[:-1][order]
    for t, n in enumerate(running.tolist()):
        flat[at : at + n] = begin[:n] + t
        at += n
    return flat, running, order


def log_likelihood(model: Model, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence by the scaled forward recursion; every sequence has a token."""
    flat, running, order = padded(first)
    code = tokens[flat]
    out = np.zeros(len(first) - 1)
    total = np.zeros(len(first) - 1)
    a, at = None, 0
    scale = np.ones(len(first) - 1)
    for t, n in enumerate(running.tolist()):
        seen = model.emit.take(code[at : at + n], axis=0)
        a = seen * model.start if a is None else (a[:n] @ model.step) * seen
        s = a.sum(axis=1)
        a /= s[:, None]
        scale[:n] *= s
        if t % 8 == 7:  # eight factors of at least 1e-20 or so each stay in range
            total[:n] += np.log10(scale[:n])
            scale[:n] = 1
        at += n
    total += np.log10(scale)
    out[order] = total
    return out


def segments(first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequences cut after every `most` tokens: their bounds, and which are beginnings."""
    size = np.diff(first)
    many = -(-size // most)
    begin = np.repeat(first[:-1], many) + ranges(np.zeros(len(many), np.int64), many) * most
    heads = np.zeros(len(begin), bool)
    heads[np.cumsum(many) - many] = True
    return np.append(begin, first[-1]), heads


def carried(model: Model, seen: np.ndarray, running: np.ndarray, order: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment, in `order`: the state's distribution before its first token given all before, and (up to a factor) the likelihood of all after it by its last state.

    seen: the tokens' emissions, a row for each state.
    """
    k, n = len(model.start), len(order)
    begin, after = np.tile(model.start, (n, 1)), np.ones((n, k))
    if heads.all():
        return begin, after
    # the likelihood of a segment's tokens by its first and last state, up to a factor
    through = np.zeros((k, k, n))
    back = np.ascontiguousarray(model.step.T)
    at = 0
    for t, m in enumerate(running.tolist()):
        now = seen[None, :, at : at + m]
        through[:, :, :m] = (np.eye(k)[:, :, None] if t == 0 else back @ through[:, :, :m]) * now
        if t % 8 == 7:
            through[:, :, :m] /= through[:, :, :m].sum(axis=(0, 1))
        at += m
    through = np.ascontiguousarray((through / through.sum(axis=(0, 1))).transpose(2, 0, 1))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    opens = np.flatnonzero(heads)
    number = np.arange(n) - np.repeat(opens, np.diff(np.append(opens, n)))
    by_number = np.argsort(number, kind="stable")
    levels = np.split(by_number, np.cumsum(np.bincount(number))[:-1])
    for level in levels[1:]:
        last, own = place[level - 1], place[level]
        begin[own] = np.einsum("ni,nij->nj", begin[last], through[last]) @ model.step
        begin[own] /= begin[own].sum(axis=1, keepdims=True)
    for level in levels[:0:-1]:
        last, own = place[level - 1], place[level]
        after[last] = np.einsum("nij,nj->ni", through[own], after[own]) @ model.step.T
        after[last] /= after[last].sum(axis=1, keepdims=True)
    return begin, after


class Expected:
    """Expected counts of starts, steps and emissions, summed over batches."""

    def __init__(self, words: int, states: int):
        self.start, self.step, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((words, states))
        self.rare: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, model: Model, tokens: np.ndarray, first: np.ndarray, rare: np.ndarray | None = None) -> None:
        """Adds sequences; rare: the hashes of their open-class tokens, if these are to be counted word by word."""
        size = np.diff(first)
        opened = len(self.emit) - 1
        number = np.cumsum(tokens == opened) - 1 if rare is not None else None
        for chosen in (np.flatnonzero(size <= SEGMENT), np.flatnonzero(size > SEGMENT)):
            if len(chosen):
                at = ranges(first[chosen], size[chosen])
                self.walk(model, tokens[at], np.concatenate([[0], np.cumsum(size[chosen])]), None if rare is None else (rare, number[at]))

    def walk(self, model: Model, tokens: np.ndarray, first: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None) -> None:
        bounds, heads = segments(first, SEGMENT)
        flat, running, order = padded(bounds)
        code = tokens[flat]
        k = len(model.start)
        # a row for each state, so that every operation runs along the segments
        seen = model.emit.T.take(code, axis=1)
        forward, backward = np.ascontiguousarray(model.step.T), model.step
        begin, behind = (np.ascontiguousarray(x.T) for x in carried(model, seen, running, order, heads))
        ahead = np.empty_like(seen)
        starts = np.concatenate([[0], np.cumsum(running)])
        scale = np.empty(len(code))
        last = np.empty((k, len(order)))  # forward value of each segment's last token
        for t, n in enumerate(running.tolist()):
            i, j = starts[t], starts[t + 1]
            a = begin[:, :n] * seen[:, i:j] if t == 0 else (forward @ ahead[:, starts[t - 1] : starts[t - 1] + n]) * seen[:, i:j]
            scale[i:j] = s = a.sum(axis=0)
            last[:, :n] = ahead[:, i:j] = a / s
        behind /= (last * behind).sum(axis=0)
        seen /= scale
        back = behind
        for t in range(len(running) - 1, -1, -1):
            i, j = starts[t], starts[t + 1]
            n = j - i
            back = behind[:, :n] * seen[:, i:j]  # beta(t) times emission, scaled
            ahead[:, i:j] *= behind[:, :n]  # now the posterior of each state
            if t:
                # ahead of the time before still is the forward value
                self.step += model.step * (ahead[:, starts[t - 1] : starts[t - 1] + n] @ back.T)
                behind[:, :n] = backward @ back
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        later = np.flatnonzero(~heads)
        self.step += model.step * (last[:, place[later - 1]] @ back[:, place[later]].T)
        self.start += ahead[:, : len(order)][:, heads[order]].sum(axis=1)
        for s in range(k):
            self.emit[:, s] += np.bincount(code, ahead[s], len(self.emit))
        if rare is not None:
            hashes, number = rare
            open_class = np.flatnonzero(code == len(self.emit) - 1)
            words, place = np.unique(hashes[number[flat[open_class]]], return_inverse=True)
            self.rare.append((words, np.stack([np.bincount(place, minlength=len(words)).astype(float), *(np.bincount(place, ahead[s, open_class], len(words)) for s in range(k))], axis=1)))

    def rare_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the rare words so far, each with its count and its expected counts by state; they are forgotten."""
        if not self.rare:
            return np.empty(0, np.int64), np.empty((0, 1 + len(self.start)))
        words, place = np.unique(np.concatenate([w for w, _ in self.rare]), return_inverse=True)
        parts = np.concatenate([c for _, c in self.rare])
        self.rare = []
        return words, np.stack([np.bincount(place, parts[:, i], len(words)) for i in range(parts.shape[1])], axis=1)

    def share(self) -> np.ndarray:
        """Each state's share of all tokens."""
        share = self.emit.sum(axis=0) + 1e-9
        return share / share.sum()

    def model(self, prior: np.ndarray) -> Model:
        share = self.share()
        of_word = self.emit.sum(axis=1, keepdims=True)
        emit = prior[:, None] * (self.emit + SHRINKAGE * share) / ((of_word + SHRINKAGE) * share)
        return Model((self.start + 1) / (self.start + 1).sum(), (self.step + 1) / (self.step + 1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def packed_lists(first: np.ndarray, values: np.ndarray) -> pa.BinaryArray:
    places = pa.py_buffer((4 * first).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, places, pa.py_buffer(values.astype("<i4"))])


def lists(column: pa.ListArray | pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists or of packed lists, and where each list begins."""
    if not hasattr(column, "offsets"):
        _, places, data = column.buffers()
        wide = pa.types.is_large_binary(column.type)
        at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view("<i4"), (at - at[0]) // 4
    first = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]], first - first[0]


def pieces(rows: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    first = lists(rows.column(column))[1]
    i = 0
    while i < rows.num_rows:
        j = min(rows.num_rows, max(i + 1, int(np.searchsorted(first, first[i] + most, "right")) - 1))
        yield rows.slice(i, j - i)
        i = j


def baum_welch_pass(training: DataFrame, model: Model, prior: np.ndarray, with_rare: bool = False) -> tuple[Expected, DataFrame]:
    """One pass over training (tokens, rare): each task sums its expected counts, Spark sums them by word.

    The driver gets the bounded totals.  With `with_rare` the second result holds
    every rare word: word, n (its count) and s0, s1, ... (its expected counts).
    """
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(model)
    n_words, k = model.emit.shape
    sums_of = [f"s{i}" for i in range(k)]
    schema = pa.schema([("rare", pa.bool_()), ("word", pa.int64()), ("n", pa.float64()), *((c, pa.float64()) for c in sums_of)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Expected(n_words, k)

        def rare_words():
            words, counts = sums.rare_counts()
            return batch(schema, np.ones(len(words), bool), words, *counts.T)

        for rows in batches:
            for part in pieces(rows, 0, BATCH_TOKENS):
                sums.add(shared.value, *lists(part.column(0)), lists(part.column(1))[0] if with_rare else None)
                if sum(len(w) for w, _ in sums.rare) > TASK_RARE:
                    yield rare_words()
        if with_rare:
            yield rare_words()
        if not sums.emit.any():
            return
        # starts and steps go under numbers below zero
        table = np.concatenate([sums.emit, sums.step, sums.start[None]])
        number = np.concatenate([np.arange(n_words), -2 - np.arange(k), [-1]])
        some = table.any(axis=1)
        yield batch(schema, np.zeros(some.sum(), bool), number[some], np.zeros(some.sum()), *table[some].T)

    ddl = "rare boolean, word long, n double, " + ", ".join(f"{c} double" for c in sums_of)
    columns = ["tokens", "rare"] if with_rare else ["tokens"]
    found = training.select(*columns).mapInArrow(run, ddl).groupBy("rare", "word").agg(F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in sums_of])
    if with_rare:
        found = saved(found, "expected")
    own = found.filter(~F.col("rare")).drop("rare", "n").toPandas()
    table, number = own.iloc[:, 1:].to_numpy(), own["word"].to_numpy()
    sums = Expected(n_words, k)
    sums.emit[number[number >= 0]] = table[number >= 0]
    for i in range(k):
        sums.step[i] = table[number == -2 - i].sum(axis=0)
    sums.start = table[number == -1].sum(axis=0)
    return sums, found.filter("rare").drop("rare")


@dataclass
class Trained:
    """A model of all words: model.emit holds the frequent words and, last, an unknown one; rare ones are in a table."""

    model: Model
    share: np.ndarray
    norm: np.ndarray
    rare: DataFrame | None  # word, n, steps (a byte for each state)

    def emissions(self, n: np.ndarray, steps: np.ndarray, total: int) -> np.ndarray:
        """Of rare words of these counts, by state."""
        of_state = (steps[:, None] >> (8 * np.arange(len(self.share)))) & 255
        return ((n + 1.0) / total)[:, None] * (of_state / STEPS) / self.share / self.norm


def train(sequences: DataFrame, vocab: Vocabulary, states: int = STATES, passes: int = PASSES) -> Trained:
    """Baum-Welch over the rows of `encoded` that aren't held out; states <= 7, passes >= 1."""
    training = sequences.filter(~F.col("held_out")).select("tokens", "rare")
    prior = vocab.prior()
    model = first_model(prior, states)
    if not vocab.tokens:
        return Trained(model, np.full(states, 1 / states), np.ones(states), None)
    # each task hands on its words' sums once, so tasks are no more than they need be
    tasks = max(2 * sequences.sparkSession.sparkContext.defaultParallelism, -(-vocab.tokens // TASK_TOKENS))
    training = training.coalesce(tasks)
    for turn in range(passes):
        sums, rare = baum_welch_pass(training, model, prior, turn == passes - 1)
        model = sums.model(prior)
        free_shuffles(sequences.sparkSession)
    # every word of the open class gets what its own occurrences say
    share, total = sums.share(), vocab.tokens + vocab.types + 1
    e = sum(F.col(f"s{i}") for i in range(states))
    steps = [F.greatest(F.lit(1), F.round(STEPS * (F.col(f"s{i}") + SHRINKAGE * float(share[i])) / (e + SHRINKAGE)).cast("long")) for i in range(states)]
    packed = steps[0]
    for i in range(1, states):
        packed = packed.bitwiseOR(F.shiftleft(steps[i], 8 * i))
    rare = saved(rare.select("word", "n", packed.cast("long").alias("steps")), "rare")
    of_state = [(F.shiftright("steps", 8 * i).bitwiseAND(255) * (F.col("n") + 1)) for i in range(states)]
    mass = rare.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(f"m{i}") for i, x in enumerate(of_state)]).first()
    of_word = sums.emit[:-1].sum(axis=1, keepdims=True)
    emit = prior[:-1, None] * (sums.emit[:-1] + SHRINKAGE * share) / ((of_word + SHRINKAGE) * share)
    unknown = np.full((1, states), 1.0 / total)
    norm = emit.sum(axis=0) + np.array([float(m) for m in mass]) / STEPS / share / total + unknown[0]
    return Trained(Model(model.start, model.step, np.concatenate([emit, unknown]) / norm), share, norm, rare)


def score(docs: DataFrame, held_out: Column, states: int = STATES, frequent: int = FREQUENT, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs; training rows are those not held out."""
    spark = docs.sparkSession
    held_out = F.coalesce(held_out, F.lit(False))
    counts = saved(word_counts(docs.filter(~held_out)), "counts")
    vocab = vocabulary(counts, frequent)
    sequences = encoded(docs, held_out, vocab, packed=True)
    trained = train(sequences, vocab, states, passes)
    total = vocab.tokens + vocab.types + 1
    known = "array<struct<word:bigint,n:bigint,steps:bigint>>"
    if trained.rare is None:
        full = sequences.withColumn("known", F.lit(None).cast(known))
    else:
        # each rare word of a document meets its count and emissions
        wanted = sequences.select("row", F.explode(F.array_distinct("rare")).alias("word"))
        met = wanted.join(trained.rare, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n", "steps")).alias("known"))
        full = sequences.join(met, "row", "left")
    held = Trained(trained.model, trained.share, trained.norm, None)
    shared = spark.sparkContext.broadcast((held, vocab.base()))
    schema = pa.schema([("doc_id", arrow_type(docs)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def make():
        trained, base = shared.value
        frequent = len(base)

        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in pieces(rows, 2, BATCH_TOKENS):
                tokens, first = lists(part.column(2))
                rare, _ = lists(part.column(3))
                met = part.column(4).flatten()
                words, one = np.unique(met.field("word").to_numpy(zero_copy_only=False), return_index=True)
                n = met.field("n").to_numpy(zero_copy_only=False)[one].astype(np.int64)
                steps = met.field("steps").to_numpy(zero_copy_only=False)[one].astype(np.int64)
                # rare words known to the model are numbered after the unknown one
                code = tokens.astype(np.int64)
                if len(words) and len(rare):
                    at = np.minimum(np.searchsorted(words, rare), len(words) - 1)
                    code[code == frequent] = np.where(words[at] == rare, frequent + 1 + at, frequent)
                emit = np.concatenate([trained.model.emit, trained.emissions(n, steps, total)])
                of_base = np.concatenate([base, [np.log10(1 / total)], np.log10((n + 1) / total)])
                known = np.add.reduceat(code != frequent, first[:-1], dtype=np.int64)
                model = Model(trained.model.start, trained.model.step, emit)
                yield batch(schema, part.column(0), part.column(1), np.diff(first), known, np.add.reduceat(of_base[code], first[:-1]), log_likelihood(model, code, first))

        return each

    scored = arrow_map(full.select("doc_id", "held_out", "tokens", "rare", "known"), f"doc_id {id_type(docs)}, held_out boolean, n_tokens long, n_known long, base_score double, score double", make)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
