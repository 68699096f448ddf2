"""Language identification with error-correcting output codes.

Each language has a codeword; each bit of it is predicted by its own binary
classifier over letter n-grams.  Loss-weighted decoding picks the codeword of
least loss, each bit weighed by how well it told that language apart in
training; a small gap to the second one flags the prediction as ambiguous.

The classifiers are fitted on a bounded sample of the distinct labelled texts with
a letter, drawn for each language (SAMPLE_PER_LANGUAGE, less if there are so many
languages that SAMPLE_ROWS would be passed); copies of a text count once, and
every language that has such a text is learnt.  Every whole text is predicted.

Memory: texts are turned into dense rows of BUCKETS weights, at most CHUNK_ROWS
of them at once however short they are; the driver holds at most about
2 x SAMPLE_ROWS such rows, in half precision.

Defined results: a null text or one without a letter is `und` with score 0, as
is every text where there is nothing to learn from; of languages of equal loss the
first by name is predicted, flagged as ambiguous; repeated rows get equal
predictions; a very long text is one row whatever its length; extra columns, also
such as are named like a result, don't matter and come along only in `rest`; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linkwright.llm.runtime import arrow_map, arrow_type, batch, id_type, rest_of
from linkwright.llm.words import chunks, text_bytes

#: Training texts of each language, about; of fewer than twice as many, all are read.
SAMPLE_PER_LANGUAGE = 1500
#: Training texts of all languages, about; each has LEAST_SAMPLE at least.
SAMPLE_ROWS, LEAST_SAMPLE = 12_000, 4
#: Texts that are rows of weights at once.
CHUNK_ROWS = 256
#: Hash buckets of the n-grams.
BUCKETS = 4096
#: Loss below which the second codeword makes a prediction ambiguous.
MARGIN = 1.0
UNKNOWN = "und"

_FOLD = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint32)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of n-gram weights of unit length for each text; whether it has a letter."""
    data, at = text_bytes(pc.utf8_lower(texts.fill_null("")))
    n = len(at) - 1
    letters = _FOLD.take(data)
    text = np.repeat(np.arange(n), np.diff(at))
    counts = np.zeros((n, BUCKETS), np.float32)
    mult = np.uint32(2654435761)
    for size in (1, 2, 3):
        if len(letters) < size:
            continue
        code = letters[: len(letters) - size + 1].copy()
        for k in range(1, size):
            code = (code << np.uint32(8)) | letters[k : len(letters) - size + 1 + k]
        inside = text[: len(code)] == text[size - 1 :]
        # runs of gaps say nothing
        inside &= (letters[: len(code)] != 0x20) | (size > 1) & (letters[size - 1 :] != 0x20)
        bucket = ((code + np.uint32(size * 7919)) * mult) >> np.uint32(20)
        found = np.bincount(text[: len(code)][inside] * BUCKETS + bucket[inside], minlength=n * BUCKETS)
        counts += found.reshape(n, BUCKETS).astype(np.float32)
    weights = np.sqrt(counts)
    weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-9)
    plain = (data >= 0x61) & (data <= 0x7A)
    before = np.concatenate([[0], np.cumsum(plain)])
    lettered = before[at[1:]] > before[at[:-1]]
    for i in np.flatnonzero(~lettered & (np.diff(at) > 0)).tolist():  # perhaps letters beyond ASCII
        lettered[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode())
    return weights, lettered


def codewords(n: int) -> np.ndarray:
    """n x bits of -1 and 1: every split of few languages, else the best of some seeded random codes."""
    if n <= 5:
        rows = [c for c in product((-1, 1), repeat=max(n, 1)) if c[0] == 1 and -1 in c]
        return np.array(rows or [[1]]).T if n > 1 else np.ones((n, 1), int)
    bits = 8 + 4 * int(np.ceil(np.log2(n)))
    r = np.random.default_rng(11)

    def apart(code: np.ndarray) -> int:
        return int(((code[:, None] != code[None]).sum(axis=2) + bits * np.eye(n, dtype=int)).min())

    return max((r.choice((-1, 1), (n, bits)) for _ in range(50)), key=apart)


class Codes:
    """The learned languages, their codewords, and the bits' linear classifiers."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray, epochs: int = 25):
        self.languages, self.code = languages, codewords(len(languages)).astype(np.float32)
        bits = self.code.shape[1]
        self.weights, self.bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
        target = self.code[y]
        balance = (len(y) / np.maximum(np.bincount(y, minlength=len(languages)), 1) / len(languages)).astype(np.float32)[y]
        r = np.random.default_rng(5)
        m = v = np.zeros_like(self.weights)
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), 256):
                at = order[i : i + 256]
                some = x[at].astype(np.float32)
                margin = target[at] * (some @ self.weights + self.bias)
                slope = -target[at] * (balance[at] / len(at))[:, None] / (1 + np.exp(np.clip(margin, -30, 30)))
                g = some.T @ slope + 1e-6 * self.weights
                step += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                self.weights -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
                self.bias -= 0.5 * slope.sum(axis=0)
        # how often each bit was right for each language; rows add up to the number of bits
        margin = np.concatenate([x[i : i + 256].astype(np.float32) @ self.weights for i in range(0, len(x), 256)])
        right = (np.sign(margin + self.bias) == target).astype(np.float32)
        share = np.stack([right[y == i].mean(axis=0) if (y == i).any() else np.ones(bits) for i in range(len(languages))])
        self.trust = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-9) * bits

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest codeword's language, its share of the likelihoods, and the loss gap to the second."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * t).sum(axis=1) for c, t in zip(self.code, self.trust, strict=True)], axis=1)
        best = loss.argmin(axis=1)
        order = np.sort(loss, axis=1)
        share = 1 / np.exp(np.clip(order[:, :1] - loss, -60, 0)).sum(axis=1)
        return best, share, order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)


def fit(training: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> Codes | None:
    """Codes learnt from about `sample` distinct texts with a letter of each language of training (text, lang)."""
    text = F.col("text").cast("string")
    training = training.filter("lang IS NOT NULL").filter(text.rlike(r"\p{L}")).select(text.alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("key"))
    sizes = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    if not sizes:
        return None
    sample = max(LEAST_SAMPLE, min(sample, SAMPLE_ROWS // len(sizes)))
    # a language of under twice `sample` texts is taken whole; of others each text has the same chance, however often it is repeated
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, n // sample))])
    some = training.filter(F.pmod("key", share[F.col("lang")]) == 0).groupBy("lang", "key").agg(F.first("text").alias("text")).select("text", "lang")
    schema = pa.schema([("lang", pa.string()), ("x", pa.binary())])

    def make():
        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows, rows=CHUNK_ROWS):
                x, lettered = features(part.column(0))
                kept = np.flatnonzero(lettered)
                yield batch(schema, part.column(1).take(pa.array(kept)), [row.tobytes() for row in x[kept].astype(np.float16)])

        return each

    found = arrow_map(some, "lang string, x binary", make).toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    if not languages:
        return None
    x = np.frombuffer(b"".join(v.as_buffer() for v in found["x"]), np.float16).reshape(-1, BUCKETS)
    place = {lang: i for i, lang in enumerate(languages)}
    return Codes(languages, x, np.array([place[v] for v in found["lang"].to_pylist()]))


def identify(docs: DataFrame, training: Column, sample: int = SAMPLE_PER_LANGUAGE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row; learnt from the rows where `training` holds.

    With `carry`, the text and the columns named, but for the text, in one struct `rest` come along.
    """
    codes = fit(docs.filter(training), sample)
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    schema = pa.schema([("doc_id", arrow_type(docs)), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    ddl = f"doc_id {id_type(docs)}, lang_pred string, score double, ambiguous boolean"
    columns = docs.select("doc_id", F.col("text").cast("string").alias("text"), *rest_of(carry))
    if carry:
        ddl += f", text string, rest {columns.schema['rest'].dataType.simpleString()}"
        schema = schema.append(pa.field("text", pa.string())).append(pa.field("rest", to_arrow_type(columns.schema["rest"].dataType)))

    def make():
        codes = shared.value

        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows, rows=CHUNK_ROWS):
                x, lettered = features(part.column(1))
                if codes is None:
                    lettered[:] = False
                    best, share, gap = np.zeros(len(x), int), np.zeros(len(x)), np.zeros(len(x))
                else:
                    best, share, gap = codes.decode(x)
                names = [codes.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                yield batch(schema, part.column(0), names, np.where(lettered, share, 0.0), (gap < MARGIN) | ~lettered, *part.columns[1:] if carry else [])

        return each

    return arrow_map(columns, ddl, make)
