import numpy as np
import pyarrow as pa

from linkwright.llm.words import ALNUM, SPACE, chunks, words
from tests.llm.helpers import alnum_words, random_texts, space_words


def thue_morse(n, letters="ab"):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s.translate(str.maketrans("ab", letters))


def test_thue_morse_words_differ():
    """Such words collide in every polynomial hash modulo a power of two."""
    for n in (2, 8, 64, 128, 256, 512, 1024, 2048, 4096):
        a, b = words(pa.array([thue_morse(n), thue_morse(n, "ba")])).hash
        assert a != b


def test_words_against_brute_force():
    texts = random_texts(3, 40) + ["AbC aBc ABC\tx" + "y" * 300 + " " + "Y" * 300 + " é", "x" * 255, "X" * 256, "x" * 257, "x" * 257]
    for kind, plain in ((SPACE, space_words), (ALNUM, alnum_words)):
        w = words(pa.array(texts), kind)
        known = {}
        for i, t in enumerate(texts):
            own = w.hash[w.first[i] : w.first[i + 1]].tolist()
            want = plain(t)
            assert len(own) == len(want)
            for h, x in zip(own, want, strict=True):
                assert known.setdefault(x, h) == h
        assert len(set(known.values())) == len(known)


def test_chunks_bound_bytes_and_rows():
    rows = pa.RecordBatch.from_pydict({"text": ["ab"] * 1000 + ["x" * 5000, None, ""]})
    parts = list(chunks(rows, most=1000, rows=64))
    assert sum(p.num_rows for p in parts) == rows.num_rows and max(p.num_rows for p in parts) <= 64
    assert np.all([p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 1000 for p in parts])
