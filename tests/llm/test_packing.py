import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from linkwright.llm.packing import best_fit, pack, pack_documents, token_pieces
from linkwright.llm.queries import tokenizer_path
from tests.llm.helpers import documents, random_texts

TEXTS = random_texts(1, 20) + ["It's <|endoftext|> a<|ENDOFTEXT|>b \x01 x\x01y don't\u00a0stop ÀÉ e\u0301 12345", "word " * 9000]


def test_pieces_are_the_tokenizers(spark):
    encode = Tokenizer.from_file(tokenizer_path())
    rows = token_pieces(documents(spark, TEXTS), tokenizer_path(), window=64).collect()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length and r.start == len(found[r.doc_id])
        found[r.doc_id] += r.ids
        assert r.length <= 64
    for i, t in enumerate(TEXTS):
        assert found[i] == encode.encode(t or "", add_special_tokens=False).ids + [2], t


def test_windows_hold_their_pieces_without_gaps(spark):
    rows = pack_documents(documents(spark, TEXTS), tokenizer_path()).collect()
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(windows) <= 1.1 * sum(r.length for r in rows) / 4096 + 1


def test_best_fit_is_the_brute_force_one():
    r = np.random.default_rng(3)
    lengths = sorted(r.integers(1, 101, 500).tolist(), reverse=True)
    at, offset = best_fit(lengths, 100)
    rooms = []
    for n, w, o in zip(lengths, at, offset, strict=True):
        fits = [x for x in rooms if x >= n]
        if not fits:
            assert w == len(rooms) and o == 0
            rooms.append(100 - n)
        else:
            assert rooms[w] == min(fits) and o == 100 - rooms[w]
            rooms[w] -= n


def test_empty_table_and_null_ids(spark):
    assert pack_documents(documents(spark, []), tokenizer_path()).count() == 0
    twice = documents(spark, ["a b"]).unionByName(documents(spark, ["a b"]))
    assert pack(token_pieces(twice, tokenizer_path())).count() == 2
    none = documents(spark, [None]).selectExpr("cast(null as bigint) as doc_id", "text", "1 as start", "2 as sequence_id")
    assert [(r.doc_id, r.doc_tokens) for r in pack_documents(none, tokenizer_path()).collect()] == [(None, 1)]


@pytest.mark.parametrize("window", [1, 7])
def test_small_windows(spark, window):
    rows = pack(token_pieces(documents(spark, ["a b c d e f g h"]), tokenizer_path(), window=window, with_ids=False), window).collect()
    assert sum(r.length for r in rows) == 9 and max(r.length for r in rows) <= window


def test_large_and_null_ids_of_one_bucket(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b"), (None, "c"), (None, None), (big, "a b")], "doc_id long, text string")
    rows = pack_documents(docs, tokenizer_path()).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted([str(big), str(big), "None", "None"])
    assert sorted((r.sequence_id, r.offset) for r in rows)[0] == (0, 0) and len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_rows_of_one_id_fill_many_buckets(spark):
    """One document's key holds most rows: they are dealt out all the same."""
    docs = spark.createDataFrame([(7, "x")] * 600 + [(i, "y z") for i in range(50)], "doc_id long, text string")
    pieces = token_pieces(docs, tokenizer_path(), with_ids=False)
    rows = pack(pieces.repartition(3), 64, bucket_pieces=50).collect()
    assert len(rows) == 650 and len({r.sequence_id % 13 for r in rows if r.doc_id == 7}) > 6
