"""Packing of tokenised documents into windows by best-fit decreasing.

Overlong documents are first cut into full windows.  Pieces are dealt into
buckets of bounded size by a hash of their document and place, and every
bucket is packed on its own: pieces in decreasing length, each put into the
open window with the least room that still holds it, found by a segment tree
indexed by remaining capacity.  A bucket wastes at most about one window, so
the loss against one global packing is one window in some thousands.

Defined results: a null text is an empty document, which is its end token
alone; a null doc_id is kept, and ids of any type and size come out as they went
in; repeated rows are packed once for each row, dealt out by their place in the
table, so that they don't crowd a bucket; equal lengths are ordered by document and
place; a very long text makes many pieces; other columns don't matter; an empty
table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.runtime import arrow_map, arrow_type, batch, id_type, saved
from linkwright.llm.words import SPACE, Places, chunks, ranges, words

WINDOW = 4096
END_ID = 2
#: Pieces of one bucket, on average.
BUCKET_PIECES = 8192
#: Words whose ids a worker keeps.
KEPT_WORDS = 1_000_000
#: Words that one call of the tokenizer encodes.
CALL_WORDS = 8192
#: Stands between words that are encoded together.
MARK = "\x01"


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins across white space.

    Each distinct word is encoded once and its ids are looked up afterwards.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        (self.mark,) = self.encode([MARK], add_special_tokens=False)[0].ids
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.ids = np.empty(1 << 20, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.used = 0

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """One call encodes these new words, set apart by a mark that is a token of its own; a word that holds it goes alone."""
        plain = [t for t in texts if MARK not in t]
        found = np.array(self.encode([f" {MARK} ".join(plain)], add_special_tokens=False)[0].ids if plain else [], np.uint32)
        cut = np.flatnonzero(found == self.mark)
        if plain and len(cut) != len(plain) - 1:
            raise ValueError("the tokenizer doesn't keep words apart at white space")
        parts = np.diff(np.concatenate([[-1], cut, [len(found)]])) - 1 if plain else []
        found = found[found != self.mark]
        if len(plain) < len(texts):
            each = iter(np.split(found, np.cumsum(parts)[:-1]) if plain else [])
            all_ids = [next(each) if MARK not in t else np.array(self.encode([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts]
            found, parts = np.concatenate(all_ids), np.array([len(x) for x in all_ids])
        n, used = len(self.place), self.used + len(found)
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids) // 2, len(found)), np.uint32)])
        if n + len(keys) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(len(self.start) // 2, len(keys)), np.int64)])
        self.ids[self.used : used] = found
        self.start[n + 1 : n + 1 + len(keys)] = self.used + np.cumsum(parts)
        self.place.add(keys)
        self.used = used

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids and, for each text, where its ids begin (one more at the end)."""
        w = words(texts, SPACE, lower=False)
        if not len(w.hash):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        distinct, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.place) > KEPT_WORDS:
            self.forget()
        place = self.place.find(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            data = w.data.tobytes()
            place[new] = len(self.place) + np.arange(len(new))
            for i in range(0, len(new), CALL_WORDS):
                some = new[i : i + CALL_WORDS]
                at = where[some]
                self.learn(distinct[some], [data[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
        place = place[back]
        start = self.start[place]
        size = self.start[place + 1] - start
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[ranges(start, size)], ends[w.first]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """The process's own: what one task has learnt, later ones in the same worker know."""
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids: each document's ids cut into full windows and a rest."""
    kind = arrow_type(docs)
    schema = pa.schema([("doc_id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def make():
        encode = word_tokenizer(tokenizer)

        def each(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in chunks(rows, most=1 << 20):
                ids, at = encode(part.column(1))
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), window):
                        piece = own[s : s + window]
                        row.append(i)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(own))
                        if with_ids:
                            kept.append(piece.astype(np.int32))
                yield batch(schema, part.column(0).take(pa.array(row)), start, length, crc, total, *[kept] * with_ids)

        return each

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {id_type(docs)}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids, make)


class Capacities:
    """Segment tree over remaining capacities 0 to most: how many open windows have each."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = self.leaves + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, room: int) -> int:
        i = self.leaves + room
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.open[room].pop()

    def tightest(self, need: int) -> int:
        """The least capacity of at least `need` that some window has, or -1."""
        i = self.leaves + need
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Window and offset of each length, given in decreasing order."""
    rooms, at, offset, opened = Capacities(window), [], [], 0
    for n in lengths:
        room = rooms.tightest(n) if n < window else -1
        if room < 0:
            room, w, opened = window, opened, opened + 1
        else:
            w = rooms.take(room)
        at.append(w)
        offset.append(window - room)
        if room > n:
            rooms.put(room - n, w)
    return at, offset


def pack(pieces: DataFrame, window: int = WINDOW, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """pieces (doc_id, start, length, ..., as read from files) with sequence_id and offset; offsets are gapless from 0 in each sequence."""
    buckets = max(1, -(-pieces.count() // bucket_pieces))
    orders = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")]

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=orders))
        at, offset = best_fit(rows["length"].to_pylist(), window)
        sequence = np.array(at, np.int64) * buckets + rows["bucket"].to_numpy()
        rows = rows.drop_columns(["bucket", "row"])
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset, pa.int64()))

    # a row's number follows from the files alone, so a task run again gives the same
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInArrow(packed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    return pack(saved(token_pieces(docs, tokenizer, window, end_id, with_ids), "pieces"), window)
