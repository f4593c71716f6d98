"""Packing token ids into sequences of a fixed length by best-fit decreasing.

Documents become ids in Arrow batches: each distinct word is given to the tokenizer once and kept
in a bounded memory of the worker, which is exact because the tokenizer's pieces never span white
space. A document (with its end id) longer than a sequence is first cut into full windows, which
are sequences of their own; its rest and all shorter documents are dealt to bins by a hash, and
every bin is packed apart: pieces by falling length, each into the open sequence with the least
sufficient room, found by a segment tree indexed by remaining room. A bin holds BIN_PIECES pieces
on average, so a task's memory does not grow with the table; a bin leaves few half-empty sequences.

A null or empty text is its end id alone. Repeated rows are packed each. An empty table gives an
empty result. Columns other than id and text are not read. Sequence ids: bin * 2**32 + number for
packed ones, negative for full windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from docplan.llm import vec
from docplan.llm.common import settled

LENGTH, END, BIN_PIECES = 4096, 2, 8192
#: Slots of a task's memory of distinct words; at half full it starts anew.
SLOTS = 1 << 20
#: Kinds of bytes: 0 white space, 1 letters a-z, 2 ASCII signs, 3 digits, 4 anything else.
_KIND = np.full(256, 4, np.uint8)
_KIND[vec.SPACE] = 0
_KIND[97:123] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]] = 2
_KIND[48:58] = 3
#: Bytes as the characters a byte-level vocabulary writes them with.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_WRITTEN = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class WordMemory:
    """Ids of words under their hashes, in an open-addressing table of arrays."""

    def __init__(self, path: str, slots: int = SLOTS):
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for runs of letters, which need no normalising
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.number = np.zeros(self.slots, np.int32)
        self.used = 0
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.ids_used = np.zeros(1 << 18, np.uint32), 0

    def release(self) -> None:
        """Frees the words; the tokenizer stays with the worker."""
        size, self.slots = self.slots, 2
        self.clear()
        self.slots = size
        self.keys = None
        self.ids = np.zeros(0, np.uint32)

    def _walk(self, keys: np.ndarray, insert: bool) -> np.ndarray:
        """The number of every key (-1: unknown); with `insert`, distinct new keys get slots."""
        slot = (keys >> np.uint64(11)).astype(np.int64) & (self.slots - 1)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        fresh = self.used
        while len(open_):
            here = self.keys[slot[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.number[slot[open_[hit]]]
            empty = here == 0
            if insert:
                want = open_[empty]
                self.keys[slot[want]] = keys[want]
                won = want[self.keys[slot[want]] == keys[want]]
                self.number[slot[won]] = fresh + np.arange(len(won))
                out[won] = fresh + np.arange(len(won))
                fresh += len(won)
                stay = out[open_] < 0
            else:
                stay = ~hit & ~empty
            open_ = open_[stay]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
        return out

    def _ids_of(self, texts: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, of the plain words first, and how many each word has."""
        size = np.zeros(len(texts), np.int64)
        out = []
        easy, hard = np.flatnonzero(plain), np.flatnonzero(~plain)
        for lo in range(0, len(easy), 1024):
            part = easy[lo : lo + 1024]
            joined = b" ".join(texts[k] for k in part).decode("latin-1").translate(_WRITTEN | {32: 32})
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            size[part] = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
            out.append(ids)
        for k in hard:
            ids = np.array(self.tokenizer.encode(texts[k].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            size[k] = len(ids)
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), size

    def find(self, keys: np.ndarray, text_of, is_plain) -> np.ndarray:
        """The number of every word; `text_of(i)` gives the i-th one's bytes."""
        keys = np.maximum(keys, np.uint64(1))
        if self.keys is None or self.used > self.slots // 2 - len(keys):
            self.clear()
        out = self._walk(keys, False)
        new = np.flatnonzero(out < 0)
        if len(new):
            names, first = np.unique(keys[new], return_index=True)
            example = new[first]
            plain = is_plain[example]
            order = np.argsort(~plain, kind="stable")
            number = self._walk(names[order], True)
            ids, size = self._ids_of([text_of(i) for i in example[order]], plain[order])
            begin = self.ids_used + np.cumsum(size) - size
            self.used += len(names)
            self.at, self.count = _room(self.at, self.used), _room(self.count, self.used)
            self.ids = _room(self.ids, self.ids_used + len(ids))
            self.ids[self.ids_used : self.ids_used + len(ids)] = ids
            self.ids_used += len(ids)
            self.at[number], self.count[number] = begin, size
            out[new] = self._walk(keys[new], False)
        return out


def _room(values: np.ndarray, needed: int) -> np.ndarray:
    if needed <= len(values):
        return values
    grown = np.zeros(max(needed, 2 * len(values)), values.dtype)
    grown[: len(values)] = values
    return grown


def _cut(piece: vec.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, and start, end, row and plainness of units that the tokenizer treats apart.

    Words of letters (a-z, Latin-1), signs and digits are cut where the kind changes; other words,
    and those with an apostrophe or "<", stay whole and as they are.
    """
    data = vec.folded(piece)
    kind = _KIND[data]
    if len(data) > 1:
        pair = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        kind[:-1][pair] = 1
        kind[1:][pair] = 1
    w = vec.words(piece)
    others = np.concatenate([[0], np.cumsum(kind == 4)])
    odd = others[w.end] > others[w.start]
    if odd.any():
        turn = np.zeros(len(data) + 1, np.int32)
        turn[w.start[odd]] += 1
        turn[w.end[odd]] -= 1
        whole = np.cumsum(turn[:-1]) > 0
        kind[whole] = 4
        data[whole] = piece.data[whole]
    edge = np.zeros(len(data) + 1, bool)
    edge[piece.bounds] = True
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]]) if len(kind) else kind
    after = np.concatenate([kind[1:], np.zeros(1, np.uint8)]) if len(kind) else kind
    start = np.flatnonzero((kind > 0) & ((kind != before) | edge[:-1]))
    end = np.flatnonzero((kind > 0) & ((kind != after) | edge[1:])) + 1
    row = np.searchsorted(piece.bounds, start, "right") - 1
    return data, start, end, row, kind[start] == 1


_memories: dict[str, WordMemory] = {}


def document_ids(piece: vec.Piece, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a piece with their end ids, and where each row's begin."""
    if path not in _memories:
        _memories[path] = WordMemory(path)
    memory = _memories[path]
    data, start, end, row, plain = _cut(piece)
    raw = data.tobytes()
    number = memory.find(vec.hashes(data, start, end), lambda i: raw[start[i] : end[i]], plain)
    at, count = memory.at[number], memory.count[number]
    per_row = np.bincount(row, count, piece.rows).astype(np.int64) + 1
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    ahead = np.cumsum(count) - count
    out = np.empty(bounds[-1], np.uint32)
    is_end = np.zeros(bounds[-1], bool)
    is_end[bounds[1:] - 1] = True
    out[is_end] = END
    out[~is_end] = memory.ids[np.arange(int(count.sum())) + np.repeat(at - ahead, count)]
    return out, bounds


def tokenized(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in vec.pieces(batch, "text", 1 << 20):
                ids, bounds = document_ids(p, path)
                total = np.diff(bounds)
                parts = -(-total // length)
                row = np.repeat(np.arange(p.rows), parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                size = np.minimum(length, total[row] - start)
                begin = bounds[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), size.tolist())), np.int64, len(row))
                columns = [batch.column(0).take(pa.array(row + p.first)), pa.array(start), pa.array(size), pa.array(crc), pa.array(total[row])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut(batches)
        finally:
            if path in _memories:
                _memories[path].release()

    kinds = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


class RoomTree:
    """A segment tree over rooms 0..length: which of them some open sequence has."""

    def __init__(self, length: int):
        self.leaves = 1 << max(1, length.bit_length())
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = self.leaves + room
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the open sequence with the least room of `need` or more."""
        some, node = self.some, self.leaves + need
        if not some[node]:
            while node > 1 and (node & 1 or not some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if some[2 * node] else 2 * node + 1
        room = node - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            some[node] = 0
            node >>= 1
            while node and not (some[2 * node] or some[2 * node + 1]):
                some[node] = 0
                node >>= 1
        return room, sequence


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece; sizes fall and none exceeds `length`."""
    tree, opened = RoomTree(length), 0
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        found = tree.take(size)
        if found is None:
            room, number = length, opened
            opened += 1
        else:
            room, number = found
        sequence[k], offset[k] = number, length - room
        if room > size:
            tree.put(room - size, number)
    return sequence, offset


def _bin(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True, True], kind="stable")
    sequence, offset = best_fit_decreasing(frame["length"].to_numpy(), length)
    return frame.assign(sequence_id=(frame["bin"].to_numpy() << 32) + sequence, offset=offset)


def pack(pieces: DataFrame, length: int = LENGTH, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """sequence_id and offset of every piece (columns of `tokenized`)."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = settled(pieces.select(*columns))
    full = pieces.where(f"length = {length}")
    rest = pieces.where(f"length < {length}")
    bins = max(1, -(-rest.count() // bin_pieces))
    kinds = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bin bigint, sequence_id bigint, offset bigint"
    # the digest of the ids spreads repeated and null ids as well
    binned = rest.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(bins)))
    packed = binned.groupBy("bin").applyInPandas(lambda f: _bin(f, length), kinds).drop("bin")
    alone = full.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(alone)


def packed_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents with their places in sequences of `length` ids."""
    return pack(tokenized(docs, path or public_tokenizers.path("word_bpe_49k.json"), length), length)
