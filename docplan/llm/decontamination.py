"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming
search, exact weighted-shingle similarity.

Texts are read as lower-case words without punctuation and their shingles of five words. On every
text, windows of each item size start at every STRIDE-th shingle; their 64-bit SimHash comes from
running sums of the shingles' bits. An item is fingerprinted at all STRIDE phases a window can meet
it at, so an exact copy always has distance 0 to one of them. Fingerprints are cut into three
blocks: two that differ in at most RADIUS bits differ in at most RADIUS // 3 bits of some block, so
looking each block up among all variants of the items' blocks with that many flips finds every
fingerprint within RADIUS; what is found is compared in full. Fingerprints leave some copies to chance
and know no window that a row's start or end cuts short, so candidates are also the places of an item's
anchors: its rarest shingles, of more than 1 - THRESHOLD of its weight together. A window that reaches
the threshold lacks at most that weight, so it holds an anchor. Near a candidate every start is
verified: the weighted Jaccard similarity of the item's shingles and those of the item-sized window
there, cut off at the ends of the row (weights: bytes of a shingle, counted as often as it occurs),
must reach the threshold. So every pair is found, with its best window.

Texts never leave their task and are not shuffled. The items are used in blocks of ITEM_BLOCK (all
are used, whatever their number; each block is one pass over the texts), which bounds what a task
holds. Null and empty texts, and items of fewer than five words, match nothing. Repeated items and
rows are matched each; the pairs are distinct. Empty tables give an empty result. Columns other than
ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.llm import vec
from docplan.llm.common import keep_where

WIDTH, THRESHOLD, STRIDE, RADIUS, ITEM_BLOCK = 5, 0.8, 4, 14, 1024
#: Bits of the three blocks: first bit and number.
_BLOCKS = ((0, 21), (21, 21), (42, 22))


def shingles(piece: vec.Piece) -> tuple[vec.Words, np.ndarray, np.ndarray]:
    """Words, and hash and bytes of the shingle that starts at each word (rows may be crossed)."""
    data = vec.folded(piece)
    w = vec.words(piece, vec.BREAK, data)
    size = np.concatenate([[0], np.cumsum(w.end - w.start)])
    n = max(0, len(w) - WIDTH + 1)
    return w, vec.runs(vec.hashes(data, w.start, w.end), WIDTH), size[WIDTH:] - size[:n]


def _sums(hashed: np.ndarray, step: int) -> np.ndarray:
    """Running sums of the bits of every `step` shingles, modulo 256."""
    n = len(hashed) // step
    bits = np.unpackbits(np.ascontiguousarray(hashed[: n * step]).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((n + 1, 64), np.uint8)
    if n:
        np.cumsum(bits.reshape(n, step, 64).sum(axis=1, dtype=np.uint8), axis=0, dtype=np.uint8, out=out[1:])
    return out


def _wide_sums(hashed: np.ndarray, step: int) -> np.ndarray:
    n = len(hashed) // step
    bits = np.unpackbits(np.ascontiguousarray(hashed[: n * step]).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((n + 1, 64), np.int32)
    np.cumsum(bits.reshape(n, step, 64).sum(axis=1, dtype=np.int32), axis=0, out=out[1:])
    return out


def fingerprints(hashed: np.ndarray, step: int, count: int, sums: dict | None = None) -> np.ndarray:
    """SimHash of the windows of `count` steps that start at every step."""
    wide = step * count > 255
    sums = {} if sums is None else sums
    if (step, wide) not in sums:
        sums[step, wide] = (_wide_sums if wide else _sums)(hashed, step)
    c = sums[step, wide]
    if len(c) <= count:
        return np.zeros(0, np.uint64)
    return np.packbits(c[count:] - c[:-count] > step * count // 2, axis=1).view(np.uint64).ravel()


class Index:
    """The items of one block: shingles with weights, and fingerprints by window size."""

    def __init__(self, items: list[tuple[object, str]], threshold: float = THRESHOLD, radius: int = RADIUS):
        self.threshold, self.radius = threshold, radius
        self.ids, self.bags, self.sizes = [], [], []
        self.classes: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for key, text in items:
            batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], ["text"])
            for piece in vec.pieces(batch, "text"):
                _, hashed, weight = shingles(piece)
                if not len(hashed):
                    continue
                number, n = len(self.ids), len(hashed)
                self.ids.append(key)
                self.sizes.append(n)
                self.bags.append(_bag(hashed, weight))
                step = STRIDE if n >= 2 * STRIDE - 1 else 1
                count = (n - step + 1) // step
                for phase in range(step):
                    own = fingerprints(hashed[phase : phase + step * count], step, count)
                    self.classes.setdefault((step, count), []).append((int(own[0]), number, phase))
        self._tables: dict | None = None
        self._marked: np.ndarray | None = None
        self.anchors, self.anchored = self._anchors()

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchors, ascending, and their items."""
        if not self.bags:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known, often = np.unique(np.concatenate([b[0] for b in self.bags]), return_counts=True)
        found = []
        for keys, counts, weights in self.bags:
            order = np.argsort(often[np.searchsorted(known, keys)], kind="stable")
            sums = np.cumsum((counts * weights)[order])
            found.append(keys[order[: 1 + np.searchsorted(sums, (1 - self.threshold) * sums[-1] + 1e-9, side="right")]])
        keys, items = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
        order = np.argsort(keys, kind="stable")
        return keys[order], items[order]

    def anchors_in(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (shingle, item of which it is an anchor)."""
        if self._marked is None:
            self._marked = np.zeros(1 << 20, bool)
            self._marked[self.anchors & np.uint64((1 << 20) - 1)] = True
        at = np.flatnonzero(self._marked[hashed & np.uint64((1 << 20) - 1)])
        lo, hi = (np.searchsorted(self.anchors, hashed[at], side=side) for side in ("left", "right"))
        size = hi - lo
        each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(at, size), self.anchored[np.repeat(lo, size) + each]

    def tables(self) -> dict:
        """For every window size: fingerprints, items, phases and the marked values of each block."""
        if self._tables is None:
            self._tables = {}
            for size, rows in self.classes.items():
                prints = np.array([r[0] for r in rows], np.uint64)
                blocks = []
                for first, bits in _BLOCKS:
                    own = (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                    marked = np.zeros(1 << bits, bool)
                    for flips in range(min(self.radius // len(_BLOCKS), bits) + 1):
                        masks = np.array([sum(1 << b for b in c) for c in combinations(range(bits), flips)], np.uint64)
                        for value in own:
                            marked[value ^ masks] = True
                    blocks.append((np.uint64(first), np.uint64((1 << bits) - 1), np.packbits(marked, bitorder="little")))
                self._tables[size] = (prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), blocks)
        return self._tables

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "_marked": None}

    def near(self, prints: np.ndarray, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, fingerprint of the class) within the radius."""
        own, _, _, blocks = self.tables()[size]
        maybe = np.zeros(len(prints), bool)
        for first, mask, marked in blocks:  # bits in bytes: small enough to stay in the cache
            value = ((prints >> first) & mask).astype(np.uint32)
            maybe |= (marked[value >> 3] >> (value & 7).astype(np.uint8) & 1).view(bool)
        at = np.flatnonzero(maybe)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        rows = max(1, (1 << 14) // len(own))
        apart = np.empty((rows, len(own)), np.uint64)
        bits = np.empty((rows, len(own)), np.uint8)
        for lo in range(0, len(at), rows):
            part = at[lo : lo + rows]
            n = len(part)
            np.bitwise_xor(prints[part, None], own[None, :], out=apart[:n])
            np.bitwise_count(apart[:n], out=bits[:n])
            hit = np.flatnonzero(bits[:n].ravel() <= self.radius)
            if len(hit):
                found.append((part[hit // len(own)], hit % len(own)))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def matches(self, piece: vec.Piece) -> list[tuple[int, int, float, int]]:
        """(row, item number, similarity, first word) of the best window of each pair over the threshold."""
        w, hashed, weight = shingles(piece)
        near: dict[tuple[int, int], list[int]] = {}  # places that windows to verify hold
        sums: dict = {}
        for (step, count), (_, items, phases, _) in self.tables().items():
            prints = fingerprints(hashed, step, count, sums)
            if not len(prints):
                continue
            window, which = self.near(prints, (step, count))
            start = window * step
            inside = w.row[start] == w.row[start + step * count + WIDTH - 2]
            window, which, start = window[inside], which[inside], start[inside]
            for item, at in set(zip(items[which].tolist(), (start - phases[which]).tolist())):
                row = int(w.row[min(max(at, 0) + STRIDE, len(w) - 1)])
                near.setdefault((row, item), []).extend((at, at + self.sizes[item] - 1))
        at, items = self.anchors_in(hashed)
        inside = w.row[at] == w.row[at + WIDTH - 1]
        for row, item, place in zip(w.row[at[inside]].tolist(), items[inside].tolist(), at[inside].tolist()):
            near.setdefault((row, item), []).append(place)
        found = []
        for (row, item), places in near.items():
            lo, hi = int(w.first[row]), int(w.first[row] + w.per_row[row] - WIDTH + 1)
            if lo < hi:
                share, at = self._best(item, hashed, weight, lo, hi, np.array(places))
                if share >= self.threshold:
                    found.append((row, item, share, at - lo))
        return found

    def _best(self, item: int, hashed: np.ndarray, weight: np.ndarray, lo: int, hi: int, places: np.ndarray) -> tuple[float, int]:
        """Similarity and start of the best window of a row (shingles lo to hi) that holds one of the places."""
        n, (keys, counts, weights) = self.sizes[item], self.bags[item]
        places = np.sort(places)
        best = (0.0, lo)
        for group in np.split(places, np.flatnonzero(np.diff(places) > 2 * n) + 1):
            start = np.arange(group[0] - n + 1, group[-1] + 1)
            a, b = np.clip(start, lo, hi), np.clip(start + n, lo, hi)
            a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            first, last = int(a[0]), int(b[-1])
            own = weight[first:last]
            member = np.isin(hashed[first:last], keys)
            all_sums, sums = (np.concatenate([[0], np.cumsum(x)]) for x in (own, own * member))
            # at most so much is shared
            shared, both = (sums[b - first] - sums[a - first]).astype(float), float((counts * weights).sum()) + all_sums[b - first] - all_sums[a - first]
            bound = np.minimum(1.0, shared / np.maximum(both - shared, 1e-9))
            for k in np.argsort(-bound, kind="stable").tolist():
                if bound[k] < self.threshold - 1e-9 or bound[k] <= best[0]:
                    break
                share = _similar(keys, counts, weights, hashed[a[k] : b[k]], weight[a[k] : b[k]])
                if share > best[0]:
                    best = (share, int(a[k]))
        return best


def _bag(hashed: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, first, counts = np.unique(hashed, return_index=True, return_counts=True)
    return keys, counts, weight[first]


def _similar(keys: np.ndarray, counts: np.ndarray, weights: np.ndarray, hashed: np.ndarray, weight: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles."""
    own, own_counts, own_weights = _bag(hashed, weight)
    at = np.searchsorted(own, keys)
    at[at == len(own)] = 0
    shared = np.where(own[at] == keys, np.minimum(counts, own_counts[at]), 0)
    both = float((shared * weights).sum())
    return both / (float((counts * weights).sum()) + float((own_counts * own_weights).sum()) - both)


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """All items, in blocks of about ITEM_BLOCK; each reaches the driver on its own."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    for k in range(blocks):
        yield Index([(r["id"], r["text"]) for r in items.where(
            F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()], threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of every document and item it holds."""
    taken = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def scan(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(p.first + row, *rest) for p in vec.pieces(batch, "text") for row, *rest in index.matches(p)]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([f[0] for f in found])),
                         pa.array([index.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()),
                         pa.array([f[3] for f in found], pa.int64()),
                         pa.array([index.sizes[f[1]] + WIDTH - 1 for f in found], pa.int64())],
                        ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return taken.mapInArrow(run, "doc_id bigint, item_id bigint, similarity double, first_word bigint, n_words bigint")

    best = F.max(F.struct("similarity", -F.col("first_word"), "n_words"))
    return reduce(DataFrame.unionByName, map(scan, indexes(benchmark, threshold))).groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.col2")).alias("first_word"), "best.n_words")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, that hold no item."""

    def clean(index: Index):
        def decide(batch: pa.RecordBatch) -> np.ndarray:
            keep = np.ones(batch.num_rows, bool)
            for p in vec.pieces(batch, "text"):
                for row, *_ in index.matches(p):
                    keep[p.first + row] = False
            return keep

        return decide

    return reduce(lambda df, index: keep_where(df, clean(index)), indexes(benchmark, threshold), docs)
