"""Toxicity: a support vector machine over a gapped-subsequence string kernel with Nystrom landmarks.

A sentence is read as strings of symbols: each of its words without inner punctuation, in lower case,
digit spellings folded, with a mark at both ends; single letters set apart ("i d i o t") are joined;
strings beyond WIDTH symbols are read in overlapping windows, so nothing is cut off. The kernel of
two strings is the normalised inner product of their subsequences of three symbols within SPAN
places, weighted by DECAY per place: inserted characters and gaps lower it only a little.

Training, on a bounded sample of labelled documents (SAMPLE_EACH of either label, copies by two
least hashes left out): a toxic label says that some string of the text is toxic. Runs of four to
eight symbols that stand in so many toxic and so few clean sample texts that chance cannot explain it
tell them: strings with such a run are the positive examples, strings of clean texts the negative ones, a second time with those the first machine
takes for toxic. Landmarks from both span the Nystrom features; a squared-hinge machine is
fitted to them. As the kernel is an inner product, landmarks and weights fold into one table of
64**3 values, so scoring a string costs ten look-ups for a character and no kernel evaluation.

A document scores by its worst string, put on the 0 to 1 scale by a logistic curve fitted to the
sample and set to the labels' share of toxic rows. Null and empty texts have no string and get the
curve's lowest value. Repeated labels of an id count as toxic if any is; null labels and ids teach
nothing. Repeated rows are scored each. Without both labels all score 0. An empty table gives an
empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.llm import vec
from docplan.llm.common import keep_where, least_scrambled, part_of, settled

#: Bounds of the fit sample, of the strings it teaches with, and of the landmarks.
SAMPLE_EACH, TAUGHT_POSITIVE, TAUGHT_NEGATIVE, TELLING, LANDMARKS = 4_000, 400, 4_000, 4_000, 320
SPAN, DECAY, WIDTH = 5, 0.4, 30
#: Lengths of the runs of symbols whose counts tell toxic strings.
GRAMS = (4, 5, 6, 7, 8)
#: Margins below the floor are not told apart.
FLOOR = -0.9

BASE = 64  # of symbol codes: 0 dropped, 1 end mark, 2-27 letters, 28-59 Latin-1 letters, 60-63 others
SYMBOL = np.zeros(256, np.uint8)
for _c in range(26):
    SYMBOL[[65 + _c, 97 + _c]] = 2 + _c
for _c, _as in zip("013457@", "oieasta"):  # digit spellings
    SYMBOL[ord(_c)] = 2 + ord(_as) - 97
SYMBOL[0xC4:256] = 60 + np.arange(0xC4, 256) % 4
_AFTER_C3 = np.zeros(256, np.uint8)  # second byte of the Latin-1 letters; capitals like small ones
for _c in range(0x80, 0xC0):
    _AFTER_C3[_c] = 28 + (_c if _c in (0x97, 0x9F, 0xB7, 0xBF) else _c | 0x20) % 32
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b <= SPAN]


def strings(piece: vec.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of the piece, and start, end and row of every string in them."""
    data = piece.data
    symbol = SYMBOL[data]
    if len(data) > 1:
        second = data[:-1] == 0xC3
        symbol[1:][second] = _AFTER_C3[data[1:][second]]
        tail = ~second & (data[1:] >= 0x80) & (data[1:] < 0xC0)
        symbol[1:][tail] = 60 + data[1:][tail] % 4
    w = vec.words(piece)
    count = np.concatenate([[0], np.cumsum(symbol > 0)])
    start, end = count[w.start], count[w.end]
    some = end > start
    start, end, row = start[some], end[some], w.row[some]
    single = end - start == 1
    joined = np.zeros(len(start), bool)
    joined[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1])
    head = np.flatnonzero(~joined)
    start, row = start[head], row[head]
    end = end[np.append(head[1:], len(end)) - 1] if len(head) else end[:0]
    long = end - start > WIDTH
    if long.any():
        extra = []
        for lo, hi, r in zip(start[long], end[long], row[long]):
            at = np.arange(lo, max(lo + 1, hi - WIDTH // 2), WIDTH // 2)
            extra.append((at, np.minimum(at + WIDTH, hi), np.full(len(at), r)))
        start = np.concatenate([start[~long], *(e[0] for e in extra)])
        end = np.concatenate([end[~long], *(e[1] for e in extra)])
        row = np.concatenate([row[~long], *(e[2] for e in extra)])
    return symbol[symbol > 0], start, end, row


def distinct(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct string, an example of it, and the number of each string among them."""
    power = vec.powers(0x9E3779B97F4A7C15, WIDTH + 1)
    size = end - start
    key = np.zeros(len(start), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        here = size > k
        key[here] += (symbols[start[here] + k] + np.uint64(1)) * power[k]
    return np.unique(vec.mix(key + size.astype(np.uint64)), return_index=True, return_inverse=True)


def matrix(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Strings as rows of symbols with end marks, padded with zeros."""
    size = end - start
    width = int(size.max()) if len(size) else 0
    out = np.zeros((len(start), width + 2), np.uint8)
    out[:, 0] = 1
    cols = np.arange(width)
    inside = cols < size[:, None]
    out[:, 1:-1][inside] = symbols[(start[:, None] + cols)[inside]]
    out[np.arange(len(start)), size + 1] = 1
    return out


def occurrences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all gapped triples of every row (0: none) and the weight of each column."""
    wide = rows.astype(np.int32)
    codes, weights = [], []
    for a, b in _STEPS:
        n = wide.shape[1] - a - b
        if n > 0:
            code = (wide[:, :n] * BASE + wide[:, a : a + n]) * BASE + wide[:, a + b :]
            codes.append(np.where(wide[:, a + b :] > 0, code, 0))
            weights.append(np.full(n, DECAY ** (a + b + 1)))
    if not codes:
        return np.zeros((len(rows), 0), np.int32), np.zeros(0)
    return np.concatenate(codes, axis=1), np.concatenate(weights)


def squared_norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n, t = codes.shape
    if not n or not t:
        return np.ones(n)
    order = np.argsort(codes, axis=1, kind="stable")
    code, weight = np.take_along_axis(codes, order, 1), np.where(np.take_along_axis(codes, order, 1) > 0, weights[order], 0)
    new = np.ones((n, t), bool)
    new[:, 1:] = code[:, 1:] != code[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, weight.ravel())
    return np.maximum(np.add.reduceat(sums**2, group.reshape(n, t)[:, 0]), 1e-12)


@dataclass
class Machine:
    """Folded weights, bias, and the logistic curve of a document's margin."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, rows: np.ndarray) -> np.ndarray:
        codes, weights = occurrences(rows)
        raw = self.table[codes] @ weights
        least = np.sqrt(np.maximum(((codes > 0) * weights**2).sum(1), 1e-12))
        out = np.full(len(rows), FLOOR)
        near = np.flatnonzero(raw / least + self.bias > FLOOR)
        if len(near):
            out[near] = np.maximum(FLOOR, raw[near] / np.sqrt(squared_norms(codes[near], weights)) + self.bias)
        return out

    def document_margins(self, piece: vec.Piece) -> np.ndarray:
        out = np.full(piece.rows, FLOOR)
        symbols, start, end, row = strings(piece)
        if len(start):
            _, example, number = distinct(symbols, start, end)
            s, e = start[example], end[example]
            margin = np.empty(len(s))
            for lo, hi in ((0, 6), (6, 10), (10, 16), (16, WIDTH + 1)):
                at = np.flatnonzero((e - s > lo) & (e - s <= hi))
                if len(at):
                    margin[at] = self.margins(matrix(symbols, s[at], e[at]))
            np.maximum.at(out, row, margin[number])
        return out

    def scores(self, batch: pa.RecordBatch, column: str = "text") -> np.ndarray:
        parts = [self.document_margins(p) for p in vec.pieces(batch, column, 1 << 19)]
        margin = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _matrix_of(texts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    return matrix(flat, ends - sizes, ends)


def fit(positive: list[bytes], negative: list[bytes], weight: list[float]) -> Machine:
    """A squared-hinge machine on Nystrom features; strings are bytes of symbols, positive ones weighted."""
    texts = positive + negative
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    half = LANDMARKS // 2
    marks = positive[:half] + negative[: LANDMARKS - min(half, len(positive))]
    lc, lw = occurrences(_matrix_of(marks))
    used = np.unique(np.append(lc, 0))  # 0 stands for no triple
    slot = np.zeros(BASE**3, np.int32)
    slot[used] = np.arange(len(used))
    dense = np.zeros((len(marks), len(used)))
    for d, c in zip(dense, lc):
        np.add.at(d, slot[c], lw)
        d[0] = 0
    dense /= np.sqrt(np.maximum((dense**2).sum(1, keepdims=True), 1e-12))
    codes, weights = occurrences(_matrix_of(texts))
    norm = np.sqrt(squared_norms(codes, weights))
    seen = slot[codes]
    kernel = np.stack([(d[seen] @ weights) / norm for d in dense], axis=1)
    values, vectors = np.linalg.eigh(dense @ dense.T)
    good = values > 1e-6 * values.max()
    project = vectors[:, good] / np.sqrt(values[good])
    x = np.column_stack([kernel @ project, np.ones(len(y))])
    share = np.sqrt(np.array(weight))
    cost = np.concatenate([len(negative) * share / share.sum(), np.ones(len(negative))]) * 10 / len(y)
    keep, w = np.ones(len(y), bool), np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 1e-3
    ridge[-1, -1] = 1e-9
    for _ in range(30):
        xs, cs = x[keep], cost[keep]
        w = np.linalg.solve(xs.T @ (xs * cs[:, None]) + ridge, xs.T @ (cs * y[keep]))
        now = y * (x @ w) < 1
        if (now == keep).all():
            break
        keep = now
    table = np.zeros(BASE**3)
    table[used] = (project @ w[:-1]) @ dense
    return Machine(table, float(w[-1]))


def _calibrate(machine: Machine, margin: np.ndarray, toxic: np.ndarray, share: float) -> Machine:
    """Logistic curve by Newton steps, with soft targets; then moved from the sample's share to `share`."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2) * 1e-3
        w += np.linalg.solve(h, x.T @ (target - p) - 1e-3 * w)
    move = np.log(share / (1 - share)) - np.log(n1 / n0) if 0 < share < 1 and n1 and n0 else 0.0
    return Machine(machine.table, machine.bias, float(w[0]), float(w[1] + move))


def grams(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of the runs of GRAMS symbols, end marks included, of every row (0: none), one length after the other."""
    wide = rows.astype(np.int64)
    for k in GRAMS:
        n = wide.shape[1] - k + 1
        if n > 0:
            code = np.full((len(wide), n), k)
            for j in range(k):
                code = code * BASE + wide[:, j : j + n]
            code[wide[:, k - 1 :] == 0] = 0
            yield code


def _gram_counts(sample: DataFrame) -> DataFrame:
    """Runs of symbols, and in how many toxic and clean sample texts each stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for p in vec.pieces(batch, "text", 1 << 18):
                symbols, start, end, row = strings(p)
                _, example, number = distinct(symbols, start, end)
                # each distinct string's codes, dealt to the rows that have it
                pair = np.unique(number.astype(np.int64) * p.rows + row)
                which, where = pair // p.rows, pair % p.rows
                for codes in grams(matrix(symbols, start[example], end[example])):
                    at, _ = np.nonzero(codes)
                    text_of = np.searchsorted(which, at)
                    count = np.searchsorted(which, at, "right") - text_of
                    names, code = np.unique(np.repeat(codes[codes > 0], count), return_inverse=True)
                    ahead = np.cumsum(count) - count
                    home = where[np.repeat(text_of - ahead, count) + np.arange(count.sum())]
                    both = np.unique(code.astype(np.int64) * p.rows + home)
                    toxic = np.bincount(both // p.rows, label[p.first + both % p.rows], len(names)).astype(np.int64)
                    total = np.bincount(both // p.rows, minlength=len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(toxic), pa.array(total - toxic)], ["gram", "toxic", "clean"])

    return sample.select("text", "label").mapInArrow(run, "gram bigint, toxic bigint, clean bigint").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _taught(sample: DataFrame, telling: np.ndarray) -> DataFrame:
    """Distinct strings of the sample texts, in how many toxic and clean ones each stands, and
    whether it holds a telling run of symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for p in vec.pieces(batch, "text", 1 << 18):
                symbols, start, end, row = strings(p)
                _, example, number = distinct(symbols, start, end)
                pair = np.unique(number.astype(np.int64) * p.rows + row)
                which, where = pair // p.rows, pair % p.rows
                toxic = np.bincount(which, label[p.first + where] > 0, len(example)).astype(np.int64)
                total = np.bincount(which, minlength=len(example))
                holds = np.zeros(len(example), bool)
                for codes in grams(matrix(symbols, start[example], end[example])):
                    holds |= np.isin(codes, telling).any(axis=1)
                raw = symbols.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw[a:b] for a, b in zip(start[example], end[example])], pa.binary()),
                     pa.array(toxic), pa.array(total - toxic), pa.array(holds)], ["string", "toxic", "clean", "holds"])

    return sample.select("text", "label").mapInArrow(run, "string binary, toxic bigint, clean bigint, holds boolean").groupBy("string").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("holds").alias("holds"))


def _two_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, next_low = [], []
        for p in vec.pieces(batch, "text"):
            w = vec.words(p)
            key = vec.hashes(p.data, w.start, w.end)
            for out, salt in ((low, 1), (next_low, 2)):
                least = np.full(p.rows, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, w.row, vec.mix(key + np.uint64(salt)))
                out.append(least.view(np.int64))
        if low:
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(np.concatenate(low)), pa.array(np.concatenate(next_low))],
                ["doc_id", "label", "a", "b"])


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, left_out: int = 0, label: str = "toxic", each: int = SAMPLE_EACH) -> Machine:
    """The machine learnt from at most `each` documents of either label outside the held-out part."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (part_of("doc_id", modulus) != left_out)).groupBy(
        "doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    nothing = Machine(np.zeros(BASE**3), -1.0, 1.0, -30.0)
    if len(shares) < 2:
        return nothing
    share = shares[1] / (shares[0] + shares[1])
    picked = least_scrambled(known.where("label = 1"), "doc_id", each).union(least_scrambled(known.where("label = 0"), "doc_id", each))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    sample = text.join(F.broadcast(picked), "doc_id").select("text", "doc_id", "label")
    one_each = sample.mapInArrow(_two_least, "doc_id bigint, label int, a bigint, b bigint").groupBy("a", "b").agg(
        F.min_by("doc_id", "doc_id").alias("doc_id"), F.min_by("label", "doc_id").alias("label")).toPandas()  # 2 * each rows
    if one_each["label"].nunique() < 2:
        return nothing
    chosen = docs.sparkSession.createDataFrame(one_each[["doc_id", "label"]], "doc_id bigint, label int")
    sample = text.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "label")
    n1, n0 = int((one_each["label"] == 1).sum()), int((one_each["label"] == 0).sum())
    runs = settled(_gram_counts(sample))
    often = runs.where("toxic + clean > 1").count()
    need = max(2, int(np.ceil(np.log(20 * max(often, 1)) / -np.log(n1 / (n1 + n0)))))
    telling = runs.where(f"toxic >= {need} and clean <= 0.03 * toxic").orderBy(F.desc("toxic"), "gram").limit(TELLING).select("gram")
    strings_of = settled(_taught(sample, np.array([r["gram"] for r in telling.collect()], np.int64)))
    support = max(2, int(0.002 * n1))  # rarer strings hold a telling run by chance as well
    found = strings_of.where(f"holds and toxic >= {support} and clean <= 0.03 * toxic").orderBy(
        F.desc("toxic"), "string").limit(TAUGHT_POSITIVE).collect()
    if not found:
        found = strings_of.where("toxic > 1 and clean = 0").orderBy(F.desc("toxic"), "string").limit(20).collect()
    positive, weight = [bytes(r["string"]) for r in found], [float(r["toxic"]) for r in found]
    clean = strings_of.where("clean > 0 and clean > 0.03 * toxic")
    negative = [bytes(r["string"]) for r in least_scrambled(clean, "string", TAUGHT_NEGATIVE // 2).collect()]
    if not positive or not negative:
        return nothing
    machine = fit(positive, negative, weight)

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            margin = [machine.margins(_matrix_of(found[k : k + 4096])) for k in range(0, len(found), 4096)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(margin or [np.zeros(0)]))], ["string", "margin"])

    hardest = clean.select("string").mapInArrow(hard, "string binary, margin double").where(f"margin > {FLOOR}").orderBy(
        F.desc("margin"), "string").limit(TAUGHT_NEGATIVE // 2)
    negative = list(dict.fromkeys([bytes(r["string"]) for r in hardest.collect()] + negative))
    machine = fit(positive, negative, weight)

    def worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [machine.document_margins(p) for p in vec.pieces(batch, "text", 1 << 19)]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), batch.column(2)], ["margin", "label"])

    told = sample.mapInArrow(worst, "margin double, label int").toPandas()  # 2 * each rows
    return _calibrate(machine, told["margin"].to_numpy(float), told["label"].to_numpy(float), share)


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    machine = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.scores(batch))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (part_of("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows, all columns, whose score stays below the threshold."""
    machine = train(docs, labels)
    return keep_where(docs, lambda batch: machine.scores(batch) < threshold)
