"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are measured once in Arrow batches and written (narrow rows). On a bounded
sample of labelled rows the model is fitted: for every feature a lookup table over its bins, grown
by cyclic gradient boosting of shallow trees on one feature at a time, then tables over pairs of
features for the pairs with the largest remaining gain. A score is the logistic function of a sum
of table entries.

Fit sample: at most SAMPLE_ROWS labelled training rows, those with the least scrambled id. Repeated
labels of an id are averaged (a half counts as 1); null labels and ids are not learned from. A null
text is an empty text; its features are zeros and it is scored like any other. Repeated rows are
scored each. Without both labels in the sample every score is the share of label 1 (0.5 without any).
An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.llm import host_rules, vec
from docplan.llm.common import keep_where, least_scrambled, part_of, settled

#: Bound of the fit sample; everything else covers all rows.
SAMPLE_ROWS = 20_000
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 150, 0.1, 8, 8, 40
SHRINK = 2.0  # added to the Hessian sum of a leaf

FEATURES = (
    "log_words", "mean_word", "symbols", "marks", "digits", "capitals", "beyond_ascii", "repeat_words",
    "distinct_words", "same_as_before", "dup_lines", "log_lines", "words_per_line", "long_words",
    "short_words", "exclamations", "commonest", "stops",
)

_CLASS = np.zeros((6, 256), bool)
_CLASS[0][[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_CLASS[1][48:58] = True
_CLASS[2][65:91] = True
_CLASS[3][128:] = True
_CLASS[4][33] = True
_CLASS[5][[46, 63]] = True


def features(piece: vec.Piece) -> np.ndarray:
    """A row of FEATURES for every row of the piece."""
    m = host_rules.measures(piece)
    rows, data = piece.rows, piece.data
    sums = np.zeros((6, len(data) + 1), np.int64)
    np.cumsum(_CLASS[:, data], axis=1, out=sums[:, 1:])
    marks, digits, capitals, beyond, shouts, stops = np.diff(sums[:, piece.bounds], axis=1).astype(float)
    low = vec.folded(piece)
    w = vec.words(piece, vec.BREAK, low)
    key = vec.hashes(low, w.start, w.end)
    size = w.end - w.start
    n = np.maximum(w.per_row, 1).astype(float)
    chars = np.maximum(np.diff(piece.bounds), 1).astype(float)
    same = np.zeros(len(w), bool)
    same[1:] = (key[1:] == key[:-1]) & (w.row[1:] == w.row[:-1])
    _, before = host_rules._again(key, w.row)
    order = np.lexsort((key, w.row))
    new = np.ones(len(w), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (w.row[order][1:] != w.row[order][:-1])
    at = np.flatnonzero(new)
    most = np.zeros(rows)
    np.maximum.at(most, w.row[order][at], np.diff(np.append(at, len(w))))
    by_row = lambda flag: np.bincount(w.row[flag], minlength=rows)
    lines = np.maximum(m["n_lines"], 1).astype(float)
    spaced = np.maximum(m["n_words"], 1).astype(float)
    return np.column_stack([
        np.log1p(m["n_words"]), m["word_chars"] / spaced, m["n_symbols"] / spaced, marks / chars, digits / chars,
        capitals / chars, beyond / chars, m["n_repeat_words"] / spaced, 1 - by_row(before) / n, by_row(same) / n,
        m["n_dup_lines"] / lines, np.log1p(m["n_lines"]), m["n_words"] / lines, by_row(size > 20) / n,
        by_row(size <= 1) / n, shouts / spaced, most / n, stops / spaced,
    ])


@dataclass
class AdditiveModel:
    """Tables over bins of features and of pairs of features."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (cut, values) in enumerate(zip(self.cuts, self.tables)):
            out += values[np.searchsorted(cut, x[:, j], "right")]
        for i, j, values in self.pairs:
            out += values[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="lower"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The step of a tree of up to `leaves` leaves on a row of bins with gradient and Hessian sums."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (lo, hi) in enumerate(parts):
            if hi - lo > 1:
                at = np.arange(lo + 1, hi)
                gain = (_gain(cg[at] - cg[lo], ch[at] - ch[lo]) + _gain(cg[hi] - cg[at], ch[hi] - ch[at])
                        - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo]))
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(at[gain.argmax()]))
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + SHRINK)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of a table into four rectangles: its gain and the step."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, step = -1.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, step
    tg, th = cg[-1, -1], ch[-1, -1]
    a = (cg[:-1, :-1], ch[:-1, :-1])
    b = (cg[:-1, -1:] - a[0], ch[:-1, -1:] - a[1])
    c = (cg[-1:, :-1] - a[0], ch[-1:, :-1] - a[1])
    d = (tg - a[0] - b[0] - c[0], th - a[1] - b[1] - c[1])
    gain = sum(_gain(*q) for q in (a, b, c, d))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = lambda q: q[0][i, j] / (q[1][i, j] + SHRINK)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :] = value(a), value(b)
    step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = value(c), value(d)
    return float(gain[i, j] - _gain(tg, th)), step


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting: every round one step for each feature, then rounds over the chosen pairs."""
    model = AdditiveModel()
    share = y.mean() if len(y) else 0.5
    model.base = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3)))
    if not len(y) or share in (0, 1):
        return model
    count = x.shape[1]
    model.cuts = [_cuts(x[:, j], BINS) for j in range(count)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(count):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            margin += step[bins[j]]
    model.pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(count)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.pair_cuts)]
    shape = [len(c) + 1 for c in model.pair_cuts]

    def cells(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slopes()
    ranked = sorted(((_quarters(cells(i, j, g), cells(i, j, h))[0], i, j) for i in range(count) for j in range(i + 1, count)), reverse=True)
    model.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for gain, i, j in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in model.pairs:
            g, h = slopes()
            step = RATE * _quarters(cells(i, j, g), cells(i, j, h))[1]
            values += step
            margin += step[coarse[i], coarse[j]]
    return model


def described(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of `keep` and an array column `features`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(p) for p in vec.pieces(batch, "text")]
            if parts:
                flat = np.concatenate(parts)
                ends = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], [*keep, "features"])

    taken = docs.select(F.col(text_col).alias("text"), *keep)
    kinds = ", ".join(f"`{c}` {taken.schema[c].dataType.simpleString()}" for c in keep)
    return taken.mapInArrow(run, f"{kinds}, features array<double>")


def training_labels(labels: DataFrame, modulus: int, left_out: int, label: str, rows: int) -> DataFrame:
    """id and label of at most `rows` labelled rows outside the held-out part."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (part_of("doc_id", modulus) != left_out))
    return least_scrambled(known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label")), "doc_id", rows)


def train(described_docs: DataFrame, labels: DataFrame, modulus: int = 4, left_out: int = 2, label: str = "quality", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """The model fitted to the features of the sampled labelled rows (`rows` at most reach the driver)."""
    sample = training_labels(labels, modulus, left_out, label, rows)
    found = described_docs.select("doc_id", "features").join(F.broadcast(sample), "doc_id").orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    x = np.array(found["features"].tolist(), float).reshape(len(found), len(FEATURES))
    return fit(x, found["label"].to_numpy(float))


def scored(described_docs: DataFrame, keep: list[str], model: AdditiveModel) -> DataFrame:
    """The columns of `keep` and `score`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(batch.num_columns - 1).flatten(), float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(x))], [*keep, "score"])

    taken = described_docs.select(*keep, "features")
    kinds = ", ".join(f"`{c}` {taken.schema[c].dataType.simpleString()}" for c in keep)
    return taken.mapInArrow(run, f"{kinds}, score double")


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    told = settled(described(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"]))
    return scored(told, ["doc_id"], train(told, labels)).select(
        "doc_id", (part_of("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_junk(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows, all columns, whose score reaches the threshold."""
    sample = training_labels(labels, 4, 2, "quality", SAMPLE_ROWS).select("doc_id")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id", "left_semi")
    model = train(described(own, ["doc_id"]), labels)

    def decide(batch: pa.RecordBatch) -> np.ndarray:
        parts = [model.score(features(p)) for p in vec.pieces(batch, "text")]
        return np.concatenate(parts) >= threshold if parts else np.zeros(0, bool)

    return keep_where(docs, decide)
