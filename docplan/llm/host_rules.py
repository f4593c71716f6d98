"""Quality rules judged by host: failures are counted by host, rates are shrunk, verdicts go back.

Each document is measured once (`measured`, whole texts, any number of words) and tried against
RULES. Per host the failures of all its documents are counted; a beta prior fitted to the hosts'
rates by moments pulls the rate of a small host to the mean of all. A host whose shrunk rate
exceeds HOST_LIMIT is rejected, and with it all its documents; so is each document that fails the
base rules itself.

Counting uses partial sums, so a host with a third of all rows is no burden; of the hosts, only the
rejected ones are joined back. Null hosts are judged together as one host. A null or empty text has
no words and fails the base rules. Repeated rows each count. An empty table gives an empty result.
Columns of the input other than id, text and host are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.llm import vec
from docplan.llm.common import settled

#: Other failures that count against a host, besides the base rules.
RULES = {
    "symbols": "n_symbols > 0.1 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
}
BASE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
#: A host is rejected when its shrunk failure rate exceeds this.
HOST_LIMIT = 0.7
#: Weight of the prior, in documents, where the hosts' rates do not tell it (equal rates, one host).
PRIOR_WEIGHT = 20.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _again(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether its row has it more than once, and whether it came before in the row."""
    many, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key):
        with np.errstate(over="ignore"):
            mixed = vec.mix(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(mixed, kind="stable")
        same = mixed[order][1:] == mixed[order][:-1]
        before[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return many, before


def measures(piece: vec.Piece) -> dict[str, np.ndarray]:
    """The counts of every row of a piece."""
    rows, data = piece.rows, piece.data
    w = vec.words(piece)
    key = vec.hashes(data, w.start, w.end)
    out = {"n_words": w.per_row}
    heads = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~vec.SPACE[data])])
    signs = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out["word_chars"] = np.diff(heads[piece.bounds])
    out["n_symbols"] = np.diff(signs[piece.bounds])
    start, end = vec.lines(piece)
    row = np.repeat(np.arange(rows), np.bincount(
        np.searchsorted(piece.bounds, np.flatnonzero(data == 10), "right") - 1, minlength=rows)[:rows] + 1)
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    out["n_lines"] = np.bincount(row[full], minlength=rows)
    _, before = _again(vec.hashes(data, start[full], end[full]), row[full])
    out["n_dup_lines"] = np.bincount(row[full][before], minlength=rows)
    three = vec.runs(key, 3)
    whole = w.row[: len(three)] == w.row[2:] if len(three) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    many, _ = _again(three[at], w.row[at])
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[at[many] + k] = True
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=rows)
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measures(p) for p in vec.pieces(batch, "text")]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2)]
                    + [pa.array(np.concatenate([p[m] for p in parts]), pa.int64()) for m in _MEASURES],
                    ["doc_id", "host", *_MEASURES])

    taken = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                        F.col(host_col).cast("string").alias("host"))
    return taken.mapInArrow(run, "doc_id bigint, host string, " + ", ".join(f"{m} bigint" for m in _MEASURES))


def host_rates(tried: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, shrunk rate and verdict, of rows with host and failed."""
    hosts = tried.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.var_samp(rate).alias("var"),
        F.avg(F.lit(1.0) / F.col("n_docs")).alias("noise"),
    ).select(F.coalesce("mean", F.lit(0.0)).alias("mean"), F.expr(
        # observed variance = true variance + mean * (1 - mean) * E(1/n); weight = mean (1 - mean) / true - 1
        f"""case when var - mean * (1 - mean) * noise > 1e-9
             then greatest(1d, least(1e6d, mean * (1 - mean) / (var - mean * (1 - mean) * noise) - 1))
             when var is null or mean is null then {PRIOR_WEIGHT}d else 1e6d end""").alias("weight")).first()
    return hosts.withColumn(
        "rate", (F.col("n_failed") + F.lit(prior["mean"] * prior["weight"])) / (F.col("n_docs") + F.lit(prior["weight"]))
    ).select("host", "n_docs", "n_failed", "rate", (F.col("rate") > limit).alias("rejected"))


def judge(docs: DataFrame, limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Each document's counts, base_failed, failed (any rule), its host's verdict and kept."""
    tried = settled(measured(docs, id_col, text_col, host_col).select(
        "*", F.expr(BASE).alias("base_failed"),
        F.expr(" or ".join(f"({r})" for r in (BASE, *RULES.values()))).alias("failed")))
    bad = host_rates(tried, limit).where("rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("host_rejected"))
    return tried.join(bad, tried["host"].eqNullSafe(bad["bad_host"]), "left").drop("bad_host").withColumn(
        "host_rejected", F.coalesce("host_rejected", F.lit(False))
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
