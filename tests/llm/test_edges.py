"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from docplan.llm import decontamination, host_rules, licenses, near_copies, packing, quality, quotations, sharding, suffix_tree, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (9, 0, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one two three")], "item_id bigint, text string")


ROWS = {
    "quality": lambda d, labels, bench: quality.rate(d, labels),
    "toxicity": lambda d, labels, bench: toxicity.rate(d, labels),
    "copies": lambda d, labels, bench: near_copies.deduplicated(d),
    "scores": lambda d, labels, bench: suffix_tree.scores(d),
    "shards": lambda d, labels, bench: sharding.shard(d),
    "rules": lambda d, labels, bench: host_rules.judge(d),
}


@pytest.mark.parametrize("name", ROWS)
def test_one_row_for_each(name, tricky, nothing, labels, bench):
    got = sorted((r["doc_id"] for r in ROWS[name](tricky, labels, bench).collect()), key=lambda v: (v is None, v))
    assert got == [1, 2, 3, 4, 4, 5, 6, 8, 9, None, None]
    assert ROWS[name](nothing, labels, bench).count() == 0


@pytest.mark.parametrize("rate, column", [(quality.rate, "quality"), (toxicity.rate, "toxic")])
def test_without_labels(rate, column, tricky, labels):
    scores = [r["score"] for r in rate(tricky, labels.where("false")).collect()]
    assert len(scores) == 11 and all(0 <= s <= 1 for s in scores)


def test_pairs_and_pieces(tricky, nothing, labels, bench):
    assert decontamination.contaminated(tricky, bench).count() == 0
    assert decontamination.contaminated(nothing, bench).count() == 0
    assert decontamination.contaminated(tricky, bench.where("false")).count() == 0
    assert licenses.scan(tricky).count() == 0 and licenses.scan(nothing).count() == 0
    pieces = packing.packed_documents(tricky).collect()
    assert sum(r["start"] == 0 for r in pieces) == 11 and packing.packed_documents(nothing).count() == 0


def test_filters_keep_columns(tricky, nothing, labels, bench):
    for keep in (lambda d: toxicity.without_toxic(d, labels), lambda d: quality.without_junk(d, labels), near_copies.without_near_copies,
                 lambda d: decontamination.without_contaminated(d, bench)):
        assert keep(tricky).columns == tricky.columns and keep(nothing).count() == 0
    kept = sorted((r["doc_id"] for r in near_copies.without_near_copies(tricky).collect()), key=lambda v: (v is None, v))
    assert kept == [1, 4, 6, 8, 9, None]  # one of the empty texts, one of the copies of 4


def test_messages(spark):
    rows = [(None, None, None, "a"), (1, None, "> x", "b"), (1, None, "> x", "b"), (2, 3, "", "c"), (3, 4, "> " + "word " * 100000, "d")]
    mail = spark.createDataFrame(rows, "message bigint, sent bigint, body string, level string")
    out = quotations.linked(mail)
    assert sorted((r["message"] is None, r["message"] or 0, r["depth"]) for r in out.collect()) == [(False, 1, 0), (False, 2, 0), (False, 3, 0), (True, 0, 0)]
    assert quotations.linked(mail.where("false")).count() == 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Every stage keeps what the operators' per-row results say, and packs all of it."""
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    labels, bench = spark.read.parquet(f"{source}/labels.parquet"), spark.read.parquet(f"{source}/benchmark.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    left = ids(docs)
    left -= ids(toxicity.rate(docs, labels).where("predicted = 1"))
    rest = docs.where(docs["doc_id"].isin([*left]))
    left &= ids(quality.rate(rest, labels).where("predicted = 1"))
    rest = docs.where(docs["doc_id"].isin([*left]))
    left &= ids(near_copies.deduplicated(rest).where("kept"))
    items = [r["text"].lower().split() for r in bench.collect()]
    for r in rest.collect():
        words = " " + " ".join((r["text"] or "").lower().split()) + " "
        if any(" " + " ".join(i) + " " in words for i in items):
            left.discard(r["doc_id"])
    out = corpus_pipeline.run(spark, source)
    assert ids(out) == left
    sums = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in sums)
