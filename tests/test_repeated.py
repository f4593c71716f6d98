"""Texts that several documents share are analysed once, and every document gets its rows."""

import datetime

from docplan.plans import repeated
from docplan.queries import extraction, registry

registry.load_all()


def test_every_document_is_named_once_by_a_row_of_its_text(spark):
    rows = [(k, "same") for k in range(95)] + [(k, f"own {k}") for k in range(95, 100)] + [(100, None), (101, None), (None, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = repeated.distinct_texts(docs, documents=20)
    assert sorted(map(tuple, repeated.per_document(found).collect()), key=str) == sorted(rows, key=str)
    sizes = {}
    for r in found.collect():
        sizes.setdefault(r.text, []).append(len(r.doc_ids))
    assert [len(v) for k, v in sizes.items() if k != "same"] == [1] * 6 and len(sizes["same"]) > 1
    assert repeated.distinct_texts(docs).where("text = 'same'").count() == 1


def test_actions_of_notices_in_the_same_words_are_found_once(spark, tmp_path):
    rows = [(12 * k + 1, 6, datetime.datetime(1996, 2, 15)) for k in range(70)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    assert extraction._actions(spark, str(tmp_path)).count() == 2  # typed ones and images
    got = registry.QUERIES["attach_deadlines"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
