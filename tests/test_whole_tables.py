"""Queries over whole tables: work dealt evenly, analyses evaluated once, SQL and query by one rule."""

import datetime

import duckdb
import pytest

from docplan.operators import evidence, outputs, pages, quality
from docplan.queries import registry
from docplan.sources.notices import notices

registry.load_all()


@pytest.fixture
def orders(spark, tmp_path):
    """One file of one row group; the notices of order 13 and 25 are due on 29 February."""
    days = [datetime.datetime(1996, 2, 15) if k % 12 == 1 else datetime.datetime(1996, 3, 1) for k in range(48)]
    rows = [(k, k % 7, day) for k, day in enumerate(days)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").coalesce(1).write.parquet(
        f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def costly(spark):
    """A document whose findings come from an expression that names itself in the plan."""
    found = "named_struct('text', text, 'resolved', try_cast(regexp_extract(text, 'costly-pattern (.*)', 1) as date))"
    return spark.createDataFrame([(1, "costly-pattern 2024-02-28"), (2, "none")], "doc_id int, text string").selectExpr(
        "doc_id", f"array({found}) as temporal")


def test_date_catalogue_evaluates_the_dates_once(costly):
    catalogue = evidence.date_catalogue(costly)
    assert plan_of(catalogue).count("costly-pattern") == 1
    assert [tuple(r)[:2] for r in catalogue.collect()] == [(1, "date-1")]


def test_notices_of_one_row_group_are_dealt_to_all_cores(spark, orders):
    docs = notices(spark, orders)
    assert docs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert docs.count() == 48


@pytest.mark.parametrize("name", ["deadline_claims", "deadline_board", "actionable", "demote", "calibration"])
def test_29_february_without_a_year_is_unconfirmed_in_query_and_sql(spark, orders, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted(str([row[i] for i in order]) for row in want.fetchall())
    got = registry.QUERIES[name](spark, orders).select(*columns).collect()
    assert sorted(str(list(row)) for row in got) == expected


def test_audit_of_all_claims_analyses_once(spark, orders):
    audited = registry.QUERIES["audit_all_claims"](spark, orders)
    assert plan_of(audited).count("Relation [") == 1
    assert {r.kind: r.violations for r in audited.collect()} == dict.fromkeys(
        ("deadlines", "actions", "document_type", "title"), 0)


def test_a_broken_claim_is_counted_by_its_rules(spark):
    claim = "named_struct('classification', 'FACT', 'score', 1.5D, 'rationale', 'r', 'char_start', 0, 'char_end', {}, 'evidence', 'ab', 'page', 1)"
    bare = claim.replace("'evidence', 'ab', ", "")
    df = spark.range(1).selectExpr(
        "id as doc_id", "'abcd' as text", "array(named_struct('page', 1, 'char_start', 0, 'char_end', 4)) as pages",
        f"array({claim.format(2)}) as deadlines", f"array({bare.format(0)}) as actions",
        *[f"named_struct('classification', cast(NULL as string), 'score', 1D, 'rationale', '', 'char_start', 0, 'char_end', 1, "
          f"'evidence', 'a', 'page', 1) as {name}" for name in pages.SINGLE])
    found = {r.kind: (r.claims, r.violations) for r in pages.audit_all_claims(df).collect()}
    assert found == {"deadlines": (1, 1), "actions": (1, 2)}


def test_calendar_events_evaluate_the_schedule_once(spark):
    step = ("named_struct('action_id', 'a', 'latest_start', try_cast(regexp_extract(text, 'costly-pattern (.*)', 1) as date), "
            "'effective_deadline', date'2024-03-01', 'deadline', date'2024-03-01', 'rationale', 'r', 'requires', array('x'), "
            "'classification', 'FACT', 'score', 0.9D, 'claim_rationale', 'c', 'char_start', 0, 'char_end', 3, 'effort_days', 1, "
            "'description', 'd', 'verb', 'v')")
    claim = "named_struct('value', date'2024-03-01', 'rationale', 'r', 'evidence', 'e', 'score', 0.5D)"
    docs = spark.createDataFrame([(1, "costly-pattern 2024-02-28"), (2, "none")], "doc_id int, text string").selectExpr(
        "doc_id", "text", "'n' as name", f"array({step}) as schedule", f"if(doc_id = 2, {claim}, NULL) as primary_deadline",
        "true as is_feasible")
    events = outputs.calendar_events(docs)
    assert plan_of(events).count("costly-pattern") == 1
    assert sorted(r.event_id for r in events.collect()) == ["1-a", "2-deadline"]


def test_tallies_are_summed_before_arms_meet(spark):
    """No exchange by the arm alone may carry the tallies themselves."""
    tallies = spark.range(60).selectExpr(
        "if(id % 2 = 0, 'rules', 'hybrid') as arm", "concat('s', id % 3) as stage", "1 as tp", "0 as fp", "0 as fn")
    expected = spark.createDataFrame([("rules", 1), ("hybrid", 1)], "arm string, doc_id int")
    scores = quality.ablation(tallies, expected, expected.where("arm = 'rules'"))
    assert plan_of(scores).startswith("Join LeftAnti")
    assert {(r.arm, r.stage, r.tp) for r in scores.collect()} == {("rules", f"s{i}", 10) for i in range(3)}


def test_kinds_of_matched_requirements_are_held_against_labels(spark):
    """The kind of a match is right or wrong; a label without a match misses its kind too."""
    kind = "array(named_struct('text', 'Income certificate', 'kind', 'document'), named_struct('text', 'bank details', 'kind', '{}'), named_struct('text', '{}', 'kind', 'document'))"
    docs = spark.range(1).selectExpr(f"{kind.format('document', 'zonal bond')} as gold", f"{kind.format('information', 'resume')} as pred")
    assert tuple(docs.selectExpr(f"{quality.match_requirements('gold', 'pred')} as t").first().t) == (2, 1, 1, 1, 1, 1)


def test_enquiry_drafts_hold_the_letters(spark, tmp_path):
    """Query and SQL give each notice's letter, with every question in it."""
    rows = [(k, k % 20, datetime.datetime(1996, 2, 15)) for k in range(72)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, question_count, subject, body FROM ({registry.ORACLES['enquiry_drafts']})").fetchall()
    got = registry.QUERIES["enquiry_drafts"](spark, str(tmp_path)).select("doc_id", "question_count", "subject", "body").collect()
    assert sorted(want) == sorted(map(tuple, got)) and len(got) == 72
    for row in got:
        assert row.body.startswith("Dear Sir/Madam,") and all(f"\n{i + 1}. " in row.body for i in range(row.question_count))
    assert any(row.question_count > 3 for row in got) and any("Does that cover" in row.body for row in got)
