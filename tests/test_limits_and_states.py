"""Rows beyond the former limits, several patches of a document, portfolios without steps, odd characters."""

from pyspark.sql import functions as F

from docplan.functions import spans as S
from docplan.functions.rows import table_of
import random

from docplan.operators import actions, classify, portfolio, temporal, text, workspace
from docplan.plans.analysis import analyse
from docplan.sources import ingest


def test_type_words_count_wherever_they_stand(docs):
    body = "plain words of no kind " * 200 + "\nThis policy comes into force at once. Clause 4 is applicable to all."
    far = classify.with_type(docs(body)).select("document_type.type").first()[0]
    near = classify.with_type(docs(body), head_chars=2500).select("document_type.type").first()[0]
    assert (far, near) == ("policy", "other")


def test_issue_date_and_title_far_down(docs):
    body = "~ ~\n" * 300 + "Rules of the boat house\nDated 4 May 2026."
    row = docs(body).selectExpr(
        f"{temporal.issue_date('text', 'date\"2000-01-01\"')} as far",
        f"{temporal.issue_date('text', 'date\"2000-01-01\"', 400)} as near",
        f"{text.title_claim_column('text')}.value as title", f"{text.title_claim_column('text', 600)}.value as none").first()
    assert (str(row.far), str(row.near), row.title, row.none) == ("2026-05-04", "2000-01-01", "Rules of the boat house", None)


def test_ninth_requirement_and_long_descriptions_stay(docs):
    papers = ["visa letter", "tax receipt", "bank statement", "fee challan", "age proof", "sports certificate", "rent receipt",
              "income statement", "medical report", "travel form"]
    body = f"Visitors must submit the entry form along with {', '.join(papers)} and the guest photograph."
    row = table_of(actions.with_candidates(docs(body)), "candidates", "doc_id").first()
    assert len(row.requires) >= 11 and "Guest photograph" in row.requires
    assert row.description.endswith("guest photograph") and len(row.description) > 160
    cut = docs(body).selectExpr(f"{actions.shortened('text', 60)} as t").first()[0]
    assert len(cut) <= 61 and cut.endswith("…")


def test_uploads_of_any_size_unless_limited(spark):
    files = spark.createDataFrame([(1, b"word " * 50_000)], "doc_id int, content binary")
    refusal = lambda **kw: ingest.triage_uploads(files, **kw).select("refusal").first()[0]
    assert (refusal(), refusal(max_chars=200_000), refusal(max_bytes=1000)) == (None, "text is too long", "file is too large")


def test_control_characters_stay_in_matches(docs):
    body = "see \u0001x\u0002 and x\u0001 end"
    found = table_of(docs(body).selectExpr("doc_id", f"{S.find_all('text', '[^ ]*x[^ ]*')} as m"), "m", "doc_id").collect()
    assert [(r.char_start, r.text) for r in found] == [(4, "\u0001x\u0002"), (12, "x\u0001")]
    assert all(body[r.char_start : r.char_end] == r.text for r in found)


def _workspace(spark):
    return spark.createDataFrame(
        [(1, 10, [], "old"), (1, 11, ["a1"], None), (2, 20, [], None)], "owner_id int, doc_id int, completed array<string>, profile string")


def test_patches_are_judged_one_by_one(spark):
    patches = spark.createDataFrame(
        [(1, 10, 1, ["a1"], None, False), (1, 10, 2, None, "new", False), (1, 10, 3, ["zz"], "lost", False), (1, 11, 1, ["zz"], "x", False),
         (2, 11, 1, ["a1"], None, False), (2, 20, 1, None, None, True)],
        "owner_id int, doc_id int, arrival int, completed array<string>, profile string, clear_profile boolean")
    plans = spark.createDataFrame([(d, ["a1", "a2"]) for d in (10, 11, 20)], "doc_id int, action_ids array<string>")
    out = {(r.owner_id, r.doc_id): r for r in workspace.apply_patches(_workspace(spark), patches, plans).collect()}
    assert len(out) == 4
    assert (out[1, 10].status, out[1, 10].completed, out[1, 10].profile, out[1, 10].unknown) == ("patched", ["a1"], "new", ["zz"])
    assert (out[1, 11].status, out[1, 11].completed, out[1, 11].profile) == ("rejected", ["a1"], None)
    assert out[2, 11].status == "not_found" and out[2, 20].status == "patched"


def test_erased_counts(spark):
    requests = spark.createDataFrame([(1, 10), (2, None), (3, 20)], "owner_id int, doc_id int")
    assert {r.owner_id: r.removed for r in workspace.erased_counts(_workspace(spark), requests).collect()} == {1: 1, 2: 1}


def test_portfolios_without_steps_and_of_many_documents(docs, spark):
    texts = ["The hall is old.\n"] * 15
    members = spark.createDataFrame(
        [(1, k, k, f"n{k}") for k in range(2)] + [(2, k, k, f"n{k}") for k in range(15)] + [(3, 0, 0, "n0")],
        "portfolio_id int, doc_id int, pos int, name string")
    analysed = analyse(docs(*texts), "date'2026-09-01'")
    conflicts = portfolio.deadline_conflicts(portfolio.portfolio_rows(members, analysed))
    rows = portfolio.portfolio_summary(members, portfolio.portfolio_steps(members, analysed), conflicts).collect()
    assert sorted((r.portfolio_id, r.next_due, r.is_consistent) for r in rows) == [(1, None, True), (2, None, True)]
    sizes = {r.portfolio_id: r.refusal for r in portfolio.portfolio_sizes(members, 12).collect()}
    assert sizes == {1: None, 2: "too many documents", 3: "too few documents"}
    assert portfolio.valid_portfolios(members, 12).select(F.count_distinct("portfolio_id")).first()[0] == 1


def test_pairs_of_a_portfolio_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(portfolio, "BLOCK", 3)
    rng = random.Random(8)
    words = [f"word{k}" for k in range(14)]
    rows = [(p, k, k, f"d{k}", sorted(rng.sample(words, rng.randrange(9))), None, []) for p in (1, 2) for k in range(25)]
    rows += [(1, 30, 30, "same", words, None, []), (1, 31, 31, "same", words, None, [])]
    kinds = "portfolio_id int, pos int, doc_id int, name string, subject array<string>, due date, criteria array<struct<attribute:string>>"
    docs = spark.createDataFrame(rows, kinds)
    for least in (0.0, 0.25, 0.6, 1.0):
        want = set()
        for a in rows:
            for b in rows:
                both = len(set(a[4]) & set(b[4]))
                if a[0] == b[0] and a[1] < b[1] and both and both / min(len(a[4]), len(b[4])) >= least:
                    want.add((a[0], a[2], b[2], round(both / min(len(a[4]), len(b[4])), 6)))
        got = portfolio.related_pairs(docs, least).collect()
        assert len(got) == len(want) and {(r.portfolio_id, r.l.doc_id, r.r.doc_id, round(r.related, 6)) for r in got} == want
