"""Pages of findings and the rules of claims, the page rule among them."""

from docplan.operators import claims, pages
from docplan.plans.analysis import analyse

BOUNDS = "array<struct<page:int,char_start:int,char_end:int>>"


def test_every_finding_has_its_page(spark):
    first, second = "CIRCULAR\n\nMembers must upload the bonafide certificate by 3 May 1998.", "Submit the prescribed form to the clerk."
    text = f"{first}\n\n{second}"
    rows = [(1, text, [(1, 0, len(first)), (2, len(first) + 2, len(text))]), (2, text, []), (3, text, None), (4, None, None)]
    docs = spark.createDataFrame(rows, f"doc_id int, text string, pages {BOUNDS}")
    out = analyse(docs.selectExpr("*", "1D as text_confidence", "'plain_text' as source_kind"), "date'1998-01-01'")
    found = {(r.doc_id, r.kind, r.char_start): r.page for r in pages.evidence_pages(out).collect()}
    assert {d for d, _, _ in found} == {1, 2, 3} and len(found) >= 9
    for (doc, _, start), page in found.items():
        assert page == (2 if doc == 1 and start > len(first) else 1)
    told = pages.audit_all_claims(out).collect()
    assert {r.kind for r in told} >= {"deadlines", "actions", "document_type", "title"} and all(r.violations == 0 for r in told)


def test_broken_claims_are_told(spark):
    bounds = [(1, 0, 10), (2, 11, 30)]
    good = ("FACT", 0.9, "why", 12, 15, "cde", 2)
    rows = [good, ("FACT", 0.9, "why", None, None, None, None), ("FACT", 1.5, "why", 12, 15, "cde", 2), ("FACT", 0.9, "", 12, 15, "cde", 2),
            ("FACT", 0.9, "why", 12, 12, "", 2), ("FACT", 0.9, "why", 12, 15, "xyz", 2), ("FACT", 0.9, "why", 12, 15, "cde", 1),
            ("FACT", 0.9, "why", 12, 15, "cde", None), ("MISSING", 0.9, "why", 12, 15, "cde", 2)]
    text = "0123456789\n" + "abcdefghijklmnopqrs"[1:]
    df = spark.createDataFrame([(k, text, bounds, *r) for k, r in enumerate(rows)], f"doc_id int, text string, pages {BOUNDS}, classification string, "
                               "score double, rationale string, char_start int, char_end int, evidence string, page int")
    told = sorted((r.doc_id, r.violation) for r in claims.audit_claims(df).collect())
    assert told == [(1, "unsourced"), (2, "score_range"), (3, "rationale_length"), (4, "empty_span"), (5, "wrong_slice"), (6, "wrong_page"),
                    (7, "no_page"), (8, "sourced_absence")]
