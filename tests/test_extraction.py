"""Behaviour of the extraction operators on small texts of our own."""

import datetime as dt

from docplan.functions.rows import table_of
from docplan.operators import actions, eligibility, evidence, gaps, temporal, text
from docplan.plans.analysis import analyse

TODAY = "date'2026-09-01'"


def dates(docs, *texts):
    rows = temporal.extract_temporal(docs(*texts), TODAY).orderBy("doc_id", "char_start").collect()
    for row in rows:
        assert texts[row.doc_id][row.char_start:row.char_end] == row.text
    return rows


def test_dates(docs):
    rows = dates(
        docs,
        "Dated 3 September 2026. Pay by 18 Sept, 2026 or 5 March.",
        "within seven working days; in 2 weeks",
        "from 1 September to 20 September 2026. between 20 Sep and 1 Sep.",
        "pay before 03/04/2026 or 25-12-26 or 31/31/2026",
        "on 29 February and 29 February 2025 due",
    )
    got = [(r.doc_id, r.resolved, r.confidence, r.is_deadline) for r in rows]
    d = dt.date
    assert got == [
        (0, d(2026, 9, 3), 0.97, False), (0, d(2026, 9, 18), 0.97, True),
        # the comma inside the first date starts a new clause, without the cue
        (0, d(2027, 3, 5), 0.72, False),
        (1, d(2026, 9, 10), 0.55, True), (1, d(2026, 9, 15), 0.55, True),
        (2, d(2026, 9, 1), 0.9, False), (2, d(2026, 9, 20), 0.72, False),
        (2, d(2026, 9, 1), 0.72, False),
        (3, d(2026, 4, 3), 0.45, True), (3, d(2026, 12, 25), 0.88, True),
        (4, d(2027, 2, 28), 0.72, True),
    ]


def test_comma_series_marks_one_cutoff(docs):
    rows = dates(docs, "entries since 3 March 2026, closing 21 April 2026, prizes 9 June 2026")
    assert [r.is_deadline for r in rows] == [False, True, False]


def test_sentences_skip_abbreviations(docs):
    body = "Meet Dr. Rao and R. K. Sharma at ten. Bring No. 5 form.\n- Item one\n\nEnd"
    rows = text.split_sentences(docs(body)).orderBy("sent_no").collect()
    assert [r.text for r in rows] == [
        "Meet Dr. Rao and R. K. Sharma at ten.", "Bring No. 5 form.", "- Item one", "End"]
    assert all(body[r.char_start:r.char_end] == r.text for r in rows)


def test_actions(docs):
    body = (
        "All interns enrolled for the camp must be checked by Dr. Rao.\n\n"
        "Collect the income certificate, sign the hostel undertaking and deposit it at the counter. "
        "Applicants holding a gate pass have to deposit the entry form along with the "
        "income certificate and a notarised copy of the lease by 20 September 2026."
    )
    rows = table_of(actions.with_candidates(docs(body)), "candidates", "doc_id").collect()
    assert [(r.description, r.verb, r.optional) for r in rows][:4] == [
        ("Check all interns enrolled for the camp by Dr. Rao", "confirm", False),
        ("Collect the income certificate", "obtain", True),
        ("Sign the hostel undertaking", "prepare", True), ("Deposit it", "submit", True)]
    assert rows[4].conditional_on == "for holding a gate pass"
    assert rows[4].requires[:2] == ["Entry form", "Income certificate"]


def test_gaps_and_criteria(docs):
    df = docs("Submit the prescribed form at the concerned office. Offices open at ten and "
              "close at five on all working days of the term. Nominal fee (Rs. 300). Second year and above with minimum 60% marks.")
    assert {r.question for r in gaps.extract_gaps(df).collect()} == {
        "Which office is this?", "Where is the prescribed form obtained?"}
    got = [(r.attribute, r.comparator, r.num_value) for r in
           eligibility.extract_criteria(df).orderBy("pos").collect()]
    assert got == [("year", "at_least", 2.0), ("score", "at_least", 60.0)]


def test_normalisation_and_anchor(spark, docs):
    df = docs("Please  submit-\nted ﬁne “Quote” ＡＢ now")
    assert text.normalize_text(df).first().normalized == 'please submitted fine "quote" ab now'
    quotes = spark.createDataFrame([(1, 0, 'FINE "quote"'), (2, 0, "absent")],
                                   "quote_id int, doc_id int, quote string")
    row = evidence.anchor_exact(quotes, df).collect()
    assert [(r.quote_id, r.matched) for r in row] == [(1, "ﬁne “Quote”")]


def test_prerequisite_inherits_deadline(docs):
    df = docs("Obtain the income certificate from the office. You must submit the income "
              "certificate before 20 September 2026.")
    steps = table_of(analyse(df, TODAY), "schedule", "doc_id").orderBy("ord").collect()
    assert [(s.action_id, str(s.effective_deadline), str(s.latest_start)) for s in steps] == [
        ("action-1", "2026-09-19", "2026-09-12"), ("action-2", "2026-09-20", "2026-09-19")]


def test_noun_after_any_number_of_blanks(docs):
    far = " " * 700
    bodies = [f"Candidates must read the{far}report and then submit it.",
              f"Candidates must{far}submit it.", "Students should re-submit, then attach the form.",
              "All must carry the record.", f"Interns must\n{far}not a{far}report; a check shall end."]
    rows = actions.governed_verbs(docs(*bodies), "found").df.selectExpr("doc_id", "inline(found)").collect()
    got = {}
    for r in rows:
        assert bodies[r.doc_id][r.char_start + r.verb_end - len(r.form):r.char_start + r.verb_end].lower() == r.form
        got.setdefault(r.doc_id, []).append(r.form)
    assert got == {0: ["submit"], 1: ["submit"], 2: ["attach"]}
