"""Expected findings of the derived notices, computed from table columns alone.

Plain SQL for a second engine. No extraction pattern is evaluated here: each
template states what it contains, and offsets come from searching the known
phrase in the rebuilt text.
"""

from __future__ import annotations

from docplan.functions import lexicon as L
from docplan.operators.temporal import UNSTATED
from docplan.sources import notices as N

TODAY = "DATE '1998-06-15'"
EXPLICIT = "'Day, month and year are all stated explicitly.'"
FULL_DATE = "'absolute'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cap(value: str) -> str:
    return f"concat(upper(left({value}, 1)), substr({value}, 2))"


#: This year's (1998) or next year's occurrence of the due day.
NEXT_DUE = (
    "CASE WHEN month(due) = 2 AND day(due) = 29 THEN DATE '1999-02-28' "
    "WHEN make_date(1998, month(due), day(due)) >= DATE '1998-06-15' "
    "THEN make_date(1998, month(due), day(due)) "
    "ELSE make_date(1999, month(due), day(due)) END"
)
RELATIVE = (
    "CASE unit WHEN 'days' THEN issued + n WHEN 'weeks' THEN issued + 7 * n "
    "WHEN 'months' THEN CAST(issued + to_months(n) AS DATE) ELSE "
    "list_filter(list_transform(range(1, 40), lambda i: issued + CAST(i AS INT)), "
    "lambda x: isodow(x) < 6)[n] END"
)
SWAPPED = "CASE WHEN day(due) <= 12 AND day(due) <> month(due) THEN " \
          "make_date(year(due), day(due), month(due)) END"
#: A year can only be left out of the expected value where both readings exist.
AMBIGUOUS = "(day(due) <= 12 AND day(due) <> month(due))"

# (templates, phrase, kind, resolved, window end, confidence, cutoff, alternate, rationale)
_NO = "NULL"
DATES = (
    ("tpl IN (0, 4)", N.long_date("issued"), "absolute", "issued", _NO, "0.97", "false", _NO, EXPLICIT),
    ("tpl = 10 AND variant = 2", N.long_date("issued"), "absolute", "issued", _NO, "0.97", "false", _NO, EXPLICIT),
    ("tpl IN (0, 6, 7)", N.long_date("due"), "absolute", "due", _NO, "0.97", "true", _NO, EXPLICIT),
    ("tpl = 1", N.day_month("due"), "absolute", NEXT_DUE, _NO, "0.72", "true", _NO,
     f"concat('No year is stated; resolved to the next ', {N.month_name('due')}, ' ', "
     "CAST(day(due) AS STRING), ' on or after 1998-06-15.')"),
    ("tpl = 2", N.month_day("due"), "absolute", "due", _NO, "0.97", "true", _NO, EXPLICIT),
    ("tpl = 3", N.numeric_date("due"), "absolute", "due", _NO,
     f"CASE WHEN {AMBIGUOUS} THEN 0.45 ELSE 0.88 END", "true", SWAPPED,
     f"CASE WHEN {AMBIGUOUS} THEN concat('Numeric date is ambiguous: reads as ', "
     f"CAST(due AS STRING), ' (day/month) or ', CAST({SWAPPED} AS STRING), "
     "' (month/day). Confirm before relying on it.') ELSE "
     "'Numeric date; only one field ordering yields a valid calendar date.' END"),
    ("tpl = 4", "concat('within ', CAST(n AS STRING), ' ', unit)", "relative", RELATIVE, _NO,
     "0.55", "true", _NO,
     "concat('Relative period of ', CAST(n AS STRING), ' ', CASE unit WHEN 'days' THEN "
     "'calendar days' WHEN 'working days' THEN 'working days, excluding weekends' ELSE unit END, "
     "', counted from ', CAST(issued AS STRING), '. The document does not state the date the "
     "period starts from, so this depends on when it was received.')"),
    ("tpl = 5 AND cust % 5 <> 0",
     f"concat('from ', {N.long_date('opens')}, ' to ', {N.long_date('due')})",
     "window", "opens", "due", "0.9", "false", _NO, "'Both ends of the period are stated.'"),
    ("tpl = 5 AND cust % 5 = 0", N.long_date("opens"), "absolute", "opens", _NO, "0.97", "false", _NO, EXPLICIT),
    ("tpl = 5 AND cust % 5 = 0", N.long_date("due"), "absolute", "due", _NO, "0.97", "false", _NO, EXPLICIT),
)


def _dates() -> str:
    arms = []
    for where, phrase, kind, resolved, end, conf, cutoff, alternate, why in DATES:
        arms.append(
            f"SELECT doc_id, CAST(strpos(text, {phrase}) - 1 AS INT) AS char_start, "
            f"CAST(strpos(text, {phrase}) - 1 + length({phrase}) AS INT) AS char_end, "
            f"{phrase} AS text, {_q(kind)} AS kind, {resolved} AS resolved, "
            f"CAST({end} AS DATE) AS window_end, CAST({conf} AS DOUBLE) AS confidence, "
            f"{why} AS rationale, {cutoff} AS is_deadline, CAST({alternate} AS DATE) AS alternate "
            f"FROM n WHERE {where}"
        )
    return " UNION ALL ".join(arms)


MODAL = "Sentence states an obligation using a modal verb."
DIRECT = "Sentence is phrased as a direct instruction."
OPTIONAL = " The document offers this rather than requiring it."
COORDINATED = (
    "Coordinated with an earlier instruction in the same sentence, so it carries slightly less "
    "weight than the instruction that states the obligation."
)
_S = N.SENTENCES
#: A due date in May reads as the modal "may", which outranks a bare imperative.
MAY_NOTE = (
    f"CASE WHEN month(due) = 5 THEN {_q(MODAL + OPTIONAL)} ELSE {_q(DIRECT + OPTIONAL)} END"
)
_APPLY = f"CASE WHEN cust % 5 = 0 THEN {_S['apply_reversed']} ELSE {_S['apply']} END"

# (templates, no, sentence, description, verb, confidence, rationale, requires with |,
#  restriction, optional, deadline)
ACTIONS = (
    ("tpl = 0", 1, _S["along"],
     f"concat('Deposit the allotment form along with the ', art1, added, ' and ', art2, "
     f"' before ', {N.long_date('due')})", "submit", "0.94", MODAL,
     f"concat('Allotment form|', {_cap('art1')}, CASE WHEN added = '' THEN '' ELSE "
     f"'|Bank statement' END, '|', {_cap('art2')})", _NO, "false", "due"),
    ("tpl = 1", 1, _S["upload"], f"concat('Upload the ', art1, ' by ', {N.day_month('due')})",
     "submit", "0.86", MODAL, _cap("art1"), _NO, "false", NEXT_DUE),
    ("tpl = 2", 1, _S["furnish"],
     f"concat('Furnish the ', art1, ' not later than ', {N.month_day('due')})", "submit", "0.94",
     MODAL,
     f"concat({_cap('art1')}, ' not later than ', {N.month_name('due')}, ' ', "
     "CAST(day(due) AS STRING))", _NO, "false", "due"),
    ("tpl = 3", 1, _S["collect"],
     f"concat('Collect the fee receipt before ', {N.numeric_date('due')})", "obtain", "0.94",
     MODAL, "''", _NO, "false", "due"),
    ("tpl = 4", 1, _S["complete"],
     "concat('Complete registrations within ', CAST(n AS STRING), ' ', unit, ' of this circular')",
     "prepare", "0.94", MODAL, "''", _NO, "false", RELATIVE),
    ("tpl = 5", 1, _APPLY, f"rtrim({_APPLY}, '.')", "submit", "0.55", MODAL + OPTIONAL, "''", _NO,
     "true", "CASE WHEN cust % 5 = 0 THEN NULL ELSE due END"),
    ("tpl = 6", 1, _S["chain"], "concat('Collect the ', art1)", "obtain", "0.78",
     DIRECT + OPTIONAL, _cap("art1"), _NO, "true", _NO),
    ("tpl = 6", 2, _S["chain"], "'Sign the hostel undertaking'", "prepare", "0.741", COORDINATED,
     "'Hostel undertaking'", _NO, "true", _NO),
    ("tpl = 6", 3, _S["chain"], "'Deposit it'", "submit", "0.741", COORDINATED, "''", _NO, "true", _NO),
    ("tpl = 6", 4, _S["send"],
     f"concat('Send the ', art1, ' to the registrar before ', {N.long_date('due')})", "submit",
     "CASE WHEN month(due) = 5 THEN 0.55 ELSE 0.78 END", None, _cap("art1"), _NO, "true", "due"),
    ("tpl = 7", 1, _S["attach"],
     f"concat('Attach the fee challan by ', {N.long_date('due')})", "prepare", "0.94",
     MODAL + " Applies only if you hold a sports quota seat.", "'Fee challan'",
     "'if you hold a sports quota seat'", "false", "due"),
    ("tpl = 7", 2, _S["outside"], "'Return the equipment declaration'", "submit", "0.94",
     MODAL + " Applies only for holding a lab key.", "'Equipment declaration'",
     "'for holding a lab key'", "false", _NO),
    ("tpl = 7", 3, _S["sample"], "'Upload a sample portfolio'", "submit", "0.55", MODAL + OPTIONAL,
     "'Sample portfolio'", _NO, "true", _NO),
    ("tpl = 8", 1, _S["vague"],
     "'Submit the prescribed form to the concerned office before the last date'", "submit", "0.78",
     DIRECT + OPTIONAL, "'Prescribed form'", _NO, "true", _NO),
)


def _actions() -> str:
    arms = []
    effort = " ".join(f"WHEN '{v}' THEN {d}" for v, d in L.EFFORT_DAYS.items())
    for where, no, sentence, description, verb, conf, why, requires, only, optional, due in ACTIONS:
        arms.append(
            f"SELECT doc_id, {no} AS action_no, 'action-{no}' AS action_id, "
            f"CAST(strpos(text, {sentence}) - 1 AS INT) AS char_start, "
            f"CAST(strpos(text, {sentence}) - 1 + length({sentence}) AS INT) AS char_end, "
            f"{description} AS description, {_q(verb)} AS verb, CAST({conf} AS DOUBLE) AS confidence, "
            f"{_q(why) if why else MAY_NOTE} AS rationale, {requires} AS requires, {only} AS conditional_on, "
            f"{optional} AS optional, CAST({due} AS DATE) AS deadline, "
            f"CASE {_q(verb)} {effort} END AS effort_days, text_confidence, source_kind "
            f"FROM n WHERE {where}"
        )
    return " UNION ALL ".join(arms)


# (templates, phrase, rule)
GAPS = (
    ("tpl = 8", "'the concerned office'", 0),
    ("tpl = 8", "'the prescribed form'", 1),
    ("tpl = 8 AND variant <> 0", "'online portal'", 2),
    ("tpl = 11", "'as per norms'", 3),
    ("tpl = 8", "'shortly'", 5),
    ("tpl = 8", "'before the last date'", 6),
)


def _gaps() -> str:
    arms = []
    for where, phrase, rule in GAPS:
        _, question, why = L.GAP_RULES[rule]
        advice = next(
            (a for cues, a in L.GAP_ADVICE if any(c in question.lower() for c in cues)),
            L.GAP_DEFAULT_ADVICE,
        )
        arms.append(
            f"SELECT doc_id, {_q(question)} AS question, {_q(why)} AS why, {_q(advice)} AS "
            f"suggestion, CAST(strpos(text, {phrase}) - 1 AS INT) AS char_start, "
            f"CAST(strpos(text, {phrase}) - 1 + length({phrase}) AS INT) AS char_end, "
            f"{phrase} AS text, {rule} AS rule FROM n WHERE {where}"
        )
    return " UNION ALL ".join(arms)


_CGPA = "concat(CAST(cgpa AS STRING), half)"
# (pos, phrase, attribute, comparator, number, accepted with |, requirement)
CRITERIA = (
    (0, "'Open to SC/ST category'", "category", "one_of", _NO, "'SC|ST'", "'SC / ST category'"),
    (1, "'second year and above'", "year", "at_least", "2.0", _NO, "'year 2 or later'"),
    (2, "concat('minimum ', CAST(marks AS STRING), '%')", "score", "at_least", "marks", _NO,
     "concat('at least ', CAST(marks AS STRING), '% aggregate')"),
    (3, f"concat('CGPA of ', {_CGPA})", "cgpa", "at_least",
     "cgpa + CASE WHEN half = '' THEN 0.0 ELSE 0.5 END", _NO,
     f"concat('CGPA of at least ', {_CGPA})"),
    (4, "concat('at least ', CAST(age AS STRING), ' years')", "age", "at_least", "age", _NO,
     "concat('at least ', CAST(age AS STRING), ' years of age')"),
    (5, "concat('residents of ', place)", "domicile", "one_of", _NO, "place",
     "concat('domiciled in ', place)"),
    (6, "'B.Tech'", "programme", "one_of", _NO, "'B.Tech'", "'B.Tech students'"),
)


def _criteria() -> str:
    arms = []
    for pos, phrase, attribute, comparator, number, accepted, requirement in CRITERIA:
        arms.append(
            f"SELECT doc_id, cust, {pos} AS pos, "
            f"CAST(strpos(text, {phrase}) - 1 AS INT) AS char_start, "
            f"CAST(strpos(text, {phrase}) - 1 + length({phrase}) AS INT) AS char_end, "
            f"{phrase} AS text, '{attribute}' AS attribute, '{comparator}' AS comparator, "
            f"CAST({number} AS DOUBLE) AS num_value, {accepted} AS accepted, "
            f"{requirement} AS requirement, text_confidence, source_kind FROM n WHERE tpl = 9"
        )
    return " UNION ALL ".join(arms)


TYPES = (
    "CASE WHEN tpl <= 9 THEN 'notice' WHEN tpl = 11 THEN 'job_description' "
    "WHEN variant = 0 THEN 'other' WHEN variant = 1 THEN 'form' ELSE 'policy' END"
)
_FIRST_SIGNAL = {
    "tpl = 0": "'NOTICE'", "tpl IN (1, 4)": "'CIRCULAR'", "tpl = 2": "'Notice'",
    "tpl IN (3, 5, 8, 9)": "'NOTICE'", "tpl IN (6, 7)": "'CIRCULAR'", "tpl = 11":
    "'responsibilities'", "tpl = 10 AND variant = 1": "'______'",
    "tpl = 10 AND variant = 2": "'policy'",
}
HEADING = (
    "CASE tpl WHEN 0 THEN concat('NOTICE NO. ', CAST(doc_id AS STRING)) WHEN 1 THEN 'CIRCULAR' "
    "WHEN 2 THEN 'Notice to applicants' WHEN 3 THEN 'EXAMINATION NOTICE' WHEN 4 THEN 'CIRCULAR' "
    "WHEN 5 THEN 'ADMISSION NOTICE' WHEN 6 THEN 'PLACEMENT CIRCULAR' "
    "WHEN 7 THEN 'APPLICATION CIRCULAR' WHEN 8 THEN 'REGISTRATION NOTICE' "
    "WHEN 9 THEN 'SCHOLARSHIP NOTICE' WHEN 11 THEN 'Job description: backend engineer' "
    "ELSE CASE variant WHEN 0 THEN 'History of the hall' WHEN 1 THEN 'APPLICATION FORM' "
    "ELSE 'Leave policy' END END"
)


def _types() -> str:
    return (
        f"SELECT doc_id, type, CASE WHEN type = 'other' THEN 0.3 ELSE 0.9 END AS confidence, "
        "CASE WHEN type = 'other' THEN 'No strong signal for any known document type.' ELSE "
        "concat('Clear ', replace(type, '_', ' '), ' language, with no close alternative.') END AS "
        f"rationale, text_confidence, source_kind, text FROM (SELECT *, {TYPES} AS type FROM n)"
    )


OCR_NOTE = (
    "CASE WHEN source_kind = 'image' THEN ' Read by OCR at 61% character confidence, which caps "
    "how far this can be trusted.' ELSE '' END"
)


def classed(score: str) -> str:
    return f"CASE WHEN {score} >= 0.85 THEN 'FACT' WHEN {score} >= 0.6 THEN 'INFERENCE' ELSE " \
           "'UNCERTAIN' END"


#: Only 29 February resolves to a day that its words do not state: without a year it falls back to the 28th.
_UNSTATED = "(tpl = 1 AND month(due) = 2 AND day(due) = 29 AND day(d.resolved) = 28)"
_CLAIMS = f"""
SELECT d.doc_id, d.resolved AS value, CASE WHEN {_UNSTATED} THEN 'UNCERTAIN'
       WHEN d.kind = 'relative' AND least(d.confidence, n.text_confidence) >= 0.85
       THEN 'INFERENCE' ELSE {classed('least(d.confidence, n.text_confidence)')} END AS classification,
  CASE WHEN {_UNSTATED} THEN 0.35 ELSE least(d.confidence, n.text_confidence) END AS score,
  CASE WHEN {_UNSTATED} THEN {_q(UNSTATED)} ELSE concat(d.rationale, CASE WHEN alternate IS NULL THEN '' ELSE
    concat(' Alternate reading: ', CAST(alternate AS STRING), '.') END, {OCR_NOTE}) END AS rationale,
  d.char_start, d.char_end, d.text AS evidence
FROM dates d JOIN n USING (doc_id) WHERE d.is_deadline"""

_PRIMARY = """
SELECT doc_id, coalesce(min(value) FILTER (WHERE classification <> 'UNCERTAIN'), min(value)) AS due
FROM claims GROUP BY doc_id"""

#: The only dependency in the notices: sending an artefact needs the step that obtains it.
_SCHEDULE = f"""
SELECT a.*, round(least(a.confidence, a.text_confidence), 4) AS score,
  {classed('round(least(a.confidence, a.text_confidence), 4)')} AS classification,
  CASE WHEN tpl6 AND action_no = 1 THEN due_send - 1 ELSE deadline END AS effective_deadline,
  CASE WHEN tpl6 AND action_no = 1 THEN due_send - 1 ELSE deadline END - effort_days AS latest_start,
  CASE WHEN tpl6 AND action_no = 4 THEN 'action-1' ELSE '' END AS depends_on,
  CASE WHEN tpl6 AND action_no = 4 THEN 1 ELSE 0 END AS depth
FROM (SELECT acts.*, max(action_no) OVER (PARTITION BY doc_id) = 4 AS tpl6,
        max(deadline) OVER (PARTITION BY doc_id) AS due_send FROM acts) a"""


def with_expected(body: str) -> str:
    """A statement over the expected tables, as one self-contained query."""
    tables = {
        "n": N.notices_sql(), "n2": N.notices_sql(N.REISSUED), "dates": _dates(),
        "acts": _actions(), "gaps": _gaps(), "crit": _criteria(), "types": _types(),
        "claims": _CLAIMS, "prim": _PRIMARY, "sched": _SCHEDULE,
    }
    ctes = ", ".join(f"{name} AS ({sql})" for name, sql in tables.items())
    return f"WITH {ctes} {body}"
