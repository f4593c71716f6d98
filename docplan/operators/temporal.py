"""Dates, periods and deadlines stated in a document."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.claims import cap_score, classify_confidence, ocr_note
from docplan.functions.rows import table_of

TEMPORAL_TYPE = (
    "struct<char_start:int,char_end:int,text:string,kind:string,resolved:date,window_end:date,"
    "confidence:double,rationale:string,is_deadline:boolean,alternate:date,scan:int>"
)
TEMPORAL_FIELDS = [f.split(":")[0] for f in TEMPORAL_TYPE[len("struct<"):-1].split(",")]
NULL_DATE = "cast(NULL as date)"


def make_date(year: str, month: str, day: str) -> str:
    """The calendar date, or null when there is none."""
    spelled = f"concat(lpad(cast({year} as string), 4, '0'), '-', {month}, '-', {day})"
    return f"if({year} > 0, try_cast({spelled} as date), NULL)"


def month_number(name: str) -> str:
    starts = "".join(m[:3] for m in L.MONTHS)
    return f"cast((instr('{starts}', lower(left({name}, 3))) + 2) / 3 as int)"


def month_name(month: str) -> str:
    return f"element_at({S.words([m.capitalize() for m in L.MONTHS])}, {month})"


def next_occurrence(month: str, day: str, reference: str) -> str:
    """The first such day on or after ``reference``; 29 February falls back to the 28th."""
    year = f"year({reference})"
    after = f"coalesce({make_date(f'({year} + 1)', month, day)}, " \
            f"{make_date(f'({year} + 1)', month, '28')})"
    return S.let(
        make_date(year, month, day),
        lambda this: S.when(
            (f"{this} IS NULL", make_date(f"({year} + 1)", month, f"least({day}, 28)")),
            (f"{this} >= {reference}", this),
            otherwise=after,
        ),
    )


def add_working_days(start: str, count: str) -> str:
    """Skip Saturdays and Sundays. Closed form, so no day is ever generated."""
    weekday = f"weekday({start})"
    base = f"date_sub({start}, greatest({weekday} - 4, 0))"
    weeks = f"cast(floor((least({weekday}, 4) + {count}) / 5) as int)"
    return f"if({count} <= 0, {start}, date_add({base}, {count} + 2 * {weeks}))"


CUED_CLAUSES = "struct<starts:array<int>,first_end:array<int>,last_start:array<int>,char_end:array<int>>"


def cued_clauses(text: str) -> str:
    """The clauses that hold a deadline cue, in order: start, end of the first cue, start of the last, end.

    Found in one pass over the text, so that a date looks up its clause instead of cutting the text again.
    """

    def cued(clause: str) -> str:
        return S.let(S.find_all(f"{clause}.text", L.DEADLINE_CUE), lambda cues: S.struct(
            start=f"{clause}.char_start",
            first_end=f"{clause}.char_start + {cues}[0].char_end",
            last_start=f"{clause}.char_start + element_at({cues}, -1).char_start",
            char_end=f"{clause}.char_end",
        ))

    def columns(clauses: str) -> str:
        return S.struct(
            starts=f"{clauses}.start", first_end=f"{clauses}.first_end",
            last_start=f"{clauses}.last_start", char_end=f"{clauses}.char_end")

    def found(clauses: str) -> str:
        return S.transform(S.keep(clauses, lambda c: S.has(f"{c}.text", L.DEADLINE_CUE)), cued)

    clauses = S.spans_of(S.mark(text, L.CLAUSE_BREAK), which=0)
    return S.when(
        (S.has(text, L.DEADLINE_CUE), S.let(found(clauses), columns)), otherwise=f"cast(NULL as {CUED_CLAUSES})")


def deadline_cue(clauses: str, position: str) -> str:
    """Whether the clause around ``position`` frames the date as a cutoff, before or after that place."""

    def framed(i: str) -> str:
        return (
            f"coalesce(get({clauses}.char_end, {i}) >= {position} AND "
            f"(get({clauses}.first_end, {i}) <= {position} OR get({clauses}.last_start, {i}) >= {position}), false)"
        )

    return S.when(
        (f"{clauses} IS NULL", "false"),
        otherwise=S.let(S.last_begun(f"{clauses}.starts", position), framed))


def _expression(m: str, **fields: str) -> str:
    values = {
        "kind": "'absolute'", "resolved": NULL_DATE, "window_end": NULL_DATE,
        "confidence": "0D", "rationale": "''", "is_deadline": "false",
        "alternate": NULL_DATE, "scan": "0", **fields,
    }
    return S.struct(
        char_start=f"{m}.char_start", char_end=f"{m}.char_end", text=f"{m}.text", **values
    )


def _scan(text: str, pattern: str, build) -> str:
    found = S.transform(S.find_all(text, pattern), build)
    return S.keep(found, lambda e: f"{e}.resolved IS NOT NULL")


def _named_parts(fragment: str, pattern: str, day_first: bool) -> list[str]:
    day_group, month_group = (1, 2) if day_first else (2, 1)
    return [
        f"try_cast({S.group(fragment, pattern, day_group)} as int)",
        month_number(S.group(fragment, pattern, month_group)),
        S.group(fragment, pattern, 3),
    ]


def _named_value(day: str, month: str, year: str, reference: str) -> str:
    longest = f"element_at({S.array(map(str, L.DAYS_IN_MONTH))}, {month})"
    dated = (
        f"if({year} = '', {next_occurrence(month, day, reference)}, "
        f"{make_date(f'try_cast({year} as int)', month, day)})"
    )
    return f"if({day} >= 1 AND {day} <= {longest}, {dated}, NULL)"


def named_dates(text: str, reference: str, day_first: bool) -> str:
    """``18 September 2026`` or ``September 18, 2026``, with or without the year."""
    pattern = L.DAY_MONTH if day_first else L.MONTH_DAY

    def build(m: str) -> str:
        def with_parts(day: str, month: str, year: str) -> str:
            undated = (
                f"concat('No year is stated; resolved to the next ', {month_name(month)}, ' ', "
                f"{day}, ' on or after ', {reference}, '.')"
            )
            return _expression(
                m,
                resolved=_named_value(day, month, year, reference),
                confidence=f"if({year} = '', 0.72D, 0.97D)",
                rationale=f"if({year} = '', {undated}, "
                "'Day, month and year are all stated explicitly.')",
                scan="1" if day_first else "2",
            )

        return S.let_all(_named_parts(f"{m}.text", pattern, day_first), with_parts)

    return _scan(text, pattern, build)


def _numeric_parts(fragment: str) -> list[str]:
    def part(index: int) -> str:
        return f"try_cast({S.group(fragment, L.NUMERIC_DATE, index)} as int)"

    return [part(1), part(2), S.let(part(3), lambda y: f"if({y} < 100, {y} + 2000, {y})")]


def numeric_dates(text: str) -> str:
    """``18/09/2026``; two valid readings make the date ambiguous, none drops it."""

    def build(m: str) -> str:
        def decide(day_first: str, month_first: str) -> str:
            ambiguous = f"coalesce({day_first} != {month_first}, false)"
            both = (
                f"concat('Numeric date is ambiguous: reads as ', {day_first}, ' (day/month) or ', "
                f"{month_first}, ' (month/day). Confirm before relying on it.')"
            )
            return _expression(
                m,
                resolved=f"coalesce({day_first}, {month_first})",
                confidence=f"if({ambiguous}, 0.45D, 0.88D)",
                rationale=f"if({ambiguous}, {both}, "
                "'Numeric date; only one field ordering yields a valid calendar date.')",
                alternate=f"if({ambiguous}, {month_first}, NULL)",
                scan="3",
            )

        def readings(first: str, second: str, year: str) -> str:
            return S.let_all(
                [make_date(year, second, first), make_date(year, first, second)], decide
            )

        return S.let_all(_numeric_parts(f"{m}.text"), readings)

    return _scan(text, L.NUMERIC_DATE, build)


def relative_dates(text: str, reference: str) -> str:
    """``within seven working days``, counted from ``reference``; always a deadline."""
    table = ", ".join(f"'{w}', {n}" for w, n in L.NUMBER_WORDS.items())

    def build(m: str) -> str:
        raw = f"lower({S.group(f'{m}.text', L.RELATIVE_DATE, 1)})"
        count = f"coalesce(try_cast({raw} as int), try_element_at(map({table}), {raw}))"
        unit = S.replace(f"lower({S.group(f'{m}.text', L.RELATIVE_DATE, 2)})", r"(?U)\s+", " ")

        def resolve(n: str, u: str) -> str:
            note = (
                f"CASE {u} WHEN 'day' THEN 'calendar days' "
                f"WHEN 'working day' THEN 'working days, excluding weekends' "
                f"ELSE concat({u}, 's') END"
            )
            return _expression(
                m,
                kind="'relative'",
                resolved=S.when(
                    (f"{u} = 'week'", f"date_add({reference}, {n} * 7)"),
                    (f"{u} = 'day'", f"date_add({reference}, {n})"),
                    (f"{u} = 'month'", f"add_months({reference}, {n})"),
                    otherwise=add_working_days(reference, n),
                ),
                confidence="0.55D",
                rationale=f"concat('Relative period of ', {n}, ' ', {note}, ', counted from ', "
                f"{reference}, '. The document does not state the date the period starts from, "
                "so this depends on when it was received.')",
                is_deadline="true",
                scan="4",
            )

        return S.let_all([count, unit], resolve)

    return _scan(text, L.RELATIVE_DATE, build)


def first_absolute(fragment: str, reference: str) -> str:
    """The first date in a short fragment: day-month, then month-day, then numeric."""

    def named(day_first: bool) -> str:
        pattern = L.DAY_MONTH if day_first else L.MONTH_DAY
        value = S.let_all(
            _named_parts(fragment, pattern, day_first),
            lambda d, m, y: _named_value(d, m, y, reference),
        )
        return S.when((S.has(fragment, pattern), value))

    numeric = S.let_all(
        _numeric_parts(fragment), lambda first, second, year: make_date(year, second, first)
    )
    return (
        f"coalesce({named(True)}, {named(False)}, "
        f"{S.when((S.has(fragment, L.NUMERIC_DATE), numeric))})"
    )


def date_windows(text: str, reference: str) -> str:
    """``from 1 September to 20 September``; both ends must resolve, in order."""

    def build(m: str) -> str:
        ends = [
            S.let(S.group(f"{m}.text", L.DATE_WINDOW_PARTS, g), lambda f: first_absolute(f, reference))
            for g in (1, 2)
        ]
        return S.let_all(
            ends,
            lambda a, b: _expression(
                m,
                kind="'window'",
                resolved=f"if({b} >= {a}, {a}, NULL)",
                window_end=b,
                confidence="0.9D",
                rationale="'Both ends of the period are stated.'",
            ),
        )

    return _scan(text, L.DATE_WINDOW, build)


def drop_covered(found: str) -> str:
    """Keep the widest expression where one span contains another."""

    def order(a: str, b: str) -> str:
        def key(e: str) -> str:
            return f"struct({e}.char_start, -{e}.char_end, {e}.scan)"

        return f"CASE WHEN {key(a)} < {key(b)} THEN -1 WHEN {key(a)} > {key(b)} THEN 1 ELSE 0 END"

    several = lambda xs: S.ordered_fold(
        f"array_sort({xs}, {S.lam(order, 2)})",
        "-1",
        lambda furthest, e: (
            f"greatest({furthest}, {e}.char_end)",
            f"if({e}.char_end > {furthest}, array({e}), {S.empty(TEMPORAL_TYPE)})",
        ),
        TEMPORAL_TYPE,
    )
    return S.let(found, lambda xs: f"if(size({xs}) > 1, {several(xs)}, {xs})")


def temporal_expressions(text: str, reference: str) -> str:
    """Every temporal expression, in document order; absolute dates not yet judged as cutoffs."""
    found = ", ".join([
        date_windows(text, reference),
        named_dates(text, reference, day_first=True),
        named_dates(text, reference, day_first=False),
        numeric_dates(text),
        relative_dates(text, reference),
    ])

    needed = r"(?iU)\d|\b(?:" + "|".join(L.NUMBER_WORDS) + r")\b"
    return S.when(
        (S.has(text, needed), drop_covered(f"concat({found})")), otherwise=S.empty(TEMPORAL_TYPE)
    )


def with_cutoffs(found: str, clauses: str) -> str:
    """Marks the absolute dates that a clause frames as a cutoff."""

    def flag(e: str) -> str:
        fields = {f: f"{e}.{f}" for f in TEMPORAL_FIELDS}
        cue = deadline_cue(clauses, f"{e}.char_start")
        return S.struct(**{**fields, "is_deadline": f"if({e}.kind = 'absolute', {cue}, {e}.is_deadline)"})

    return S.transform(found, flag)


def issue_date(text: str, fallback: str, head_chars: int | None = None) -> str:
    """The first date the document gives itself (in its first ``head_chars``, if limited), or ``fallback``."""
    opening = f"left({text}, {head_chars})" if head_chars else text

    def read(part: str) -> str:
        found = ", ".join([
            named_dates(part, fallback, True), named_dates(part, fallback, False),
            numeric_dates(part),
        ])
        first = f"try_element_at({drop_covered(f'concat({found})')}, 1).resolved"
        return S.when((f"{part} != ''", first))

    return f"coalesce({S.let(S.group(opening, L.ISSUE_DATE, 1), read)}, {fallback})"


UNSTATED = (
    "The sentence cited for this date does not appear to state it, so the date is reported as "
    "unconfirmed rather than as a fact."
)
CLAIM_TYPE = (
    "struct<value:date,classification:string,score:double,rationale:string,char_start:int,"
    "char_end:int,evidence:string>"
)


def states_date(value: str, text: str) -> str:
    """Whether a span spells out the day and the month of a date."""
    low = f"lower({text})"

    def number(part: str) -> str:
        return f"regexp_like({low}, concat({S.lit('(?U)\\b0?')}, {part}, {S.lit('\\b')}))"

    short = f"lower(left({month_name(f'month({value})')}, 3))"
    return f"({number(f'day({value})')} AND (contains({low}, {short}) OR " \
           f"{number(f'month({value})')}))"


def deadline_claims(temporal: str, text_confidence: str, source_kind: str) -> str:
    """Resolved cutoffs as claims: capped by the text, demoted where the span does not state it."""
    cutoffs = S.keep(temporal, lambda e: f"{e}.is_deadline AND {e}.resolved IS NOT NULL")

    def claim(e: str) -> str:
        def build(score: str, stated: str) -> str:
            cls = classify_confidence(score)
            cls = f"if({e}.kind = 'relative' AND {score} >= {S.lit(L.FACT_AT)}, 'INFERENCE', {cls})"
            alternate = f"coalesce(concat(' Alternate reading: ', {e}.alternate, '.'), '')"
            note = ocr_note(source_kind, text_confidence)
            return S.struct(
                value=f"{e}.resolved",
                classification=f"if({stated}, {cls}, 'UNCERTAIN')",
                score=f"if({stated}, {score}, least({score}, {S.lit(L.REPORTABLE_AT)}))",
                rationale=f"if({stated}, concat({e}.rationale, {alternate}, {note}), "
                f"{S.lit(UNSTATED)})",
                char_start=f"{e}.char_start",
                char_end=f"{e}.char_end",
                evidence=f"{e}.text",
            )

        stated = f"({e}.kind != 'absolute' OR {states_date(f'{e}.resolved', f'{e}.text')})"
        return S.let_all([cap_score(f"{e}.confidence", text_confidence), stated], build)

    return S.transform(cutoffs, claim)


def primary_deadline(claims: str) -> str:
    """The earliest claim that is not UNCERTAIN, else the earliest of all."""

    def earliest(xs: str) -> str:
        pick = S.lam(
            lambda best, c: f"if({best} IS NULL OR {c}.value < {best}.value, {c}, {best})", 2
        )
        return f"aggregate({xs}, cast(NULL as {CLAIM_TYPE}), {pick})"

    return S.let(
        claims,
        lambda cs: "coalesce("
        + earliest(S.keep(cs, lambda c: f"{c}.classification != 'UNCERTAIN'"))
        + f", {earliest(cs)})",
    )


# --- table operators --------------------------------------------------------


def with_temporal(docs: DataFrame, today: str) -> DataFrame:
    """Adds ``issued`` and ``temporal``: relative periods count from the document's own date."""
    return (
        docs.selectExpr("*", f"{S.let('text', lambda t: issue_date(t, today))} as issued")
        .selectExpr("*", f"{temporal_expressions('text', 'issued')} as _found")
        .selectExpr("*", f"if(size(_found) > 0, {cued_clauses('text')}, NULL) as _clauses")
        .selectExpr("*", f"{with_cutoffs('_found', '_clauses')} as temporal")
        .drop("_found", "_clauses")
    )


def extract_temporal(docs: DataFrame, today: str) -> DataFrame:
    """One row per temporal expression. ``today`` is the SQL text of a date."""
    return table_of(with_temporal(docs.select("doc_id", "text"), today), "temporal", "doc_id").drop("scan")
