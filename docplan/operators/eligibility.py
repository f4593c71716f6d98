"""Who a document is for: conditions it states, checked against profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.claims import cap_score, classify_confidence, never_fact, ocr_note
from docplan.functions.rows import table_of

CRITERION_TYPE = (
    "struct<char_start:int,char_end:int,text:string,attribute:string,comparator:string,"
    "num_value:double,accepted:array<string>,requirement:string>"
)
NO_LIST, NO_NUMBER = "cast(NULL as array<string>)", "cast(NULL as double)"
ARITHMETIC = ("year", "score", "cgpa", "age")


def _criterion(m: str, attribute: str, comparator: str, number: str, accepted: str, req: str) -> str:
    return S.struct(
        char_start=f"{m}.char_start", char_end=f"{m}.char_end", text=f"{m}.text",
        attribute=f"'{attribute}'", comparator=comparator, num_value=number, accepted=accepted,
        requirement=req,
    )


def show_number(value: str) -> str:
    """A whole number without its decimals."""
    return (
        f"if({value} = floor({value}), cast(cast({value} as bigint) as string), "
        f"cast({value} as string))"
    )


def year_criteria(text: str) -> str:
    table = ", ".join(f"'{w}', {n}" for w, n in L.ORDINALS.items())

    def build(m: str) -> str:
        word = f"lower({S.group(f'{m}.text', L.YEAR_CRITERION, 1)})"

        def read(number: str, floor: str) -> str:
            return _criterion(
                m, "year",
                f"CASE WHEN {number} IS NULL THEN 'not_comparable' WHEN {floor} THEN 'at_least' "
                "ELSE 'equals' END",
                f"cast({number} as double)", NO_LIST,
                f"CASE WHEN {number} IS NULL THEN 'final-year students' "
                f"WHEN {floor} THEN concat('year ', {number}, ' or later') "
                f"ELSE concat({S.strip(f'{m}.text')}, ' students') END",
            )

        return S.let_all(
            [f"try_element_at(map({table}), {word})",
             f"{S.group(f'{m}.text', L.YEAR_CRITERION, 2)} != ''"], read
        )

    return S.transform(S.find_all(text, L.YEAR_CRITERION), build)


def score_criteria(text: str) -> str:
    def wording(n: str) -> str:
        return f"concat('at least ', {show_number(n)}, '% aggregate')"

    parts = [
        _bounded(text, p, "score", "at_least", 0, 100, wording)
        for p in (L.SCORE_MINIMUM, L.SCORE_FLOOR)
    ]
    cgpa = _bounded(
        text, L.CGPA_MINIMUM, "cgpa", "at_least", 0, 10,
        lambda n: f"concat('CGPA of at least ', {show_number(n)})",
    )
    return f"concat({', '.join(parts)}, {cgpa})"


def _bounded(text: str, pattern: str, attribute: str, comparator: str, low, high, wording) -> str:
    """Numbers in (low, high].

    Group extraction sees the match only, so it uses the pattern without its
    look-ahead.
    """
    bare = pattern.replace(L.NOT_A_DURATION, "")

    def build(m: str) -> str:
        return S.let(
            f"cast({S.group(f'{m}.text', bare, 1)} as double)",
            lambda n: _criterion(m, attribute, f"'{comparator}'", n, NO_LIST, wording(n)),
        )

    found = S.transform(S.find_all(text, pattern), build)
    return S.keep(found, lambda c: f"{c}.num_value > {low} AND {c}.num_value <= {high}")


def age_criteria(text: str) -> str:
    parts = [
        _bounded(
            text, pattern, "age", comparator, 13, 99,
            lambda n, w=wording: f"concat('{w} ', cast({n} as int), ' years of age')",
        )
        for pattern, comparator, wording in (
            (L.AGE_MINIMUM, "at_least", "at least"), (L.AGE_MAXIMUM, "at_most", "under"),
        )
    ]
    return f"concat({', '.join(parts)})"


def category_criteria(text: str) -> str:
    def of(pattern: str) -> str:
        def build(m: str) -> str:
            listed = S.group(f"{m}.text", pattern, 1)
            tokens = f"regexp_extract_all({listed}, {S.lit(L.CATEGORY_TOKEN)}, 1)"
            return S.let(
                S.transform(tokens, lambda t: f"upper({t})"),
                lambda ts: _criterion(
                    m, "category", "'one_of'", NO_NUMBER, ts,
                    f"concat(array_join({ts}, ' / '), ' category')",
                ),
            )

        return S.transform(S.find_all(text, pattern), build)

    return f"concat({of(L.CATEGORY_LIST)}, {of(L.CATEGORY_PHRASE)})"


def _in_eligibility_sentences(text: str, found: str) -> str:
    """Those of some matches whose sentence speaks of eligibility.

    Such sentences are found once, in order; every match looks its own up by its start.
    """
    marked = S.keep(S.find_all(text, r"[^.\n]*[.\n]|[^.\n]+"), lambda s: S.has(f"{s}.text", L.ELIGIBILITY_MARKER))

    def inside(m: str, starts: str, ends: str) -> str:
        return f"coalesce(get({ends}, {S.last_begun(starts, f'{m}.char_start')}) > {m}.char_start, false)"

    def kept(ms: str, bounds: str) -> str:
        return S.keep(ms, lambda m: inside(m, f"{bounds}.starts", f"{bounds}.ends"))

    bounds = S.let(marked, lambda s: S.struct(starts=f"{s}.char_start", ends=f"{s}.char_end"))
    return S.let_all([found, bounds], kept)


def domicile_programme_criteria(text: str) -> str:
    def of(pattern: str, attribute: str, wording, matches: str | None = None) -> str:
        def build(m: str) -> str:
            return S.let(
                S.flat(S.group(f"{m}.text", pattern, 1))
                if matches
                else S.strip(S.group(f"{m}.text", pattern, 1)),
                lambda name: _criterion(
                    m, attribute, "'one_of'", NO_NUMBER, f"array({name})", wording(name)
                ),
            )

        return S.transform(matches or S.find_all(text, pattern), build)

    degrees = S.when(
        (f"{S.has(text, L.PROGRAMME_DEGREE)} AND {S.has(text, L.ELIGIBILITY_MARKER)}",
         _in_eligibility_sentences(text, S.find_all(text, L.PROGRAMME_DEGREE))),
        otherwise=S.empty(S.SPAN_TYPE),
    )
    students = lambda n: f"concat({n}, ' students')"
    return "concat(" + ", ".join([
        of(L.DOMICILE, "domicile", lambda n: f"concat('domiciled in ', {n})"),
        of(L.PROGRAMME_OF, "programme", students),
        of(L.PROGRAMME_DEGREE, "programme", students, degrees),
    ]) + ")"


def drop_overlapping(found: str) -> str:
    """Within one attribute keep the first of any overlapping criteria.

    Kept spans of an attribute are disjoint and in order, so the end of the
    last one decides; the state is one such end per attribute.
    """
    slots = list(L.ATTRIBUTE_LABELS)

    def order(a: str, b: str) -> str:
        def key(c: str) -> str:
            return f"struct({c}.char_start, -{c}.char_end)"

        return f"CASE WHEN {key(a)} < {key(b)} THEN -1 WHEN {key(a)} > {key(b)} THEN 1 ELSE 0 END"

    def step(state: str, c: str) -> tuple[str, str]:
        ends = S.struct(**{
            a: f"if({c}.attribute = '{a}' AND {c}.char_start >= {state}.{a}, {c}.char_end, "
            f"{state}.{a})"
            for a in slots
        })
        mine = "CASE " + " ".join(
            f"WHEN {c}.attribute = '{a}' THEN {state}.{a}" for a in slots
        ) + " END"
        return ends, f"if({c}.char_start >= {mine}, array({c}), {S.empty(CRITERION_TYPE)})"

    return S.ordered_fold(
        f"array_sort({found}, {S.lam(order, 2)})",
        S.struct(**{a: "0" for a in slots}),
        step,
        CRITERION_TYPE,
    )


def with_criteria(docs: DataFrame, column: str = "criteria") -> DataFrame:
    """Adds every stated condition, in document order."""
    every = ", ".join(
        f(text="text")
        for f in (
            year_criteria, score_criteria, age_criteria, category_criteria,
            domicile_programme_criteria,
        )
    )
    return docs.selectExpr("*", f"concat({every}) as _found").selectExpr(
        *docs.columns, f"{drop_overlapping('_found')} as {column}"
    )


def extract_criteria(docs: DataFrame) -> DataFrame:
    return table_of(with_criteria(docs), "criteria", "doc_id", position="pos")


# --- checking ---------------------------------------------------------------


def _tokens(text: str) -> str:
    found = f"regexp_extract_all(lower({text}), '([a-z0-9]+)', 1)"
    return f"array_except({found}, {S.words(L.PROFILE_STOPWORDS)})"


def check(c: str, p: str) -> str:
    """One criterion against one profile struct: match, stated value, explanation."""
    value = "CASE " + " ".join(
        f"WHEN {c}.attribute = '{a}' THEN "
        + (show_number(f"cast({p}.{a} as double)") if a in ARITHMETIC else f"{p}.{a}")
        for a in L.ATTRIBUTE_LABELS
    ) + " END"
    number = "CASE " + " ".join(
        f"WHEN {c}.attribute = '{a}' THEN cast({p}.{a} as double)" for a in ARITHMETIC
    ) + " END"
    said = "CASE " + " ".join(
        f"WHEN {c}.attribute = '{a}' THEN concat({S.lit(a0)}, VALUE, {S.lit(a1)})"
        for a, (a0, a1) in L.ATTRIBUTE_STATEMENTS.items()
    ) + " END"
    labels = "CASE " + " ".join(
        f"WHEN {c}.attribute = '{a}' THEN '{v}'" for a, v in L.ATTRIBUTE_LABELS.items()
    ) + " END"

    def decide(stated: str, num: str) -> str:
        mine = _tokens(stated)

        def text_match(own: str) -> str:
            def accepts(a: str) -> str:
                return S.let(
                    _tokens(a),
                    lambda t: f"size({t}) > 0 AND (size(array_except({t}, {own})) = 0 "
                    f"OR size(array_except({own}, {t})) = 0)",
                )

            return S.any_of(f"{c}.accepted", accepts)

        arithmetic = S.when(
            (f"{c}.comparator = 'at_least'", f"{num} >= {c}.num_value"),
            (f"{c}.comparator = 'at_most'", f"{num} <= {c}.num_value"),
            otherwise=f"{num} = {c}.num_value",
        )
        held = f"if({c}.num_value IS NOT NULL, {arithmetic}, {S.let(mine, text_match)})"
        speech = said.replace("VALUE", stated)

        def outcome(match: str, shown: str, why: str) -> str:
            return S.struct(match=f"'{match}'", profile_value=shown, explanation=why)

        none = "cast(NULL as string)"
        return S.when(
            (
                f"{c}.comparator = 'not_comparable'",
                outcome("unknown", none,
                        f"concat('The document restricts this to ', {c}.requirement, ', which "
                        "depends on how long your programme runs. Only you can settle that.')"),
            ),
            (
                f"{stated} IS NULL",
                outcome("unknown", none,
                        f"concat('The document requires ', {c}.requirement, '; your profile does "
                        f"not state your ', {labels}, '.')"),
            ),
            (
                held,
                outcome("matches", stated,
                        f"concat({speech}, ' That meets the requirement of ', {c}.requirement, "
                        "'.')"),
            ),
            (
                f"{c}.num_value IS NOT NULL",
                outcome("conflicts", stated,
                        f"concat({speech}, ' This asks for ', {c}.requirement, '.')"),
            ),
            (
                f"{c}.attribute = 'category'",
                outcome("conflicts", stated,
                        f"concat({speech}, ' This is limited to ', {c}.requirement, '.')"),
            ),
            otherwise=outcome(
                "unknown", stated,
                f"concat({speech}, ' The document says ', {c}.requirement, '. Those do not "
                "obviously match, and abbreviations are not expanded here — worth settling "
                "yourself rather than trusting either reading.')"),
        )

    return S.let_all([value, number], decide)


def with_findings(docs: DataFrame, column: str = "findings") -> DataFrame:
    """Checks ``criteria`` against the ``profile`` struct of the same row."""
    both = S.let(
        "profile",
        lambda p: S.transform(
            "criteria",
            lambda c: S.let(
                check(c, p),
                lambda f: S.struct(
                    attribute=f"{c}.attribute", requirement=f"{c}.requirement",
                    char_start=f"{c}.char_start", char_end=f"{c}.char_end", text=f"{c}.text",
                    match=f"{f}.match", profile_value=f"{f}.profile_value",
                    explanation=f"{f}.explanation",
                ),
            ),
        ),
    )
    return docs.selectExpr("*", f"{both} as {column}")


def _listed(findings: str) -> str:
    """``a``, ``a and b``, ``a, b and c``."""

    def join(xs: str) -> str:
        head = f"array_join(slice({xs}, 1, greatest(size({xs}) - 1, 0)), ', ')"
        return f"if(size({xs}) = 1, {xs}[0], concat({head}, ' and ', try_element_at({xs}, -1)))"

    return S.let(S.transform(findings, lambda f: f"{f}.requirement"), join)


def _plural(n: str) -> str:
    return f"concat({n}, if({n} = 1, ' condition', ' conditions'))"


def assess(findings: str) -> str:
    """Verdict, confidence and rationale over all findings of one document."""

    def of(match: str, xs: str) -> str:
        return S.keep(xs, lambda f: f"{f}.match = '{match}'")

    def decide(xs: str, bad: str, good: str, open_: str) -> str:
        def outcome(verdict: str, confidence: str, why: str) -> str:
            return S.struct(verdict=f"'{verdict}'", confidence=confidence, rationale=why)

        n, b, g, u = (f"size({v})" for v in (xs, bad, good, open_))
        return S.when(
            (
                f"{n} = 0",
                outcome("not_restricted", "0.6D",
                        "'No eligibility condition was recognised anywhere in this document. It "
                        "does not say who it is for, so it may well apply to you — but an "
                        "unstated restriction is exactly what cannot be checked.'"),
            ),
            (
                f"{b} > 0",
                outcome("does_not_apply", "0.85D",
                        f"concat({_plural(b)}, ' of ', {n}, ' did not hold: ', {_listed(bad)}, "
                        "'. The plan is still shown in full, because conditions are read off the "
                        "wording and wording can be read wrong.')"),
            ),
            (
                f"{g} > 0 AND {u} = 0",
                outcome("applies", "0.88D",
                        f"concat('All ', {_plural(g)}, ' stated in the document were checked "
                        "against your profile and every one held.')"),
            ),
            (
                f"{g} > 0",
                outcome("applies", f"round(0.5D + 0.35D * ({g} / cast({n} as double)), 2)",
                        f"concat({_plural(g)}, ' held; ', {u}, ' could not be checked (', "
                        f"{_listed(open_)}, '). Confirm the rest yourself before relying on "
                        "this.')"),
            ),
            otherwise=outcome(
                "undetermined", "0.4D",
                f"concat('This document restricts itself to ', {_listed(xs)}, ', and your profile "
                "does not answer any of those. Fill in the matching details and this becomes a "
                "straight comparison.')"),
        )

    return S.let(
        findings,
        lambda xs: S.let_all(
            [of("conflicts", xs), of("matches", xs), of("unknown", xs)],
            lambda bad, good, open_: decide(xs, bad, good, open_),
        ),
    )


def relevance_claim(
    findings: str, assessment: str, text_confidence: str, source_kind: str
) -> str:
    """The verdict as a claim: MISSING when nothing restricts, never a FACT."""
    labels = ", ".join(f"'{k}', '{v}'" for k, v in L.RELEVANCE_LABELS.items())
    rank = "CASE {f}.match WHEN 'conflicts' THEN 0 WHEN 'matches' THEN 1 ELSE 2 END"

    def anchor(xs: str) -> str:
        ranked = S.lam(
            lambda f, i: f"struct({rank.format(f=f)} as r, {i} as i, {f}.char_start as char_start, "
            f"{f}.char_end as char_end, {f}.text as text)", 2
        )
        return f"array_min(transform({xs}, {ranked}))"

    def build(score: str, span: str) -> str:
        cls = never_fact(classify_confidence(score))
        return S.struct(
            value=f"map({labels})[{assessment}.verdict]",
            classification=f"if({assessment}.verdict = 'not_restricted', 'MISSING', {cls})",
            score=score,
            rationale=f"concat({assessment}.rationale, {ocr_note(source_kind, text_confidence)})",
            char_start=f"{span}.char_start", char_end=f"{span}.char_end", evidence=f"{span}.text",
        )

    return S.let_all(
        [cap_score(f"{assessment}.confidence", text_confidence), anchor(findings)], build
    )


def check_eligibility(docs: DataFrame) -> DataFrame:
    """Needs ``criteria`` and ``profile``; one row per finding."""
    return table_of(with_findings(docs), "findings", "doc_id", "profile_id", position="pos")


def asked_attributes(docs: DataFrame) -> DataFrame:
    """Distinct restricted attributes of each document, in first-seen order."""
    return with_criteria(docs).selectExpr(
        "doc_id",
        "posexplode(array_distinct(transform(criteria, c -> c.attribute))) as (pos, attribute)",
    )
