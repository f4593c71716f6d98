"""Calendar events and enquiry drafts made from an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.rows import table_of


def calendar_events(analysed: DataFrame) -> DataFrame:
    """One event per dated step on its start day, one for the primary deadline.

    Needs a ``name`` per document.
    """

    def status(score: str) -> str:
        return f"if({score} >= {S.lit(L.ACTIONABLE_AT)}, 'CONFIRMED', 'TENTATIVE')"

    def start(s: str, text: str) -> str:
        inherited = f"NOT ({s}.effective_deadline <=> {s}.deadline)"
        lines = ", ".join([
            f"{s}.rationale",
            f"if({inherited}, concat('This date is not stated in the document. It is inherited "
            "from a later step that depends on this one, due ', "
            f"{S.human_date(f'{s}.effective_deadline')}, '.'), NULL)",
            f"if(size({s}.requires) > 0, concat('Bring: ', array_join({s}.requires, ', '), '.'), "
            "NULL)",
            f"concat('Confidence: ', {s}.classification, ' ', {S.percent(f'{s}.score')}, ' — ', "
            f"{s}.claim_rationale)",
            f"concat('Source: \"', {S.strip(f'substring({text}, {s}.char_start + 1, {s}.char_end - {s}.char_start)')}"
            ", '\"')",
            f"concat('Allow about ', {S.days(f'{s}.effort_days')}, ' for this step.')",
        ])
        return S.struct(
            event_id=f"concat(doc_id, '-', {s}.action_id)", starts=f"{s}.latest_start",
            ends=f"date_add({s}.latest_start, 1)", summary=f"concat('Start: ', {s}.description)",
            description=f"concat_ws({S.lit(chr(10))}, {lines})", category=f"upper({s}.verb)",
            status=status(f"{s}.score"),
        )

    def due(p: str) -> str:
        lines = ", ".join([
            f"{p}.rationale",
            f"concat('Source: \"', {S.strip(f'{p}.evidence')}, '\"')",
            "if(is_feasible, NULL, 'This plan does not fit: at least one step needs longer than "
            "the time remaining. Check the steps marked behind schedule.')",
        ])
        return S.struct(
            event_id="concat(doc_id, '-deadline')", starts=f"{p}.value",
            ends=f"date_add({p}.value, 1)", summary="concat('Deadline: ', name)",
            description=f"concat_ws({S.lit(chr(10))}, {lines})", category="cast(NULL as string)",
            status=status(f"{p}.score"),
        )

    dated = S.keep("schedule", lambda s: f"{s}.latest_start IS NOT NULL")
    starts = S.let("text", lambda t: S.transform(dated, lambda s: start(s, t)))
    events = f"concat({starts}, if(primary_deadline IS NULL, array(), array({due('primary_deadline')})))"
    return table_of(analysed.selectExpr(
        "doc_id", "name", "text", "schedule", "primary_deadline", "is_feasible"), events, "doc_id")


def enquiry_drafts(analysed: DataFrame) -> DataFrame:
    """A letter that asks what each document leaves open."""
    nl = S.lit(chr(10))
    topic = "coalesce(title.value, name)"
    from_gaps = S.transform(
        "gaps",
        lambda g: f"concat({g}.question, {nl}, '   (the notice says \"', "
        f"{S.strip(f'{g}.text')}, '\")')",
    )
    unsettled = S.keep(
        "findings", lambda f: f"{f}.match = 'unknown' AND {f}.profile_value IS NOT NULL"
    )
    from_conditions = S.transform(
        unsettled,
        lambda f: f"concat('The notice is limited to ', {f}.requirement, '. Does that cover ', "
        f"{f}.profile_value, '?')",
    )
    numbered = S.lam(lambda q, i: f"concat({i} + 1, '. ', {q})", 2)
    asked = analysed.selectExpr(
        "doc_id", f"{topic} as topic", "primary_deadline.value as due",
        f"concat({from_gaps}, {from_conditions}) as questions",
    )
    gap = S.lit("\n\n")
    opening = f"concat('Dear Sir/Madam,', {gap}, 'I am writing with reference to ', topic"
    complete = (
        f"{opening}, '.', {gap}, 'The notice appears complete — there are no unanswered points to "
        "raise. This draft is here in case you want to confirm anything before submitting.', "
        f"{gap}, 'Thank you,', {nl})"
    )
    asking = (
        f"{opening}, '. Before I can act on it I need to confirm a few points the notice does not "
        f"state.', {gap}, array_join(transform(questions, {numbered}), {gap}), {gap}, "
        "'I would be grateful for clarification on the above.', "
        f"if(due IS NULL, '', concat(' The stated deadline is ', {S.human_date('due')}, ', so an "
        f"early reply would help.')), {gap}, 'Thank you,', {nl})"
    )
    return asked.selectExpr(
        "doc_id", "size(questions) as question_count",
        "concat(if(size(questions) = 0, 'Query regarding ', 'Clarification needed: '), topic) "
        "as subject",
        f"if(size(questions) = 0, {complete}, {asking}) as body",
    )
