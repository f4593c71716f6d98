"""What changed between two analysed versions of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.operators.pairing import pairing

CHANGE_TYPE = "struct<kind:string,severity:string,summary:string,before:string,after:string>"


def identity(text: str) -> str:
    return S.token_set(text, 3, L.COMPARE_FILLER)


def vocabulary(a: str) -> str:
    """Distinctive words of an analysis struct."""
    parts = [
        f"array({a}.document_type.value)",
        f"array({a}.title.value)",
        S.transform(f"{a}.schedule", lambda s: f"{s}.description"),
        S.transform(f"{a}.requirements", lambda r: f"{r}.text"),
        S.transform(f"{a}.gaps", lambda g: f"{g}.question"),
        S.transform(
            S.keep(f"{a}.deadlines", lambda d: f"{d}.classification != 'UNCERTAIN'"),
            lambda d: f"{d}.rationale",
        ),
    ]
    return identity(f"array_join(concat({', '.join(parts)}), ' ')")


def jaccard(a: str, b: str) -> str:
    shared, total = f"size(array_intersect({a}, {b}))", f"size(array_union({a}, {b}))"
    return f"if(size({a}) = 0 OR size({b}) = 0, 0D, {shared} / cast({total} as double))"


def _change(kind: str, severity: str, summary: str, before: str, after: str) -> str:
    return S.struct(
        kind=f"'{kind}'", severity=severity, summary=summary,
        before=f"cast({before} as string)", after=f"cast({after} as string)",
    )


def _none() -> str:
    return S.empty(CHANGE_TYPE)


def deadline_change(was: str, now: str) -> str:
    """Zero or one change between two primary deadline values."""
    gap = f"datediff({now}, {was})"
    moved = (
        f"concat('The deadline moved ', if({gap} < 0, 'forward', 'back'), ' by ', "
        f"{S.days(f'abs({gap})')}, ', from ', {S.human_date(was)}, ' to ', {S.human_date(now)}, "
        f"'.', if({gap} < 0, ' You have less time than the plan assumed.', ''))"
    )
    return S.when(
        (
            f"{was} IS NULL AND {now} IS NOT NULL",
            "array(" + _change(
                "deadline_added", "'critical'",
                f"concat('A deadline of ', {S.human_date(now)}, ' has been added. The earlier "
                "version stated none.')", "NULL", now) + ")",
        ),
        (
            f"{was} IS NOT NULL AND {now} IS NULL",
            "array(" + _change(
                "deadline_removed", "'notable'",
                f"concat('The deadline of ', {S.human_date(was)}, ' is gone from this version. It "
                "has not been extended — it is simply no longer stated, which is worth confirming "
                "before you slow down.')", was, "NULL") + ")",
        ),
        (
            f"{was} != {now}",
            "array(" + _change(
                "deadline_moved", f"if({gap} < 0, 'critical', 'notable')", moved, was, now) + ")",
        ),
        otherwise=_none(),
    )


def action_changes(pairing: str, previous: str, current: str) -> str:
    added = S.transform(
        f"{pairing}.added",
        lambda i: _change("action_added", "'critical'",
                          f"concat('New step: ', {current}[{i}].description, '.')", "NULL",
                          f"{current}[{i}].description"),
    )
    removed = S.transform(
        f"{pairing}.removed",
        lambda i: _change("action_removed", "'minor'",
                          f"concat('No longer required: ', {previous}[{i}].description, '.')",
                          f"{previous}[{i}].description", "NULL"),
    )
    return f"concat({added}, {removed})"


def reschedule_changes(pairing: str, previous: str, current: str, shift: str) -> str:
    """Paired steps whose start moved, unless the deadline's own move explains it."""

    def of(p: str) -> str:
        def compare(was: str, now: str, label: str) -> str:
            gap = f"datediff({now}, {was})"
            sooner = f"{gap} < 0"
            return S.when(
                (f"{was} <=> {now} OR coalesce({gap} = {shift}, false)", _none()),
                (
                    f"{was} IS NULL OR {now} IS NULL",
                    "array(" + _change(
                        "action_rescheduled", "'notable'",
                        f"if({now} IS NULL, concat('“', {label}, '” no longer has a start date.'), "
                        f"concat('“', {label}, '” now has a start date of ', "
                        f"{S.human_date(now)}, '.'))", was, now) + ")",
                ),
                otherwise="array(" + _change(
                    "action_rescheduled", f"if({sooner}, 'notable', 'minor')",
                    f"concat('“', {label}, '” now has to start ', {S.days(f'abs({gap})')}, "
                    f"if({sooner}, ' earlier', ' later'), ', on ', {S.human_date(now)}, '.')",
                    was, now) + ")",
            )

        return S.let_all(
            [f"{previous}[{p}.l].latest_start", f"{current}[{p}.r].latest_start",
             f"{current}[{p}.r].description"],
            compare,
        )

    return f"flatten({S.transform(f'{pairing}.pairs', of)})"


def requirement_changes(pairing: str, previous: str, current: str) -> str:
    added = S.transform(
        f"{pairing}.added",
        lambda i: _change("requirement_added", "'critical'",
                          f"concat('You now also need: ', {current}[{i}].text, '.')", "NULL",
                          f"{current}[{i}].text"),
    )
    removed = S.transform(
        f"{pairing}.removed",
        lambda i: _change("requirement_removed", "'minor'",
                          f"concat('No longer asked for: ', {previous}[{i}].text, '.')",
                          f"{previous}[{i}].text", "NULL"),
    )
    return f"concat({added}, {removed})"


def condition_changes(previous: str, current: str) -> str:
    def keys(xs: str) -> str:
        return S.transform(xs, lambda c: f"struct({c}.requirement, {c}.attribute)")

    added = S.transform(
        f"array_sort(array_except({keys(current)}, {keys(previous)}))",
        lambda k: _change("condition_added", "'critical'",
                          f"concat('New eligibility condition: ', {k}.requirement, '. Check that "
                          "you still qualify.')", "NULL", f"{k}.requirement"),
    )
    dropped = S.transform(
        f"array_sort(array_except({keys(previous)}, {keys(current)}))",
        lambda k: _change("condition_removed", "'notable'",
                          f"concat('The requirement to be ', {k}.requirement, ' has been "
                          "dropped.')", f"{k}.requirement", "NULL"),
    )
    return f"concat({added}, {dropped})"


def gap_changes(previous: str, current: str) -> str:
    def keys(xs: str) -> str:
        return S.transform(xs, lambda g: f"{g}.question")

    closed = S.transform(
        f"array_sort(array_except({keys(previous)}, {keys(current)}))",
        lambda q: _change("gap_closed", "'minor'", f"concat('Answered in this version: ', {q})",
                          q, "NULL"),
    )
    opened = S.transform(
        f"array_sort(array_except({keys(current)}, {keys(previous)}))",
        lambda q: _change("gap_opened", "'notable'",
                          f"concat('This version leaves open: ', {q})", "NULL", q),
    )
    return f"concat({closed}, {opened})"


COMPARED = "title document_type deadlines primary_deadline schedule requirements gaps criteria".split()


def paired_versions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Joins two analysed tables on ``doc_id`` as structs ``p`` and ``c``."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("doc_id", F.struct(*COMPARED).alias(name))

    return packed(previous, "p").join(packed(current, "c"), "doc_id")


def with_pairings(pairs: DataFrame) -> DataFrame:
    """Adds ``step_pairs`` and ``requirement_pairs``: findings of both versions paired by wording."""

    def word_sets(findings: str, field: str) -> Column:
        return F.expr(S.transform(findings, lambda x: identity(f"{x}.{field}")))

    return pairs.select(
        "*",
        pairing(word_sets("p.schedule", "description"), word_sets("c.schedule", "description"),
                L.SAME_FINDING_AT).alias("step_pairs"),
        pairing(word_sets("p.requirements", "text"), word_sets("c.requirements", "text"),
                L.SAME_FINDING_AT).alias("requirement_pairs"),
    )


def with_changes(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ``key`` with the ranked ``changes``, ``relatedness``, ``warning`` and ``headline``."""
    severity = "CASE {c}.severity WHEN 'critical' THEN 0 WHEN 'notable' THEN 1 ELSE 2 END"

    def every(p: str, c: str, steps: str, reqs: str) -> str:
        return "concat(" + ", ".join([
            deadline_change(f"{p}.primary_deadline.value", f"{c}.primary_deadline.value"),
            action_changes(steps, f"{p}.schedule", f"{c}.schedule"),
            reschedule_changes(
                steps, f"{p}.schedule", f"{c}.schedule",
                f"datediff({c}.primary_deadline.value, {p}.primary_deadline.value)",
            ),
            requirement_changes(reqs, f"{p}.requirements", f"{c}.requirements"),
            condition_changes(f"{p}.criteria", f"{c}.criteria"),
            gap_changes(f"{p}.gaps", f"{c}.gaps"),
        ]) + ")"

    ranked = S.lam(
        lambda c, i: f"struct({severity.format(c=c)} as severity_rank, "
        f"array_position({S.words(L.CHANGE_KINDS)}, {c}.kind) as kind_rank, {i} as pos, {c} as c)",
        2,
    )
    return (
        with_pairings(pairs)
        .selectExpr(
            key,
            f"{S.let_all(['p', 'c', 'step_pairs', 'requirement_pairs'], every)} as _changes",
            f"{S.let_all([vocabulary('p'), vocabulary('c')], jaccard)} as _related",
        )
        .selectExpr(
            key, "_related",
            S.transform(f"array_sort(transform(_changes, {ranked}))", lambda r: f"{r}.c")
            + " as changes",
        )
        .selectExpr(
            key, "changes", "round(_related, 3) as relatedness",
            f"if(_related < {S.lit(L.RELATED_AT)}, concat('These two documents have only ', "
            f"{S.percent('_related')}, ' of their wording in common, which is low for two versions "
            "of one notice. The changes below may simply be the differences between two unrelated "
            "documents.'), NULL) as warning",
            "if(size(changes) = 0, 'Nothing that affects your plan has changed.', "
            "changes[0].summary) as headline",
            "size(changes) = 0 as is_unchanged",
        )
    )
