"""Structured proposals about a document, held to what the document says.

A response is JSON text: ``actions``, ``requirements`` and ``gaps``, each with
the words it quotes. It is parsed in the plan, every quote is looked up in the
normalised source, and what the source does not say is dropped. All of it
stays in the document's row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.operators.evidence import (
    KEEP_AT,
    LOOSE_SCORE,
    VERBATIM_AT,
    VERBATIM_SCORE,
    located,
    merge_arms,
    source_spans,
)
from docplan.operators.gaps import suggest_resolution
from docplan.operators.text import normalize

RESPONSE = (
    "actions array<struct<instruction:string,verb:string,quote:string,deadline_id:string,conditional_on:string,optional:boolean>>, "
    "requirements array<struct<text:string,quote:string>>, gaps array<struct<question:string,quote:string>>"
)

# What a reader is told about a finding that came as a proposal.
VERBATIM_NOTE = "Read by the model and verified against the document: its quotation appears in the source verbatim."
LOOSE_NOTE = "Read by the model. Its quotation matched the document only approximately ("
LOOSE_END = "), so this is reported as unconfirmed rather than as a finding."
DATED_NOTE = " Attached to the stated date of "
ONLY_NOTE = " Applies only "
OFFERED_NOTE = " The document offers this rather than requiring it."
GAP_REASON = "The document refers to this without stating it, so the reader cannot act on it from the document alone."

_KINDS = ("actions", "requirements", "gaps")


def with_proposals(docs: DataFrame, response: str, temporal: str = "temporal", threshold: float = KEEP_AT) -> DataFrame:
    """Adds ``proposed_actions``, ``proposed_requirements``, ``proposed_gaps`` and ``verification``.

    A null or malformed response proposes nothing, as does one with a verb of
    no known class: the rules' findings stand alone then.
    """
    bad_verb = S.any_of("_r.actions", lambda a: f"coalesce({a}.verb NOT IN ({', '.join(map(S.lit, L.EFFORT_DAYS))}), true)")
    empty = ", ".join(f"'{kind}', coalesce(_said.{kind}, array())" for kind in _KINDS)
    said = (
        docs.withColumn("_r", F.from_json(response, RESPONSE))
        .withColumn("_said", F.expr(f"if(coalesce({bad_verb}, false), NULL, _r)"))
        .withColumn("_said", F.expr(f"named_struct({empty})")).drop("_r")
    )
    quotes = ", ".join(S.transform(f"_said.{kind}", lambda p: f"coalesce({p}.quote, '')") for kind in _KINDS)
    needles = said.selectExpr("*", f"{S.transform(f'concat({quotes})', normalize)} as _needles")
    # the source is normalised only for documents with proposals
    placed = needles.selectExpr("*", f"if(size(_needles) > 0, {normalize('text')}, '') as _hay").withColumn(
        "_found", located(threshold)("_hay", "_needles"))
    spanned = placed.selectExpr("*", f"if(size(_needles) > 0, {source_spans('text', '_hay', '_found')}, array()) as _spans")
    counted = spanned.selectExpr(
        "*", "0 as _at_actions", "size(_said.actions) as _at_requirements", "size(_said.actions) + size(_said.requirements) as _at_gaps")

    def kept(kind: str, build) -> str:
        """The proposals of a kind whose quote was found, as ``build(proposal, score, span)`` makes them."""
        each = S.lam(
            lambda p, i: f"if(_spans[_at_{kind} + {i}] IS NULL, NULL, {build(p, f'_found[_at_{kind} + {i}].score', f'_spans[_at_{kind} + {i}]')})", 2)
        return f"array_compact(transform(_said.{kind}, {each}))"

    def action(p: str, score: str, span: str) -> str:
        index = f"try_cast(regexp_extract({p}.deadline_id, '^date-([1-9][0-9]*)$', 1) as int)"
        deadline = f"get({temporal}, {index} - 1).resolved"
        return S.let(deadline, lambda due: S.struct(
            char_start=f"{span}.char_start", char_end=f"{span}.char_end", description=f"{p}.instruction", verb=f"{p}.verb",
            confidence=f"if({score} < {VERBATIM_AT}D, {LOOSE_SCORE}D, {VERBATIM_SCORE}D)",
            rationale=f"concat(if({score} < {VERBATIM_AT}D, concat({S.lit(LOOSE_NOTE)}, {S.percent(f'round({score}, 4)')}, {S.lit(LOOSE_END)}), "
            f"{S.lit(VERBATIM_NOTE)}), coalesce(concat({S.lit(DATED_NOTE)}, {due}, '.'), ''), "
            f"coalesce(concat({S.lit(ONLY_NOTE)}, nullif({p}.conditional_on, ''), '.'), ''), if(coalesce({p}.optional, false), {S.lit(OFFERED_NOTE)}, ''))",
            requires=S.empty("string"), conditional_on=f"{p}.conditional_on", optional=f"coalesce({p}.optional, false)", deadline=due,
        ))

    def gap(p: str, score: str, span: str) -> str:
        return S.struct(
            question=f"{p}.question", why=S.lit(GAP_REASON), suggestion=suggest_resolution(f"{p}.question"),
            char_start=f"{span}.char_start", char_end=f"{span}.char_end",
            text=f"substring(text, {span}.char_start + 1, {span}.char_end - {span}.char_start)",
        )

    missing = f"size(_needles) - size({S.keep('_spans', lambda s: f'{s} IS NOT NULL')})"
    loose = f"size(filter(_found, (f, i) -> i < size(_said.actions) AND f.score < {VERBATIM_AT}D))"
    verification = S.struct(
        proposed="size(_needles)", hallucinated=missing, demoted=loose,
        rate=f"if(size(_needles) = 0, 0D, ({missing}) / cast(size(_needles) as double))",
    )
    return counted.selectExpr(
        *docs.columns, f"{kept('actions', action)} as proposed_actions",
        f"{kept('requirements', lambda p, score, span: f'{p}.text')} as proposed_requirements",
        f"{kept('gaps', gap)} as proposed_gaps", f"{verification} as verification",
    )


def merged_candidates(docs: DataFrame) -> DataFrame:
    """``candidates`` of the rules, then the proposals that overlap none of them, by place."""
    fields = "char_start char_end description verb confidence rationale requires conditional_on optional".split()
    dated = S.transform("candidates", lambda c: S.struct(**{f: f"{c}.{f}" for f in fields}, deadline="cast(NULL as date)"))
    ready = docs.withColumn("candidates", F.expr(dated))
    return merge_arms(ready, "candidates", "proposed_actions", "_merged").drop("candidates").withColumnRenamed("_merged", "candidates")


def merged_gaps(docs: DataFrame) -> DataFrame:
    """``gaps`` of the rules, then the proposals that overlap none of them, by start."""
    return merge_arms(docs, "gaps", "proposed_gaps", "_merged", by_end=False).drop("gaps").withColumnRenamed("_merged", "gaps")
