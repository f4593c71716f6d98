"""The whole analysis of a corpus as one chain of narrow projections."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docplan.functions import spans as S
from docplan.operators.actions import with_actions, with_candidates
from docplan.operators.classify import type_claim, with_type
from docplan.operators.eligibility import assess, relevance_claim, with_criteria, with_findings
from docplan.operators.gaps import with_gaps
from docplan.operators.pages import with_pages
from docplan.operators.proposals import merged_candidates, merged_gaps, with_proposals
from docplan.operators.requirements import grouped_requirements
from docplan.operators.temporal import deadline_claims, primary_deadline, with_temporal
from docplan.operators.text import title_claim_column
from docplan.plans.schedule import is_feasible, unresolved_count, with_schedule


def with_dates(docs: DataFrame, today: str) -> DataFrame:
    """Adds ``issued``, ``temporal``, ``deadlines`` and ``primary_deadline``."""
    return (
        with_temporal(docs, today)
        .selectExpr(
            "*", f"{deadline_claims('temporal', 'text_confidence', 'source_kind')} as deadlines"
        )
        .selectExpr("*", f"{primary_deadline('deadlines')} as primary_deadline")
    )


def with_requirements(docs: DataFrame, more: str | None = None) -> DataFrame:
    phrases = f"flatten({S.transform('actions', lambda a: f'{a}.requires')})"
    if more:
        phrases = f"concat({phrases}, {more})"
    return docs.selectExpr("*", f"{grouped_requirements(phrases)} as requirements")


def with_plan(docs: DataFrame, today: str, proposals: bool = False) -> DataFrame:
    """Adds actions, their schedule and the grouped requirements; with ``proposals``, those of the proposals too."""
    if "completed" not in docs.columns:
        docs = docs.selectExpr("*", "cast(array() as array<string>) as completed")
    found = with_candidates(docs)
    if proposals:
        found = merged_candidates(found)
    planned = with_actions(found, own_deadlines=proposals).drop("candidates")
    return with_schedule(with_requirements(planned, "proposed_requirements" if proposals else None), today)


def analyse(docs: DataFrame, today: str, proposals: str | None = None) -> DataFrame:
    """One wide row per document with every claim and finding.

    ``proposals`` names a column of JSON responses (see ``operators.proposals``)
    that are verified against the text and merged with the rules' findings;
    ``verification`` then says how many there were and what became of them.

    ``docs``: doc_id, text, text_confidence, source_kind, and optionally
    ``completed`` (ids already done), ``profile`` (the reader) and ``pages`` (bounds
    of the pages, as assembled; every finding then has its page). Nothing is
    shuffled; the result is a view to be re-derived rather than stored.
    """
    dated = with_dates(docs, today)
    if proposals:
        dated = with_proposals(dated, proposals)
    out = with_gaps(with_plan(dated, today, bool(proposals)))
    if proposals:
        out = merged_gaps(out).drop("proposed_actions", "proposed_requirements", "proposed_gaps")
    out = with_criteria(out)
    out = with_type(out, "_type").selectExpr(
        "*",
        f"{type_claim('_type', 'text_confidence')} as document_type",
        f"{title_claim_column('text')} as title",
        f"{is_feasible('schedule')} as is_feasible",
        f"{unresolved_count('gaps', 'schedule')} as unresolved_count",
    ).drop("_type")
    if "profile" in docs.columns:
        out = with_findings(out).selectExpr("*", f"{assess('findings')} as assessment")
        claim = relevance_claim("findings", "assessment", "text_confidence", "source_kind")
        out = out.selectExpr("*", f"{claim} as relevance")
    return with_pages(out) if "pages" in docs.columns else out
