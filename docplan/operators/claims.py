"""Rules over tables of claims, whatever operator produced them.

A claim table has: doc_id, classification, score, rationale, char_start,
char_end, evidence (the cited text), and the document's ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.claims import cap_score, classify_confidence

MAX_RATIONALE = 400


def classify_claims(claims: DataFrame) -> DataFrame:
    return claims.withColumn("classification", F.expr(classify_confidence("score")))


def cap_claims(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Caps each score by its document's text confidence and reclassifies."""
    limits = documents.select("doc_id", "text_confidence")
    capped = claims.join(limits, "doc_id").withColumn(
        "score", F.expr(cap_score("score", "text_confidence"))
    )
    return classify_claims(capped).drop("text_confidence")


def demote(claims: DataFrame, unsupported: str, reason: str) -> DataFrame:
    """Downgrades the claims for which ``unsupported`` holds; evidence stays."""
    return (
        claims.withColumn("_bad", F.expr(f"coalesce({unsupported}, false)"))
        .withColumn("classification", F.expr("if(_bad, 'UNCERTAIN', classification)"))
        .withColumn("score", F.expr(f"if(_bad, least(score, {S.lit(L.REPORTABLE_AT)}), score)"))
        .withColumn("rationale", F.expr(f"if(_bad, {S.lit(reason)}, rationale)"))
        .drop("_bad")
    )


VIOLATIONS = {
    "unsourced": "classification IN ('FACT', 'INFERENCE') AND evidence IS NULL",
    "sourced_absence": "classification = 'MISSING' AND evidence IS NOT NULL",
    "score_range": "score < 0 OR score > 1 OR score IS NULL",
    "rationale_length": f"char_length(coalesce(rationale, '')) NOT BETWEEN 1 AND {MAX_RATIONALE}",
    "empty_span": "char_start < 0 OR char_end <= char_start",
    "wrong_slice": "evidence != substring(text, char_start + 1, char_end - char_start)",
}


#: For claims with the page bounds of their document: evidence has a page, and begins on it.
PAGE_VIOLATIONS = {
    "no_page": "evidence IS NOT NULL AND page IS NULL",
    "wrong_page": "page IS NOT NULL AND size(pages) > 0 AND NOT exists(pages, p -> p.page = page AND p.char_start <= char_start "
    "AND NOT exists(pages, q -> q.char_start > p.char_start AND q.char_start <= char_start))",
}


PAGED_RULES = VIOLATIONS | PAGE_VIOLATIONS


def broken_rules(rules: dict[str, str]) -> str:
    """The names of the rules that a claim breaks."""
    named = S.array(f"if({rule}, '{name}', NULL)" for name, rule in rules.items())
    return f"array_compact({named})"


def audit_claims(claims: DataFrame, *keys: str) -> DataFrame:
    """One row per broken rule; sound operators produce none. ``keys`` are kept beside the document's id."""
    rules = PAGED_RULES if {"page", "pages"} <= set(claims.columns) else VIOLATIONS
    broken = claims.selectExpr("doc_id", *keys, f"explode_outer({broken_rules(rules)}) as violation")
    return broken.where("violation IS NOT NULL")


def actionable(claims: DataFrame) -> DataFrame:
    return claims.selectExpr(
        "*", f"score >= {S.lit(L.ACTIONABLE_AT)} as is_actionable",
        f"score >= {S.lit(L.REPORTABLE_AT)} as is_reportable",
    )

