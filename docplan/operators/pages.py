"""The page of every finding, and the rules of claims over all that an analysis says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docplan.functions.rows import table_of
from docplan.operators.claims import PAGED_RULES, broken_rules

#: Columns of an analysis whose findings carry a span, and those that are one claim each.
FINDINGS, SINGLE = ("deadlines", "actions", "gaps", "criteria"), ("document_type", "title")


def page_at(offset: Column) -> Column:
    """The last page that begins at or before an offset; a text without page bounds is page 1.

    The bounds stand in the document's row, so the lookup is a fold over a
    short list, not a join.
    """
    begun = F.filter("pages", lambda p: p["char_start"] <= offset)
    return F.when(offset.isNotNull(), F.coalesce(F.try_element_at(begun, F.lit(-1))["page"], F.lit(1)))


def with_pages(analysed: DataFrame) -> DataFrame:
    """Adds ``page`` to every finding of an analysis that has the column ``pages``."""
    for name in FINDINGS:
        analysed = analysed.withColumn(name, F.transform(name, lambda x: x.withField("page", page_at(x["char_start"]))))
    for name in SINGLE:
        analysed = analysed.withColumn(name, F.col(name).withField("page", page_at(F.col(f"{name}.char_start"))))
    return analysed


def evidence_pages(analysed: DataFrame) -> DataFrame:
    """(doc_id, kind, char_start, char_end, page) of every span that a finding rests on."""
    spans = ", ".join(
        f"transform({name}, x -> struct('{name}' as kind, x.char_start, x.char_end, x.page))" for name in FINDINGS)
    return table_of(analysed.selectExpr("doc_id", f"concat({spans}) as _spans"), "_spans", "doc_id")


def claim_rows(analysed: DataFrame) -> DataFrame:
    """Every claim of an analysis in one shape, with the text and page bounds it is held to."""
    fields = "'{0}' as kind, {1}.classification, {1}.score, {1}.rationale, {1}.char_start, {1}.char_end, {2} as evidence, {1}.page"
    cited = "if({0}.char_start is null, null, substring(text, {0}.char_start + 1, {0}.char_end - {0}.char_start))"
    claims = [f"transform(deadlines, d -> struct({fields.format('deadlines', 'd', 'd.evidence')}))",
              f"transform(actions, a -> struct({fields.format('actions', 'a', cited.format('a'))}))"]
    for name, evidence in zip(SINGLE, ("document_type.evidence", cited.format("title"))):
        claims.append(f"filter(array(struct({fields.format(name, name, evidence)})), c -> c.classification IS NOT NULL)")
    shape = "array<struct<kind:string,classification:string,score:double,rationale:string,char_start:int,char_end:int,evidence:string,page:int>>"
    every = ", ".join(f"cast({c} as {shape})" for c in claims)
    return table_of(analysed.selectExpr("doc_id", "text", "pages", f"concat({every}) as _claims"), "_claims", "doc_id", "text", "pages")


def audit_all_claims(analysed: DataFrame) -> DataFrame:
    """Claims and broken rules by kind; a sound analysis breaks none."""
    return claim_rows(analysed).groupBy("kind").agg(
        F.count("*").alias("claims"), F.sum(F.expr(f"size({broken_rules(PAGED_RULES)})")).alias("violations"))
