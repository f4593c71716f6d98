"""References a document makes and never resolves."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.rows import Findings, table_of

GAP_TYPE = "struct<char_start:int,char_end:int,text:string,rule:int>"


def resolved_nearby(text: str, m: str, fee: bool) -> str:
    """An address, a parenthesis or (for fees) an amount right after the phrase."""

    def inspect(window: str) -> str:
        checks = [
            S.has(window, L.NEARBY_ADDRESS),
            S.has(f"left({window}, 40)", L.NEARBY_PARENTHESIS),
        ]
        if fee:
            checks.append(S.has(window, L.NEARBY_AMOUNT))
        return "(" + " OR ".join(checks) + ")"

    return S.let(f"substring({text}, {m}.char_end + 1, 90)", inspect)


def vague_matches(text: str, rule: int) -> str:
    """All matches of one rule that nothing nearby resolves."""
    pattern = L.GAP_RULES[rule][0]
    open_ones = S.keep(
        S.find_all(text, pattern), lambda m: f"NOT {resolved_nearby(text, m, rule == L.FEE_RULE)}"
    )
    return S.transform(
        open_ones,
        lambda m: S.struct(
            char_start=f"{m}.char_start", char_end=f"{m}.char_end", text=f"{m}.text",
            rule=str(rule),
        ),
    )


def with_gaps(docs: DataFrame, column: str = "gaps") -> DataFrame:
    """Adds the open questions of a document, one per question, in text order.

    A phrase that starts inside one an earlier rule has claimed is skipped.
    """
    found = Findings(docs, column, S.empty(GAP_TYPE), "char_start char_end text rule")
    for rule in range(len(L.GAP_RULES)):
        matches = vague_matches("text", rule)

        def claim(kept: str, matches: str = matches) -> str:
            free = S.keep(
                matches,
                lambda m: "NOT "
                + S.any_of(
                    kept,
                    lambda c: f"{c}.char_start <= {m}.char_start AND {m}.char_start < {c}.char_end",
                ),
            )
            return f"concat({kept}, {free})"

        found.replace(S.let(column, claim), "char_start char_end text rule")
    questions = S.words([question for _, question, _ in L.GAP_RULES])
    reasons = S.words([why for _, _, why in L.GAP_RULES])
    found.replace(f"array_sort({column})", "char_start char_end text rule")
    found.add(question=lambda g: f"{questions}[{g}.rule]", why=lambda g: f"{reasons}[{g}.rule]")
    found.replace(S.first_per_key(column, lambda g: f"{g}.question"), " ".join(found.fields))
    found.add(suggestion=lambda g: suggest_resolution(f"{g}.question"))
    return found.only("question why suggestion char_start char_end text").df


def suggest_resolution(question: str) -> str:
    low = f"lower({question})"
    arms = [
        (" OR ".join(f"contains({low}, '{w}')" for w in cues), S.lit(advice))
        for cues, advice in L.GAP_ADVICE
    ]
    return S.when(*arms, otherwise=S.lit(L.GAP_DEFAULT_ADVICE))


def vague_referents(docs: DataFrame) -> DataFrame:
    """Every unresolved match of every rule, before overlaps are settled."""
    every = ", ".join(vague_matches("text", rule) for rule in range(len(L.GAP_RULES)))
    return docs.selectExpr("doc_id", f"inline(concat({every}))")


def extract_gaps(docs: DataFrame) -> DataFrame:
    return table_of(with_gaps(docs), "gaps", "doc_id")
