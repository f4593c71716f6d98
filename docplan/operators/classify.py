"""What kind of document a text is, from weighted wording near its top."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.claims import cap_score, classify_confidence, never_fact


def _type_scores(head: str, heading: str) -> str:
    """Score, name and heaviest matching signal of each type, best first."""
    entries = []
    for name, signals in L.TYPE_SIGNALS.items():
        flags = [(S.has(head, p), S.has(heading, p), w) for p, w in signals]
        total = " + ".join(f"if({hit}, {w}, 0)" for hit, _, w in flags)
        boost = " OR ".join(f"({hit} AND {top})" for hit, top, _ in flags)
        ranked = sorted(enumerate(signals), key=lambda s: (-s[1][1], s[0]))
        heaviest = S.when(*[(S.has(head, p), str(i)) for i, (p, _) in ranked], otherwise="-1")
        entries.append(
            S.struct(
                neg_score=f"-({total} + if({boost}, {L.HEADING_BOOST}, 0))",
                name=f"'{name}'",
                signal=heaviest,
            )
        )
    return f"array_sort({S.array(entries)})"


def with_type(
    docs: DataFrame, column: str = "document_type", head_chars: int | None = None,
    heading_chars: int | None = None,
) -> DataFrame:
    """Adds ``{type, confidence, rationale, char_start, char_end}``.

    The whole text and its whole first line count unless the caller limits them.
    """
    head = f"left(text, {head_chars})" if head_chars else "text"
    first_line = r"split(_head, '\n', 2)[0]"
    scored = docs.selectExpr("*", f"{head} as _head").selectExpr(
        "*",
        S.let(
            f"left({first_line}, {heading_chars})" if heading_chars else first_line,
            lambda heading: _type_scores("_head", heading),
        )
        + " as _ranked",
    )
    top = "-_ranked[0].neg_score"
    labels = ", ".join(f"'{k}', '{v.lower()}'" for k, v in L.TYPE_LABELS.items())
    first_name = f"map({labels})[_ranked[0].name]"
    second_name = f"map({labels})[_ranked[1].name]"
    margin = f"({top} + _ranked[1].neg_score) / cast(greatest({top}, 1) as double)"
    patterns = [
        (f"_ranked[0].name = '{name}' AND _ranked[0].signal = {i}", p)
        for name, signals in L.TYPE_SIGNALS.items()
        for i, (p, _) in enumerate(signals)
    ]

    def outcome(kind: str, confidence: str, rationale: str) -> str:
        return S.struct(type=kind, confidence=confidence, rationale=rationale)

    verdict = S.when(
        (
            f"{top} < {L.MIN_TYPE_SCORE}",
            outcome("'other'", "0.3D", "'No strong signal for any known document type.'"),
        ),
        (
            f"{margin} >= 0.5D",
            outcome("_ranked[0].name", "0.9D",
                    f"concat('Clear ', {first_name}, ' language, with no close alternative.')"),
        ),
        (
            f"{margin} >= 0.25D",
            outcome("_ranked[0].name", "0.72D",
                    f"concat('Reads as a ', {first_name}, ', though it shares language with a ', "
                    f"{second_name}, '.')"),
        ),
        otherwise=outcome(
            "_ranked[0].name", "0.5D",
            f"concat('Ambiguous: scores almost equally as a ', {first_name}, ' and a ', "
            f"{second_name}, '. Treat the type as unconfirmed.')"),
    )
    evidence = S.when(
        *[
            (f"_verdict.type != 'other' AND {cond}", S.find_all("_head", p) + "[0]")
            for cond, p in patterns
        ]
    )
    return (
        scored.selectExpr("*", f"{verdict} as _verdict")
        .selectExpr("*", f"{evidence} as _signal")
        .selectExpr(
            *docs.columns,
            S.struct(
                type="_verdict.type", confidence="_verdict.confidence",
                rationale="_verdict.rationale", char_start="_signal.char_start",
                char_end="_signal.char_end", evidence="_signal.text",
            )
            + f" as {column}",
        )
    )


def classify_documents(docs: DataFrame) -> DataFrame:
    return with_type(docs).selectExpr(
        "doc_id", "document_type.type", "document_type.confidence", "document_type.rationale"
    )


def type_claim(document_type: str, text_confidence: str) -> str:
    """The type as a claim: an inference at best, without evidence uncertain."""
    labels = ", ".join(f"'{k}', '{v}'" for k, v in L.TYPE_LABELS.items())

    def build(score: str) -> str:
        cls = never_fact(classify_confidence(score))
        cls = f"if({document_type}.evidence IS NULL, 'UNCERTAIN', {cls})"

        def cited(c: str) -> str:
            return S.struct(
                value=f"map({labels})[{document_type}.type]",
                classification=c,
                score=score,
                rationale=f"{document_type}.rationale",
                char_start=f"if({c} = 'UNCERTAIN', NULL, {document_type}.char_start)",
                char_end=f"if({c} = 'UNCERTAIN', NULL, {document_type}.char_end)",
                evidence=f"if({c} = 'UNCERTAIN', NULL, {document_type}.evidence)",
            )

        return S.let(cls, cited)

    return S.let(cap_score(f"{document_type}.confidence", text_confidence), build)


def document_type_claim(docs: DataFrame) -> DataFrame:
    claim = type_claim("document_type", "text_confidence")
    return with_type(docs).selectExpr("doc_id", f"inline(array({claim}))")
