"""Confidence classes and the rules every claim has to satisfy."""

from __future__ import annotations

from docplan.functions import lexicon as L
from docplan.functions import spans as S


def classify_confidence(score: str) -> str:
    return S.when(
        (f"{score} >= {S.lit(L.FACT_AT)}", "'FACT'"),
        (f"{score} >= {S.lit(L.INFERENCE_AT)}", "'INFERENCE'"),
        otherwise="'UNCERTAIN'",
    )


def cap_score(score: str, text_confidence: str) -> str:
    """A claim cannot be surer than the characters it was read from."""
    return f"round(least({score}, {text_confidence}), 4)"


def never_fact(claim_class: str) -> str:
    return f"if({claim_class} = 'FACT', 'INFERENCE', {claim_class})"


def ocr_note(source_kind: str, text_confidence: str) -> str:
    return S.when(
        (
            f"{source_kind} IN ('scanned_pdf', 'image')",
            f"concat(' Read by OCR at ', {S.percent(text_confidence)}, "
            "' character confidence, which caps how far this can be trusted.')",
        ),
        otherwise="''",
    )
