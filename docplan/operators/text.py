"""Sentences, normalised text, titles and excerpts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.functions import lexicon as L
from docplan.functions import spans as S

# --- sentences --------------------------------------------------------------


def _false_boundary() -> str:
    """Matches a marked boundary that follows an abbreviation or an initial.

    Only the twelve characters before a boundary count, dots included.
    """
    start = rf"(?:\A|[\s.{S.CLOSE}])"
    arms = [rf"{start}\p{{L}}\.{{0,11}}", r"\p{L}\.{11}"]
    for word in L.ABBREVIATIONS:
        room = 12 - len(word)
        arms += [rf"{start}{word}\.{{0,{room}}}", rf"{word}\.{{{room}}}"]
    return rf"(?iU){S.OPEN}(?<=(?:{'|'.join(arms)}){S.OPEN})([^{S.CLOSE}]*){S.CLOSE}"


def sentences(text: str) -> str:
    """Sentence spans, trimmed; boundaries after abbreviations are ignored.

    All boundaries are marked in one pass and the false ones unmarked in a
    second, so nothing is folded sequentially.
    """
    marked = S.mark(text, L.SENTENCE_BOUNDARY, S.CLOSE)
    true_only = f"replace({S.replace(marked, _false_boundary(), '$1')}, {S.lit(S.CLOSE)}, {S.lit(S.OPEN)})"

    def trimmed(p: str) -> str:
        def ended(l: str) -> str:
            return f"if({S.has(f'right({l}, 1)', r'(?U)\s')}, {S.replace(l, r'(?U)\s+\z', '')}, {l})"

        left = S.replace(f"{p}.text", r"(?U)\A\s+", "")
        return S.let(left, lambda l: S.let(
            ended(l),
            lambda body: S.let(
                f"{p}.char_end - char_length({l})",
                lambda start: S.struct(
                    char_start=start, char_end=f"{start} + char_length({body})", text=body
                ),
            ),
        ))

    pieces = S.transform(S.spans_of(true_only, which=0), trimmed)
    return S.keep(pieces, lambda p: f"{p}.text != ''")


def split_sentences(docs: DataFrame) -> DataFrame:
    numbered = f"posexplode({sentences('text')}) as (sent_no, s)"
    return docs.selectExpr("doc_id", numbered).selectExpr(
        "doc_id", "sent_no", "s.char_start", "s.char_end", "s.text"
    )


# --- normalisation ----------------------------------------------------------

_EXTRA_SPACE = "   ​﻿"
_SPACE = rf"\s\x1c-\x1f{_EXTRA_SPACE}"
#: Punctuation a typesetter substitutes.
_FOLD = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"',
    "–": "-", "—": "-", "−": "-", "‐": "-", "‑": "-", "…": "...",
}
_DELETED = "\u0003"


def _character_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility and case folding per character, derived from Unicode.

    Characters that fold to one go through a single ``translate``; the others
    are a table of their own. No character beyond U+2FFFF folds to another.
    """
    source, target, expanding = [], [], {}
    for code in range(0x20, 0x30000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or ch.isspace() or ch in _EXTRA_SPACE:
            continue
        folded = _FOLD.get(ch) or unicodedata.normalize("NFKC", ch).casefold() or ch
        if folded == ch or code < 0x80:
            continue
        if len(folded) == 1:
            source.append(ch)
            target.append(folded)
        else:
            expanding[ch] = folded
    return "".join(source), "".join(target), expanding


def _ranges(chars: Iterable[str]) -> str:
    """A regular expression class of the characters, neighbours as ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


_FROM, _TO, _EXPANDING = _character_tables()
#: ASCII characters are told before the long class is tried.
_SEVERAL = r"(?=[^\x00-\x7f])" + _ranges(_EXPANDING)


def _expand(ch: str) -> str:
    """What a single character folds to: the first characters by one ``translate`` each, long foldings by name."""
    long = {c: f for c, f in _EXPANDING.items() if len(f) > 4}
    short = sorted((c for c in _EXPANDING if c not in long), key=lambda c: -len(_EXPANDING[c]))
    parts = []
    for k in range(4):
        folded = "".join(_EXPANDING[c][k] for c in short if len(_EXPANDING[c]) > k)
        parts.append(f"translate({ch}, {S.lit(''.join(short))}, {S.lit(folded)})")
    named = [(f"{ch} = {S.lit(c)}", S.lit(f)) for c, f in long.items()]
    return S.when(*named, otherwise=f"concat({', '.join(parts)})")


RAW_TOKEN = rf"(?U)(?:[^{_SPACE}]|(?<=\p{{L}}[-‐‑])\s*[\r\n]\s*(?=\p{{L}}))+"
_SOFT_HYPHEN = r"(?U)(?<=\p{L})[-‐‑](?=\s*[\r\n]\s*\p{L})"


SPACE_CHARACTER = rf"(?U)[{_SPACE}]"


def _uneven() -> str:
    """Matches a text whose tokens may differ in number from those of its normalised form: it has characters
    that fold to nothing or to a space, or hyphens before a line break."""
    spaced = [c for c, f in {**_EXPANDING, **dict(zip(_FROM, _TO))}.items() if any(x.isspace() or x in _EXTRA_SPACE for x in f)]
    return rf"(?U)[-‐‑]\s*[\r\n]|{_DELETED}|(?=[^\x00-\x7f]){_ranges(['\u00ad', *spaced])}"


UNEVEN = _uneven()


def mask_breaks(token: str) -> str:
    """Turn soft line breaks into as many deletable characters, one for one."""
    hyphens = S.replace(token, _SOFT_HYPHEN, _DELETED)
    return S.replace(hyphens, rf"(?U)[­{_SPACE}]", _DELETED)


def fold_characters(text: str) -> str:
    """Case, compatibility forms and quotes folded; deletable characters dropped.

    Texts of ASCII characters need no table; others without a character that folds to several pay for one
    ``translate`` more.
    """
    def out(x: str) -> str:
        full = f"translate({x}, {S.lit(_FROM + _DELETED)}, {S.lit(_TO)})"
        return f"if(octet_length({x}) = char_length({x}), translate({x}, {S.lit(_DELETED)}, ''), {full})"

    def expanded(v: str) -> str:
        pieces = S.lam(lambda p, i: f"if({i} % 2 = 1, {_expand(p)}, {p})", 2)
        return f"array_join(transform({S.segments(S.mark(v, _SEVERAL))}, {pieces}), '')"

    return "lower(" + S.let(S.let(text, out), lambda v: S.when(
        (f"octet_length({v}) != char_length({v}) AND translate({v}, {S.lit(''.join(_EXPANDING))}, '') != {v}", expanded(v)),
        otherwise=v)) + ")"


def normalize(text: str) -> str:
    """Casefold, fold punctuation, rejoin hyphenated line breaks, collapse space."""
    spaced = S.replace(mask_soft(text), rf"(?U)[{_SPACE}]+", " ")
    return f"btrim({fold_characters(spaced)})"


def mask_soft(text: str) -> str:
    """Whole-text counterpart of ``mask_breaks``: drop breaks, keep other space."""
    # the hyphen first, so that nothing is looked up behind other characters
    joined = S.replace(text, r"(?U)[-‐‑](?<=\p{L}[-‐‑])\s*[\r\n]\s*(?=\p{L})", "")
    return S.replace(joined, r"­\s*", "")


def normalize_text(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id", f"{normalize('text')} as normalized")


# --- titles and excerpts ----------------------------------------------------



def title_claim_column(text: str, head_chars: int | None = None) -> str:
    """The first substantial line (of the first ``head_chars``, if limited), as an inference."""
    lines = S.find_all(f"left({text}, {head_chars})" if head_chars else text, r"(?dm)^[^\n]{6,120}$")
    usable = S.keep(
        lines,
        lambda m: f"char_length({S.strip(f'{m}.text')}) >= 6 "
        f"AND {S.has(f'{m}.text', '[A-Za-z]{3}')}",
    )

    def claim(m: str) -> str:
        def build(line: str) -> str:
            shouty = f"({line} = upper({line}) AND {line} != lower({line}))"
            return S.struct(
                value=line,
                classification="'INFERENCE'",
                score=f"if({shouty}, 0.8D, 0.62D)",
                rationale=f"if({shouty}, 'First heading-style line of the document.', "
                "'First substantial line; the document has no clear heading.')",
                char_start=f"{m}.char_start",
                char_end=f"{m}.char_start + char_length({line})",
            )

        return S.when((f"{m} IS NOT NULL", S.let(S.strip(f"{m}.text"), build)))

    return S.let(f"try_element_at({usable}, 1)", claim)


def title_claim(docs: DataFrame) -> DataFrame:
    claimed = docs.selectExpr("doc_id", f"inline_outer(array({title_claim_column('text')}))")
    return claimed.where("value IS NOT NULL")


def excerpt(text: str, limit: int = 160) -> str:
    def shorten(line: str) -> str:
        clipped = f"concat({S.rstrip(f'left({line}, {limit - 1})', ' ')}, '…')"
        return f"if(char_length({line}) <= {limit}, {line}, {clipped})"

    return S.let(S.flat(text), shorten)


def excerpts(docs: DataFrame, limit: int = 160) -> DataFrame:
    return docs.select("doc_id", F.expr(excerpt("text", limit)).alias("excerpt"))
