"""Quotes located in their source, and proposals held to what it says."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docplan.functions import spans as S
from docplan.functions.rows import table_of
from docplan.operators.text import RAW_TOKEN, SPACE_CHARACTER, UNEVEN, fold_characters, mask_breaks, normalize

# Thresholds of anchoring and of the verification built on it.
KEEP_AT, VERBATIM_AT = 0.72, 0.92
VERBATIM_SCORE, LOOSE_SCORE = 0.86, 0.55
WINDOW_SLACK = 1.35
SPAN = "struct<char_start:int,char_end:int>"


def _raw_tokens(text: str) -> str:
    """Whitespace-separated tokens of the source, soft line breaks kept inside."""
    return S.find_all(text, RAW_TOKEN)


def source_span(text: str, folded: str, start: str, end: str) -> str:
    """Maps a span of the normalised text back to the source."""
    return f"{source_spans(text, folded, f'array(struct({start} as lo, {end} as hi))')}[0]"


def source_spans(text: str, folded: str, spans: str) -> str:
    """Maps spans (lo, hi) of ``folded``, the normalised text, back to the source; a null one stays null.

    Where every token of the source is one of the normalised text, only the tokens at the ends of a span are
    folded; soft line breaks and characters that fold to nothing or to a space need all of them.
    """
    return f"if({S.has(text, UNEVEN)}, {_by_folded_tokens(text, spans)}, {_by_counted_tokens(text, folded, spans)})"


def _by_counted_tokens(text: str, folded: str, spans: str) -> str:
    """Maps spans back by counting the tokens before their ends: equally many in source and normalised text."""

    def locate(pieces: str, places: str, offset: str) -> str:
        def begin(k: str) -> str:
            return f"char_length(array_join(slice({pieces}, 1, {places}[{k}]), ' ')) + if({places}[{k}] > 0, 1, 0)"

        def inside(k: str, skipped: str) -> str:
            token = f"{pieces}[{places}[{k}]]"
            positions = S.keep(
                f"sequence(1, char_length({token}))",
                lambda n: f"char_length({fold_characters(f'left({token}, {n})')}) > {skipped}",
            )
            plain = f"if({skipped} < char_length({token}), {skipped}, NULL)"
            within = f"if(octet_length({token}) = char_length({token}), {plain}, try_element_at({positions}, 1) - 1)"
            following = f"if({k} + 1 < size({places}), {begin(f'({k} + 1)')}, NULL)"
            return f"coalesce({begin(k)} + {within}, {following})"

        before = f"left({folded}, {offset})"
        return S.let_all(
            [f"char_length({before}) - char_length(replace({before}, ' ', ''))",
             f"char_length(substring_index({before}, ' ', -1))"], inside)

    pieces = f"split({text}, {S.lit(SPACE_CHARACTER)}, -1)"
    numbered = S.lam(lambda x, i: f"if({x} != '', {i}, NULL)", 2)
    return S.let(
        pieces,
        lambda ps: S.let(
            f"array_compact(transform({ps}, {numbered}))",
            lambda at: S.transform(
                spans,
                lambda p: f"if({p}.lo IS NULL, cast(NULL as {SPAN}), " + S.struct(
                    char_start=locate(ps, at, f"{p}.lo"), char_end=f"{locate(ps, at, f'({p}.hi - 1)')} + 1"
                ) + ")",
            ),
        ),
    )


def _by_folded_tokens(text: str, spans: str) -> str:
    """Maps spans of any normalised text back to the source, with all tokens folded one by one.

    The normalised text is the folded tokens joined by single spaces, so the
    token holding an offset is found by running lengths and the character
    inside it by folding prefixes of that one token. A joining space stands
    for the first character after it.
    """

    def locate(tokens: str, starts: str, offset: str) -> str:
        begun = f"size({S.keep(starts, lambda s: f'{s} <= {offset}')}) - 1"

        def inside(i: str) -> str:
            masked = f"{tokens}[{i}].masked"
            positions = S.keep(
                f"sequence(1, char_length({masked}))",
                lambda n: f"char_length({fold_characters(f'left({masked}, {n})')}) > "
                f"{offset} - {starts}[{i}]",
            )
            within = f"{tokens}[{i}].char_start + try_element_at({positions}, 1) - 1"
            return f"coalesce({within}, try_element_at({tokens}, {i} + 2).char_start)"

        return S.let(begun, inside)

    tokens = S.transform(
        _raw_tokens(text),
        lambda t: S.let(
            mask_breaks(f"{t}.text"),
            lambda m: S.struct(char_start=f"{t}.char_start", masked=m, folded=fold_characters(m)),
        ),
    )
    visible = S.keep(tokens, lambda t: f"{t}.folded != ''")
    return S.let(
        visible,
        lambda ts: S.let(
            S.running_starts(S.transform(ts, lambda t: f"char_length({t}.folded) + 1")),
            lambda st: S.transform(
                spans,
                lambda p: f"if({p}.lo IS NULL, cast(NULL as {SPAN}), " + S.struct(
                    char_start=locate(ts, st, f"{p}.lo"), char_end=f"{locate(ts, st, f'({p}.hi - 1)')} + 1"
                ) + ")",
            ),
        ),
    )


def anchor_exact(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote_id, doc_id, quote) -> where the quote stands, ignoring cosmetics.

    Each text is normalised once, before the join on ``doc_id``; only texts
    that contain the quote have their offsets mapped back.
    """
    def place(at: str) -> str:
        span = source_span("text", "_hay", at, f"({at} + char_length(_needle))")
        return f"if(_needle != '' AND {at} >= 0, array({span}), {S.empty(SPAN)})"

    found = _side_by_side(quotes, docs).selectExpr(
        "quote_id", "doc_id", "text", f"{S.let('instr(_hay, _needle) - 1', place)} as _spans"
    )
    return table_of(found, "_spans", "quote_id", "doc_id", "text").selectExpr(
        "quote_id", "doc_id", "char_start", "char_end",
        "substring(text, char_start + 1, char_end - char_start) as matched", "1D as score",
    )


def _side_by_side(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Quotes next to their source, both normalised before the join.

    No filter mentions the normalised columns: Catalyst would carry the whole
    normalisation through its constraints.
    """
    needles = quotes.selectExpr("quote_id", "doc_id", f"{normalize('quote')} as _needle")
    return needles.join(docs.selectExpr("doc_id", "text", f"{normalize('text')} as _hay"), "doc_id")


def longest_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Start in ``a``, start in ``b`` and length of the longest common run; the first one of equals."""
    best, lengths = (0, 0, 0), np.zeros(len(b) + 1, np.int64)
    for i, code in enumerate(a):
        grown = np.zeros(len(b) + 1, np.int64)
        grown[1:] = np.where(b == code, lengths[:-1] + 1, 0)
        lengths = grown
        j = int(lengths.argmax())
        if lengths[j] > best[2]:
            k = int(lengths[j])
            best = (i + 1 - k, j - k, k)
    return best


def aligned_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Start in ``b`` and length of the common runs: the longest, then those before it and behind it."""
    open_, out = [(0, len(a), 0, len(b))], []
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, k = longest_run(a[a0:a1], b[b0:b1])
        if k:
            out.append((b0 + j, k))
            open_ += [(a0, a0 + i, b0, b0 + j), (a0 + i + k, a1, b0 + j + k, b1)]
    return sorted(out)


_WORD = re.compile(r"\w+")


def _places(needle: str, words: dict[str, list[int]]) -> list[int]:
    """Starts that put a word of the quote where it stands in the text; those of the rarest words first."""
    found = [(len(words[m.group()]), -len(m.group()), m.start(), m.group()) for m in _WORD.finditer(needle) if m.group() in words]
    first = _WORD.search(needle)
    starts = (max(0, at - (start - first.start())) for _, _, start, word in sorted(found) for at in words[word])
    return list(dict.fromkeys(starts))


class Source:
    """A normalised text that quotes are looked up in: its characters and the places of its words."""

    def __init__(self, text: str):
        self.text = text
        self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.words: dict[str, list[int]] = {}
        for m in _WORD.finditer(text):
            self.words.setdefault(m.group(), []).append(m.start())

    def find(self, needle: str, threshold: float) -> tuple[float, int, int] | None:
        """Score and span of the best place of a normalised quote, exact ones first.

        The similarity is twice the aligned characters over both lengths. No
        window aligns more characters than both have in common, whatever their
        order; that bound is computed for all windows at once from running
        counts, and windows are aligned from the highest bound down until the
        best similarity found excludes the rest.
        """
        if not needle:
            return None
        exact = self.text.find(needle)
        if exact >= 0:
            return 1.0, exact, exact + len(needle)
        starts = np.array(_places(needle, self.words), np.int64)
        if not len(starts):
            return None
        ends = np.minimum(starts + max(len(needle), int(len(needle) * WINDOW_SLACK)), len(self.codes))
        wanted, often = np.unique(np.frombuffer(needle.encode("utf-32-le"), np.uint32), return_counts=True)
        common = np.zeros(len(starts), np.int64)
        for code, count in zip(wanted, often):
            seen = np.concatenate([[0], np.cumsum(self.codes == code)])
            common += np.minimum(seen[ends] - seen[starts], count)
        bound = 2 * common / (len(needle) + ends - starts)
        own, best = np.frombuffer(needle.encode("utf-32-le"), np.uint32), None
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < max(threshold, best[0] if best else 0):
                break
            blocks = aligned_blocks(own, self.codes[starts[k] : ends[k]])
            score = 2 * sum(size for _, size in blocks) / (len(own) + int(ends[k] - starts[k]))
            if blocks and score >= threshold and (best is None or (score, -k) > (best[0], -best[1])):
                at = int(starts[k])
                best = (score, int(k), at + blocks[0][0], at + blocks[-1][0] + blocks[-1][1])
        return best and (best[0], best[2], best[3])


def located(threshold: float = KEEP_AT):
    """Arrow function of a normalised text and normalised quotes: score, lo and hi of each, null where not found."""
    place = T.StructType().add("score", T.DoubleType()).add("lo", T.IntegerType()).add("hi", T.IntegerType())

    @F.pandas_udf(T.ArrayType(place))
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, quotes in batches:
            rows = []
            for text, needles in zip(texts, quotes, strict=True):
                source = Source(text) if text and needles is not None and len(needles) else None
                found = [source.find(n, threshold) if source and n else None for n in (() if needles is None else needles)]
                rows.append([f and dict(zip(("score", "lo", "hi"), f)) for f in found])
            yield pd.Series(rows)

    # nondeterministic, so that no filter on its result is pushed below the projection and evaluates it twice
    return find.asNondeterministic()


def anchor_fuzzy(quotes: DataFrame, docs: DataFrame, threshold: float = KEEP_AT) -> DataFrame:
    """Quotes that stand in their source only approximately, with their best place around any of their words."""
    sides = _side_by_side(quotes, docs).withColumn("_p", located(threshold)("_hay", F.array("_needle"))[0])
    loose = sides.where("_p.score IS NOT NULL AND instr(_hay, _needle) = 0")
    return loose.selectExpr("quote_id", "doc_id", "text", "_p", f"{source_span('text', '_hay', '_p.lo', '_p.hi')} as p").selectExpr(
        "quote_id", "doc_id", "p.char_start", "p.char_end",
        "substring(text, p.char_start + 1, p.char_end - p.char_start) as matched", "round(_p.score, 4) as score",
    )


def anchored(quotes: DataFrame, docs: DataFrame, threshold: float = KEEP_AT) -> DataFrame:
    return anchor_exact(quotes, docs).unionByName(anchor_fuzzy(quotes, docs, threshold))


def verify_proposals(proposals: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each proposal with its fate: hallucinated, demoted or verified.

    ``proposals``: quote_id, doc_id, kind and payload columns. Only actions
    can be demoted; a loose requirement or gap is kept as it is.
    """
    spans = anchors.select("quote_id", "doc_id", "char_start", "char_end", F.col("score").alias("anchor"))
    return proposals.join(spans, ["quote_id", "doc_id"], "left").selectExpr(
        "*",
        S.when(
            ("anchor IS NULL", "'hallucinated'"),
            (f"kind = 'action' AND anchor < {VERBATIM_AT}D", "'demoted'"),
            otherwise="'verified'",
        ) + " as outcome",
        f"CASE WHEN anchor IS NULL THEN NULL WHEN anchor < {VERBATIM_AT}D THEN {LOOSE_SCORE}D "
        f"ELSE {VERBATIM_SCORE}D END as confidence",
    )


def date_catalogue(temporal: DataFrame) -> DataFrame:
    """(doc_id, temporal array) -> the dates a proposal may refer to, as ``date-N``."""
    numbered = table_of(temporal, "temporal", "doc_id", position="pos")
    return numbered.where("resolved IS NOT NULL").selectExpr(
        "doc_id", "concat('date-', pos + 1) as date_id", "text as date_text", "resolved",
    )


def resolve_date_refs(proposals: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``deadline`` from a cited ``deadline_id``; an unknown id yields null."""
    dates = catalogue.select("doc_id", F.col("date_id").alias("deadline_id"),
                             F.col("resolved").alias("deadline"))
    return proposals.join(dates, ["doc_id", "deadline_id"], "left")


def hallucination_rate(verified: DataFrame, *keys: str) -> DataFrame:
    return verified.groupBy(*keys).agg(
        F.count("*").alias("proposed"),
        F.count_if(F.col("outcome") == "hallucinated").alias("hallucinated"),
        F.count_if(F.col("outcome") == "demoted").alias("demoted"),
        F.expr("count_if(outcome = 'hallucinated') / cast(count(*) as double)").alias("rate"),
    )


def kept_proposals(rules: np.ndarray, proposals: np.ndarray) -> np.ndarray:
    """Which proposal spans overlap no rule span and no proposal kept before by half of the shorter one.

    Spans are rows (start, end). Rule spans that reach a proposal lie between
    two binary searches, over their starts and over the running maximum of
    their ends. Kept proposals contain none of each other, so their starts and
    ends rise together: those that reach a proposal are neighbours in a sorted
    list, and one strictly between the outer two lies inside it.
    """

    def clash(a0: int, a1: int, b0: int, b1: int) -> bool:
        shared, shorter = min(a1, b1) - max(a0, b0), min(a1 - a0, b1 - b0)
        return shared > 0 and shorter > 0 and 2 * shared >= shorter

    order = np.argsort(rules[:, 0], kind="stable")
    starts, ends = rules[order, 0], rules[order, 1]
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    first, last = np.searchsorted(reach, proposals[:, 0], "right"), np.searchsorted(starts, proposals[:, 1], "left")
    left, right = [], []
    out = np.zeros(len(proposals), bool)
    for k, (lo, hi) in enumerate(proposals.tolist()):
        s, e = starts[first[k] : last[k]], ends[first[k] : last[k]]
        shared, shorter = np.minimum(e, hi) - np.maximum(s, lo), np.minimum(e - s, hi - lo)
        if ((shared > 0) & (shorter > 0) & (2 * shared >= shorter)).any():
            continue
        begin, end = bisect.bisect_right(right, lo), bisect.bisect_left(left, hi)
        if end - begin > 2 or any(clash(lo, hi, left[i], right[i]) for i in range(begin, end)):
            continue
        out[k] = True
        if hi > lo:
            at = bisect.bisect_left(left, lo)
            left.insert(at, lo)
            right.insert(at, hi)
    return out


def _survivors():
    span = "array<struct<char_start:int,char_end:int>>"

    @F.pandas_udf("array<boolean>")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def spans(found) -> np.ndarray:
            return np.array([(f["char_start"], f["char_end"]) for f in ([] if found is None else found)], np.int64).reshape(-1, 2)

        for rules, proposals in batches:
            yield pd.Series([kept_proposals(spans(r), spans(p)).tolist() for r, p in zip(rules, proposals, strict=True)])

    return lambda xs: keep(*[F.expr(f"cast(transform({x}, x -> struct(x.char_start, x.char_end)) as {span})") for x in xs])


def merge_arms(docs: DataFrame, rules: str, proposals: str, column: str, by_end: bool = True) -> DataFrame:
    """Adds ``column``: the rule findings and the proposals that overlap nothing merged before, by place.

    Both are arrays of one document with equal fields; overlap is half of the
    shorter span. Of findings at one place rules come first, then the order of the proposals.
    """
    key = "struct(x.char_start, x.char_end, i)" if by_end else "struct(x.char_start, i)"
    flagged = docs.withColumn("_survives", _survivors()([rules, proposals]))
    both = f"concat({rules}, filter({proposals}, (x, i) -> _survives[i]))"
    return flagged.selectExpr(
        "*", f"transform(array_sort(transform({both}, (x, i) -> struct({key} as k, x as f))), x -> x.f) as {column}"
    ).drop("_survives")
