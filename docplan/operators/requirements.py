"""Things a document demands: read off sentences, classified and grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.rows import Findings


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '([a-z]+)', 1)"


def names_an_artefact(text: str) -> str:
    return (
        f"(arrays_overlap({_tokens(text)}, {S.words(L.DOCUMENT_TERMS)}) "
        f"OR {S.has(text, L.INFORMATION_PHRASE)})"
    )


def clean_requirement(fragment: str) -> str:
    """A checklist entry, or null when nothing usable is left."""
    bare = S.replace(S.replace(fragment, L.ARTICLES, " "), L.NON_REQUIREMENT_CHARS, " ")
    trimmed = S.replace(S.strip(S.flat(bare), " ."), L.DANGLING_PARTICIPLE, "$1")
    return S.let(
        trimmed,
        lambda t: S.when(
            (
                f"char_length({t}) BETWEEN 3 AND 60 AND {S.has(t, '[A-Za-z]{3}')}",
                S.upper_first(t),
            )
        ),
    )


def _cleaned_parts(tail: str, separator: str) -> str:
    parts = S.transform(f"split({tail}, {S.lit(separator)}, -1)", clean_requirement)
    return S.keep(parts, lambda p: f"{p} IS NOT NULL")


def cued_requirements(sentence: str) -> str:
    """Items listed after ``along with``, ``enclosing`` and the like."""

    def items(cue: str) -> str:
        tail = S.head_of(S.after(sentence, f"{cue}.char_end"), L.TRAILING_CLAUSE)
        return _cleaned_parts(tail, L.CUED_SEPARATOR)

    return f"flatten({S.transform(S.find_all(sentence, L.REQUIREMENT_CUE), items)})"


def direct_object(tail: str, verb: str) -> str:
    """The object of the verb, as an array of at most one artefact."""
    head = S.head_of(S.head_of(tail, L.REQUIREMENT_CUE), L.OBJECT_END)
    usable = S.let(
        clean_requirement(head),
        lambda c: S.when(
            (
                f"{c} IS NOT NULL AND NOT {S.has(c, L.PRONOUN_OBJECT)} AND {names_an_artefact(c)}",
                f"array({c})",
            ),
            otherwise=S.empty("string"),
        ),
    )
    return S.when((f"{verb} = 'attend'", S.empty("string")), otherwise=usable)


def series_requirements(tail: str) -> str:
    """A comma series after the verb; counts only with a conjunction and two artefacts."""
    listed = S.first_per_key(
        S.keep(_cleaned_parts(tail, L.SERIES_SEPARATOR), names_an_artefact),
        lambda p: f"lower({p})",
    )
    usable = S.let(
        listed, lambda xs: f"if(size({xs}) >= 2, {xs}, {S.empty('string')})"
    )
    return S.when(
        (f"contains({tail}, ',') AND {S.has(tail, L.SERIES_CONJUNCTION)}", usable),
        otherwise=S.empty("string"),
    )


def at_most(items: str, limit: int | None) -> str:
    return f"slice({items}, 1, {limit})" if limit else items


def add_requirements(items: Findings, max_requirements: int | None = None) -> Findings:
    """Adds ``requires`` to findings that have ``wording``, ``verb_end`` and ``verb``; all of them unless limited.

    An explicit cue replaces a series: both would list the same things.
    """
    items.add(
        tail=lambda x: S.head_of(S.after(f"{x}.wording", f"{x}.verb_end"), L.TRAILING_CLAUSE),
        cued=lambda x: cued_requirements(f"{x}.wording"),
    )
    items.add(
        listed=lambda x: f"if(size({x}.cued) > 0, {x}.cued, {series_requirements(f'{x}.tail')})",
        target=lambda x: direct_object(f"{x}.tail", f"{x}.verb"),
    )
    return items.add(
        requires=lambda x: at_most(
            S.first_per_key(f"concat({x}.target, {x}.listed)", lambda p: f"lower({p})"), max_requirements)
    )


def requirement_kind(text: str) -> str:
    tokens = _tokens(text)
    return S.when(
        (f"trim({text}) = ''", "'unclassified'"),
        (S.has(text, L.CONDITION_PATTERN), "'condition'"),
        (S.has(text, L.INFORMATION_PHRASE), "'information'"),
        (f"arrays_overlap({tokens}, {S.words(L.DOCUMENT_TERMS)})", "'document'"),
        (S.has(text, L.DEMOGRAPHIC_PATTERN), "'condition'"),
        (f"arrays_overlap({tokens}, {S.words(L.INFORMATION_TERMS)})", "'information'"),
        otherwise="'unclassified'",
    )


def group_phrases(phrases: str) -> str:
    """Distinct phrases without the less specific restatements, as an array.

    Two phrases with the same content words are one requirement, kept in its
    longest wording; one whose words are a proper subset of another's goes.
    """
    distinct = S.first_per_key(
        S.keep(phrases, lambda p: f"{S.flat(p)} != ''"), lambda p: f"lower({S.flat(p)})"
    )
    identified = S.transform(
        distinct,
        lambda p: S.struct(
            text=p,
            identity=f"array_sort(array_except({_tokens(p)}, {S.words(L.REQUIREMENT_FILLER)}))",
        ),
    )

    def representative(xs: str, x: str) -> str:
        same = S.keep(xs, lambda o: f"{o}.identity = {x}.identity")
        longer = S.lam(
            lambda best, o: f"if(char_length({o}.text) > char_length({best}), {o}.text, {best})", 2
        )
        return f"if(size({x}.identity) = 0, {x}.text, aggregate({same}, '', {longer}))"

    def survivors(xs: str) -> str:
        def keeps(x: str, i: str) -> str:
            first = f"array_position(transform({xs}, o -> o.identity), {x}.identity) = {i} + 1"
            subsumed = S.any_of(
                xs,
                lambda o: f"size({o}.identity) > size({x}.identity) "
                f"AND size(array_except({x}.identity, {o}.identity)) = 0",
            )
            return f"size({x}.identity) = 0 OR ({first} AND NOT {subsumed})"

        return S.transform(f"filter({xs}, {S.lam(keeps, 2)})", lambda x: representative(xs, x))

    return S.let(identified, survivors)


def grouped_requirements(phrases: str) -> str:
    return S.transform(
        group_phrases(phrases), lambda p: S.struct(text=p, kind=requirement_kind(p))
    )


# --- table operators --------------------------------------------------------


def classify_requirements(phrases: DataFrame) -> DataFrame:
    """(doc_id, text) -> adds the kind and whether it is something to fetch."""
    return phrases.selectExpr(
        "doc_id", "text", f"{requirement_kind('text')} as kind",
        f"{names_an_artefact('text')} as artefact",
    )


def clean_requirements(fragments: DataFrame) -> DataFrame:
    return fragments.selectExpr("doc_id", "fragment", f"{clean_requirement('fragment')} as text")
