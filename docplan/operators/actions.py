"""Instructions to the reader: verbs, wording, restrictions and requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.claims import cap_score, classify_confidence, ocr_note
from docplan.functions.rows import Findings
from docplan.operators.requirements import add_requirements, group_phrases
from docplan.operators.text import sentences

_FORMS = L.VERB_FORMS


def verb_lexicon(spark: SparkSession) -> DataFrame:
    """Every inflected form with the bucket and the base verb it belongs to."""
    return spark.createDataFrame(_FORMS, "form string, bucket string, base string")


def _lookup(form: str, column: int) -> str:
    table = ", ".join(f"'{row[0]}', '{row[column]}'" for row in _FORMS)
    return f"try_element_at(map({table}), {form})"


def bucket_of(form: str) -> str:
    return _lookup(form, 1)


def base_of(form: str) -> str:
    return _lookup(form, 2)


def obligation_tier(sentence: str) -> str:
    """Strength of the strongest obligation wording; 0 if there is none."""
    return S.when(*[(S.has(sentence, p), S.lit(v)) for v, p in L.OBLIGATION_TIERS], otherwise="0D")


def obligation_score(sentence: str) -> str:
    """Confidence that a sentence instructs; null when it does not."""
    return S.let(
        obligation_tier(sentence),
        lambda tier: S.when(
            (f"{tier} > 0", tier), (S.has(sentence, L.IMPERATIVE), S.lit(L.IMPERATIVE_SCORE))
        ),
    )


def shortened(text: str, limit: int) -> str:
    """A description cut to ``limit`` characters for display, at a word if one ends in its second half."""

    def clip(head: str) -> str:
        boundary = f"(char_length({head}) - instr(reverse({head}), ' '))"
        at_word = (
            f"if(instr({head}, ' ') > 0 AND {boundary} > {limit // 2}, "
            f"left({head}, {boundary}), {head})"
        )
        return f"concat({S.rstrip(at_word, '.,;: ')}, '…')"

    return f"if(char_length({text}) <= {limit}, {text}, {S.let(f'left({text}, {limit})', clip)})"


def _tidy(text: str, fallback: str) -> str:
    def finish(cleaned: str) -> str:
        worded = S.replace(cleaned, L.THIRD_PERSON, "your")
        final = S.let(worded, S.upper_first)
        return f"if({cleaned} = '', {fallback}, {final})"

    return S.let(S.rstrip(S.flat(text), ".;:, "), finish)


def as_instruction(sentence: str, base: str) -> str:
    """Rewrite a sentence as an imperative; a passive regains its object."""

    def rewrite(line: str) -> str:
        def with_prefix(prefix: str, subject: str) -> str:
            def with_rest(rest: str) -> str:
                def passive(head: str) -> str:
                    tail = f"substring({rest}, char_length({head}) + 1)"
                    named = f"char_length({subject}) BETWEEN 1 AND {L.MAX_SUBJECT_CHARS}"
                    rebuilt = (
                        f"if({named}, concat({base}, ' ', {S.lower_first(subject)}, ' ', {tail}), "
                        f"concat({base}, ' ', {tail}))"
                    )
                    return f"if({head} != '', {rebuilt}, {rest})"

                body = S.let(S.group(rest, L.PASSIVE_HEAD, 0), passive)
                return f"if({prefix} = '', {line}, {body})"

            return S.let(S.after(line, f"char_length({prefix})"), with_rest)

        parts = [
            S.group(line, L.OBLIGATION_PREFIX, 0),
            S.strip(S.group(line, L.OBLIGATION_PREFIX, 1), " ,;:"),
        ]
        return _tidy(S.let_all(parts, with_prefix), fallback=line)

    return S.let(S.flat(sentence), rewrite)


def restriction(sentence: str) -> str:
    """Whom a sentence is meant for, in its own words; null where it names nobody in particular."""
    leading = (
        f"concat(lower({S.group(sentence, L.CONDITION_CLAUSE, 1)}), ' ', "
        f"{S.strip(S.group(sentence, L.CONDITION_CLAUSE, 2))})"
    )
    subject = f"concat('for ', {S.flat(S.group(sentence, L.CONDITION_SUBJECT, 1))})"
    return S.when(
        (S.has(sentence, L.CONDITION_CLAUSE), leading),
        (S.has(sentence, L.CONDITION_SUBJECT), subject),
    )


def is_optional(sentence: str, tier: str) -> str:
    """A bare imperative has tier 0 and therefore counts as optional too."""
    return f"({S.has(sentence, L.OPTIONAL_MARKER)} OR {tier} <= {S.lit(L.OPTIONAL_TIER)})"


_COORDINATED_NOTE = (
    "Coordinated with an earlier instruction in the same sentence, so it carries slightly less "
    "weight than the instruction that states the obligation."
)


def _first_governed(cut: str) -> str:
    """Place of the first verb in marked and cut text that nothing before it makes a noun; null without one."""
    verbs = f"sequence(1, size({cut}) - 1, 2)"
    governed = S.keep(verbs, lambda i: f"NOT {S.has(f'{cut}[{i} - 1]', L.NOUN_BEFORE)}")
    return f"if(size({cut}) > 1, try_element_at({governed}, 1), NULL)"


def governed_verbs(docs: DataFrame, column: str, min_sentence_chars: int | None = None) -> Findings:
    """Instructing sentences with the verb their obligation governs; with a minimum, long enough ones.

    The search for the verb starts after the obligation wording and skips a
    spelling used as a noun (after a determiner or a hyphenated prefix).
    """
    found = Findings(docs, column, sentences("text"), "char_start char_end text")
    if min_sentence_chars:
        found.keep(lambda s: f"char_length({s}.text) >= {min_sentence_chars}")
    found.add(tier=lambda s: obligation_tier(f"{s}.text"))
    found.keep(lambda s: f"{s}.tier > 0 OR {S.has(f'{s}.text', L.IMPERATIVE)}")
    found.add(
        skipped=lambda s: f"if({s}.tier > 0, "
        f"char_length({S.group(f'{s}.text', L.OBLIGATION_PREFIX, 0)}), 0)"
    )
    found.add(scope=lambda s: f"lower({S.after(f'{s}.text', f'{s}.skipped')})")
    found.add(cut=lambda s: S.segments(S.mark(f"{s}.scope", L.VERB_SPELLING)))
    found.add(place=lambda s: _first_governed(f"{s}.cut"))
    found.keep(lambda s: f"{s}.place IS NOT NULL")
    found.add(
        form=lambda s: f"{s}.cut[{s}.place]",
        verb_end=lambda s: f"{s}.skipped + char_length(array_join(slice({s}.cut, 1, {s}.place + 1), ''))",
    )
    return found.add(verb=lambda s: bucket_of(f"{s}.form"), base=lambda s: base_of(f"{s}.form"))


def _coordinated(s: str) -> str:
    """Further verbs joined by a comma, ``and`` or ``or``, in the head verb's form class."""

    def candidate(m: str) -> str:
        rest = S.head_of(S.after(f"{s}.text", f"{m}.char_end"), L.COORDINATED_END)
        return S.struct(
            form=S.replace(f"lower({m}.text)", r"(?sU)\A(?:,|and|or)\s+", ""),
            verb_end=f"{m}.char_end",
            rest=S.flat(S.head_of(rest, L.TRAILING_CLAUSE)),
        )

    found = S.transform(S.find_all(f"{s}.text", L.COORDINATED_VERB), candidate)
    return S.keep(
        found,
        lambda c: f"{c}.rest != '' AND ({c}.form = {base_of(f'{c}.form')}) = {s}.head_is_base",
    )


def _described(s: str) -> str:
    """Coordinated verbs with their wording, without repeats of an earlier one."""

    def describe(c: str) -> str:
        wording = f"concat({base_of(f'{c}.form')}, ' ', {c}.rest)"
        return S.struct(
            description=S.let(wording, S.upper_first),
            verb=bucket_of(f"{c}.form"),
            verb_end=f"{c}.verb_end",
        )

    fresh = S.keep(
        S.transform(f"{s}.joined", describe),
        lambda c: f"lower({c}.description) != lower({s}.description)",
    )
    return S.first_per_key(fresh, lambda c: f"lower({c}.description)")


def _instructions(s: str) -> str:
    """The head of a sentence followed by its coordinated instructions.

    With coordinated instructions the head stops where the first of them
    begins, so that it neither repeats nor absorbs them.
    """

    def entry(description: str, verb: str, score: str, why: str, wording: str, end: str) -> str:
        return S.struct(
            char_start=f"{s}.char_start", char_end=f"{s}.char_end", description=description,
            verb=verb, confidence=score, rationale=why, conditional_on=f"{s}.conditional_on",
            optional=f"{s}.optional", wording=wording, verb_end=end,
        )

    shortened = f"(size({s}.extras) > 0 AND {s}.clause_description != '')"
    head = entry(
        f"if({shortened}, {s}.clause_description, {s}.description)",
        f"{s}.verb", f"{s}.score", f"{s}.rationale",
        f"if({shortened}, {s}.clause, {s}.text)",
        f"if({shortened}, {s}.clause_verb_end, {s}.verb_end)",
    )
    others = S.transform(
        f"{s}.extras",
        lambda e: entry(
            f"{e}.description", f"{e}.verb",
            f"round({s}.score * {S.lit(L.COORDINATED_FACTOR)}, 4)", S.lit(_COORDINATED_NOTE),
            f"{s}.text", f"{e}.verb_end",
        ),
    )
    return f"concat(array({head}), {others})"


def with_candidates(docs: DataFrame, column: str = "candidates", requirements: bool = True) -> DataFrame:
    """Adds every instruction of a document, in order, as an array column; ``requires`` only with ``requirements``.

    An array of structs is computed whole, so what nobody reads has to be left out here.
    """
    found = governed_verbs(docs, column)
    found.add(
        score=lambda s: f"if({s}.tier > 0, {s}.tier, {S.lit(L.IMPERATIVE_SCORE)})",
        conditional_on=lambda s: restriction(f"{s}.text"),
        optional=lambda s: is_optional(f"{s}.text", f"{s}.tier"),
        description=lambda s: as_instruction(f"{s}.text", f"{s}.base"),
    )
    found.add(
        rationale=lambda s: f"concat(if({s}.tier > 0, "
        "'Sentence states an obligation using a modal verb.', "
        "'Sentence is phrased as a direct instruction.'), "
        f"coalesce(concat(' Applies only ', {s}.conditional_on, '.'), ''), "
        f"if({s}.optional, ' The document offers this rather than requiring it.', ''))",
        first_word=lambda s: f"lower(split({s}.description, ' ', 2)[0])",
        clause=lambda s: S.rstrip(S.head_of(f"{s}.text", L.COORDINATED_VERB), " ,;"),
    )
    found.add(
        head_base=lambda s: f"coalesce({base_of(f'{s}.first_word')}, {s}.first_word)",
        head_is_base=lambda s: f"coalesce({base_of(f'{s}.first_word')} = {s}.first_word, false)",
    )
    found.add(joined=_coordinated)
    found.add(
        extras=_described,
        clause_description=lambda s: f"if(size({s}.joined) > 0, "
        f"{as_instruction(f'{s}.clause', f'{s}.head_base')}, '')",
        clause_verb_end=lambda s: f"char_length({S.group(f'lower({s}.clause)', L.ANY_VERB, 0)})",
    )
    found.replace(
        f"flatten({S.transform(column, _instructions)})",
        "char_start char_end description verb confidence rationale conditional_on optional "
        "wording verb_end",
    )
    if requirements:
        add_requirements(found)
    return found.only(
        f"char_start char_end description verb confidence rationale {'requires ' if requirements else ''}"
        "conditional_on optional"
    ).df


def attached_deadline(action: str, temporal: str) -> str:
    """The earliest cutoff inside the action's span, else the end of a window there."""
    inside = S.keep(
        temporal,
        lambda e: f"{e}.resolved IS NOT NULL AND {action}.char_start <= {e}.char_start "
        f"AND {e}.char_end <= {action}.char_end",
    )

    def choose(xs: str) -> str:
        cutoffs = S.transform(S.keep(xs, lambda e: f"{e}.is_deadline"), lambda e: f"{e}.resolved")
        windows = S.transform(
            S.keep(xs, lambda e: f"{e}.kind = 'window'"),
            lambda e: f"struct({e}.resolved, {e}.char_start, {e}.window_end)",
        )
        return f"coalesce(array_min({cutoffs}), array_min({windows}).window_end)"

    return S.let(inside, choose)


def keywords(text: str) -> str:
    return S.token_set(text, 3, L.KEYWORD_STOP)


def _producers(actions: str) -> str:
    return S.transform(
        S.keep(actions, lambda a: f"{a}.verb = 'obtain'"),
        lambda a: S.struct(id=f"{a}.action_id", words=keywords(f"{a}.description")),
    )


def _dependencies(producers: str, a: str) -> str:
    """Ids of the producers; the first obtaining action that names a word makes it."""
    wanted = f"array_distinct(flatten({S.transform(f'{a}.requires', keywords)}))"

    def producer(word: str) -> str:
        naming = S.keep(producers, lambda p: f"array_contains({p}.words, {word})")
        return f"try_element_at({naming}, 1).id"

    others = S.keep(
        S.transform(wanted, producer), lambda i: f"{i} IS NOT NULL AND {i} != {a}.action_id"
    )
    return f"array_sort(array_distinct({others}))"


def with_actions(
    docs: DataFrame,
    candidates: str = "candidates",
    temporal: str = "temporal",
    column: str = "actions",
    own_deadlines: bool = False,
) -> DataFrame:
    """Candidates as work items: ids in order, class, deadline, effort, dependencies.

    With ``own_deadlines`` a candidate may bring its deadline.
    """

    def deadline(ts: str) -> str:
        found = lambda c: attached_deadline(c, ts)
        return S.transform(candidates, (lambda c: f"coalesce({c}.deadline, {found(c)})") if own_deadlines else found)

    numbered = S.lam(
        lambda c, i: S.struct(
            action_no=f"{i} + 1", action_id=f"concat('action-', {i} + 1)",
            description=f"{c}.description", verb=f"{c}.verb",
            score=cap_score(f"{c}.confidence", "text_confidence"),
            rationale=f"concat({c}.rationale, {ocr_note('source_kind', 'text_confidence')})",
            char_start=f"{c}.char_start", char_end=f"{c}.char_end", deadline=f"_deadlines[{i}]",
            requires=f"{c}.requires", conditional_on=f"{c}.conditional_on",
            optional=f"{c}.optional",
        ),
        2,
    )
    docs = docs.selectExpr("*", f"{S.let(temporal, deadline)} as _deadlines")
    found = Findings(
        docs, column,
        S.let("_deadlines", lambda d: f"transform({candidates}, {numbered})".replace("_deadlines[", f"{d}[")),
        "action_no action_id description verb score rationale char_start char_end deadline "
        "requires conditional_on optional",
    )
    effort = " ".join(f"WHEN '{v}' THEN {d}" for v, d in L.EFFORT_DAYS.items())
    found.add(
        classification=lambda a: classify_confidence(f"{a}.score"),
        effort_days=lambda a: f"CASE {a}.verb {effort} END",
        requires=lambda a: group_phrases(f"{a}.requires"),
    )
    return with_dependencies(found).df.drop("_deadlines")


def with_dependencies(actions: Findings) -> Findings:
    """Adds ``depends_on``: the producers of the words each action requires."""
    actions.df = actions.df.selectExpr("*", f"{_producers(actions.column)} as _producers")
    names = actions.fields
    linked = S.let(
        "_producers",
        lambda ps: S.transform(
            actions.column,
            lambda a: S.struct(**{f: f"{a}.{f}" for f in names}, depends_on=_dependencies(ps, a)),
        ),
    )
    actions.replace(linked, " ".join(names + ["depends_on"]))
    actions.df = actions.df.drop("_producers")
    return actions
