"""SQL expression helpers shared by every extraction operator.

Findings live in the row of their document: each helper turns the SQL text of
a string expression into the SQL text of an array-of-structs expression. A
whole corpus is therefore analysed by narrow projections, and one document
never has to be regrouped after a shuffle. Expressions are kept as SQL text
because building the same trees call by call costs seconds per query.

Offsets are 0-based, half-open and count code points of the raw text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import count

#: Marks around matches: two code points that Unicode keeps out of all texts. They stand in no text
#: that is valid for interchange, so what they enclose is the source unchanged.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
SPAN_TYPE = "struct<char_start:int,char_end:int,text:string>"
_names = count(1)


def lit(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(items: Iterable[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def words(values: Sequence[str]) -> str:
    return array(lit(v) for v in values)


def lam(body: Callable[..., str], arity: int = 1) -> str:
    """A SQL lambda with fresh variable names."""
    names = [f"v{next(_names)}" for _ in range(arity)]
    head = names[0] if arity == 1 else "(" + ", ".join(names) + ")"
    return f"{head} -> {body(*names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Catalyst may inline a projected column into a lambda, where it would be
    recomputed for each element; binding it to a lambda variable prevents that.
    """
    return f"transform(array({value}), {lam(body)})[0]"


def let_all(values: Sequence[str], body: Callable[..., str]) -> str:
    """``let`` for several values that do not depend on each other."""
    packed = ", ".join(f"'f{i}', {v}" for i, v in enumerate(values))
    return let(
        f"named_struct({packed})", lambda p: body(*[f"{p}.f{i}" for i in range(len(values))])
    )


def empty(element_type: str) -> str:
    return f"cast(array() as array<{element_type}>)"


def transform(xs: str, body: Callable[[str], str]) -> str:
    return f"transform({xs}, {lam(body)})"


def keep(xs: str, condition: Callable[[str], str]) -> str:
    return f"filter({xs}, {lam(condition)})"


def any_of(xs: str, condition: Callable[[str], str]) -> str:
    return f"exists({xs}, {lam(condition)})"


def when(*pairs: tuple[str, str], otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN {c} THEN {v}" for c, v in pairs)
    return f"CASE {arms} ELSE {otherwise} END"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def ordered_fold(
    items: str,
    state: str,
    step: Callable[[str, str], tuple[str, str]],
    emit_type: str,
) -> str:
    """Left fold that carries ``state`` and emits zero or more values per item.

    ``step(state, item)`` returns ``(new_state, array_of_emitted)``. The fold
    runs over blocks of about sqrt(n) items, because appending to one growing
    array would copy it n times.
    """

    def advance(acc: str, x: str) -> str:
        new_state, emitted = step(f"{acc}.state", x)
        return struct(state=new_state, out=f"concat({acc}.out, {emitted})")

    def run(xs: str, st: str) -> str:
        init = struct(state=st, out=empty(emit_type))
        return f"aggregate({xs}, {init}, {lam(advance, 2)})"

    def next_block(acc: str, block: str) -> str:
        return let(
            run(block, f"{acc}.state"),
            lambda r: struct(state=f"{r}.state", out=f"concat({acc}.out, array({r}.out))"),
        )

    def whole(xs: str) -> str:
        width = f"greatest(16, cast(ceil(sqrt(size({xs}))) as int))"
        blocks = let(
            width,
            lambda b: transform(f"sequence(1, size({xs}), {b})", lambda i: f"slice({xs}, {i}, {b})"),
        )
        init = struct(state=state, out=empty(f"array<{emit_type}>"))
        folded = f"flatten(aggregate({blocks}, {init}, {lam(next_block, 2)}).out)"
        return when((f"size({xs}) > 0", folded), otherwise=empty(emit_type))

    return let(items, whole)


def running_starts(lengths: str) -> str:
    """Exclusive prefix sums of an int array; a short one is appended to in place of folded in blocks."""
    grow = lam(lambda sums, x: f"array_append({sums}, element_at({sums}, -1) + {x})", 2)
    return let(lengths, lambda xs: when(
        (f"size({xs}) BETWEEN 1 AND {_SHORT}", f"slice(aggregate({xs}, array(0), {grow}), 1, size({xs}))"),
        otherwise=ordered_fold(xs, "0", lambda st, x: (f"{st} + {x}", f"array({st})"), "int")))


#: Arrays of at most this many elements are worked through in full where a longer one needs a search or blocks.
_SHORT = 32
#: Steps of a binary search over an array of any length.
_STEPS = array(str(1 << k) for k in range(29, -1, -1))


def last_begun(starts: str, offset: str) -> str:
    """Place of the last of some ascending starts at or before an offset, -1 if there is none."""
    step = lam(lambda n, w: f"if(coalesce(get({starts}, {n} + {w} - 1) <= {offset}, false), {n} + {w}, {n})", 2)
    begun = keep(starts, lambda s: f"{s} <= {offset}")
    return when((f"size({starts}) <= {_SHORT}", f"size({begun}) - 1"), otherwise=f"(aggregate({_STEPS}, 0, {step}) - 1)")


def mark(text: str, pattern: str, close: str = OPEN) -> str:
    """Wrap every match of ``pattern`` in marks, of one kind unless the closing one has to be told apart."""
    clean = f"replace(replace({text}, {lit(OPEN)}, {lit('�')}), {lit(CLOSE)}, {lit('�')})"
    return f"regexp_replace({clean}, {lit(pattern)}, {lit(OPEN + '$0' + close)})"


def segments(marked: str) -> str:
    """Cut marked text: even positions lie between matches, odd are matches.

    The marks are of one kind, as a single character is split at without compiling a pattern per row.
    """
    return f"split({marked}, {lit(OPEN)}, -1)"


def spans_of(marked: str, which: int = 1) -> str:
    """Spans of the odd (``which=1``) or even (``which=0``) segments."""

    def build(segs: str) -> str:
        lengths = transform(segs, lambda s: f"char_length({s})")
        return let(
            running_starts(lengths),
            lambda starts: transform(
                f"sequence({which}, size({segs}) - 1, 2)",
                lambda i: struct(
                    char_start=f"{starts}[{i}]",
                    char_end=f"{starts}[{i}] + char_length({segs}[{i}])",
                    text=f"{segs}[{i}]",
                ),
            ),
        )

    def single(segs: str) -> str:
        start = f"char_length({segs}[0])"
        return array([struct(
            char_start=start, char_end=f"{start} + char_length({segs}[1])", text=f"{segs}[1]")])

    return let(
        segments(marked),
        lambda segs: when(
            *([(f"size({segs}) = 3", single(segs))] if which else []),
            (f"size({segs}) > {which}", build(segs)), otherwise=empty(SPAN_TYPE)),
    )


def find_all(text: str, pattern: str) -> str:
    """All non-overlapping matches of ``pattern`` with their offsets.

    Texts without a match pay for one regex test only.
    """
    return when((has(text, pattern), spans_of(mark(text, pattern))), otherwise=empty(SPAN_TYPE))


def has(text: str, pattern: str) -> str:
    return f"rlike({text}, {lit(pattern)})"


def group(text: str, pattern: str, index: int) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {index})"


def replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)})"


def after(text: str, offset: str) -> str:
    """The text from a 0-based offset on."""
    return f"substring({text}, ({offset}) + 1)"


def strip(text: str, chars: str | None = None) -> str:
    """Trim whitespace, or the given characters, from both ends."""
    if chars is not None:
        return f"btrim({text}, {lit(chars)})"
    return replace(text, r"(?U)\A\s+|\s+\z", "")


def rstrip(text: str, chars: str) -> str:
    return f"trim(TRAILING {lit(chars)} FROM {text})"


def flat(text: str) -> str:
    """Collapse every whitespace run to one space and trim; a single space stays as it is."""
    return f"btrim({replace(text, r'(?U)(?=[^!-~])(?:[\s&&[^ ]]\s*| \s+)', ' ')})"


def upper_first(text: str) -> str:
    return f"concat(upper(left({text}, 1)), substring({text}, 2))"


def lower_first(text: str) -> str:
    return f"concat(lower(left({text}, 1)), substring({text}, 2))"


def head_of(text: str, pattern: str) -> str:
    """What precedes the first match of ``pattern`` (all of it if none).

    Replacing keeps its compiled pattern from row to row, splitting compiles it anew.
    """
    return replace(text, rf"(?:{pattern})(?s:.*)", "")


def overlaps(a0: str, a1: str, b0: str, b1: str, ratio: float) -> str:
    """Whether two spans share at least ``ratio`` of the shorter one."""
    shared = f"(least({a1}, {b1}) - greatest({a0}, {b0}))"
    shortest = f"least({a1} - {a0}, {b1} - {b0})"
    return (
        f"({shared} > 0 AND {shortest} > 0 AND "
        f"{shared} / cast(greatest({shortest}, 1) as double) >= {lit(ratio)})"
    )


def token_set(text: str, minimum: int, stop: Sequence[str]) -> str:
    """Distinct lower-case words of at least ``minimum`` letters, minus ``stop``."""
    found = f"regexp_extract_all(lower({text}), {lit('([a-z]{%d,})' % minimum)}, 1)"
    return f"array_sort(array_except({found}, {words(stop)}))"


def first_per_key(items: str, key: Callable[[str], str]) -> str:
    """Keep the first item of each key, in order."""

    def over(xs: str, ks: str) -> str:
        pick = lam(lambda x, i: f"array_position({ks}, {ks}[{i}]) = {i} + 1", 2)
        return f"filter({xs}, {pick})"

    return let(items, lambda xs: let(transform(xs, key), lambda ks: over(xs, ks)))


def human_date(value: str) -> str:
    return f"date_format({value}, 'dd MMMM yyyy')"


def days(n: str) -> str:
    return f"concat(cast({n} as string), if({n} = 1, ' day', ' days'))"


def percent(value: str) -> str:
    """Whole percent, ties to even, as a printf of ``.0%`` gives."""
    return f"concat(cast(cast(bround({value} * 100) as int) as string), '%')"
