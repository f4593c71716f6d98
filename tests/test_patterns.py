"""Patterns told apart by their first character: equal to the plain ones, and compiled once, not per row."""

import random
import re
import time

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.operators.actions import with_candidates
from docplan.operators.text import sentences

BEGUN = re.compile(r"\(\?=\(\?-i:\[[^\]]*\]\)\)(?:\(\?<!\(\?-i:\[A-Za-z\]\)\))?")


def begun_patterns():
    found = [v for v in vars(L).values() if isinstance(v, str)]
    found += [p for _, p in L.OBLIGATION_TIERS] + [p for p, _, _ in L.GAP_RULES]
    return sorted({p for p in found if BEGUN.search(p)})


def passages(n):
    rng = random.Random(4)
    bits = re.findall(r"[A-Za-z]+", " ".join(begun_patterns()) + " " + L.longest_first(f for f, _, _ in L.VERB_FORMS))
    bits += ["4 March 2026", "12/05/2026", "75%", "8.5", "first-year", ",", ".", "\n", "K", "ſhall", "ıs", "İs", "é𝒳", "2nd year"]
    return [rng.choice([" ", " ", "-"]).join(rng.choice([str, str.upper, str.title])(rng.choice(bits))
                                             for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_first_characters_lose_no_match(spark):
    df = spark.createDataFrame([(t,) for t in passages(4000)], "text string").repartition(8)
    patterns = begun_patterns()
    assert len(patterns) > 30
    marks = [S.mark("text", p) for p in patterns]
    plain = [S.mark("text", BEGUN.sub("", p).replace(L.VERB_ALT, L.longest_first(f for f, _, _ in L.VERB_FORMS)))
             for p in patterns]
    got = df.selectExpr(*[f"sum(int({a} != {b})) as d{i}" for i, (a, b) in enumerate(zip(marks, plain))]).first()
    assert not any(got), [p for p, d in zip(patterns, got) if d]


def test_head_equals_splitting(spark):
    df = spark.createDataFrame([(t,) for t in passages(3000) + ["", ", and sign"]], "text string").repartition(8)
    for p in (L.COORDINATED_VERB, L.COORDINATED_END, L.TRAILING_CLAUSE, L.OBJECT_END, L.REQUIREMENT_CUE):
        assert df.where(f"{S.head_of('text', p)} != split(text, {S.lit(p)}, 2)[0]").count() == 0


def test_head_compiles_once(spark):
    rows = spark.range(0, 60000, 1, 2).selectExpr("concat('Collect the form, sign it and return it by ', id) as text")

    def seconds(expression):
        start = time.perf_counter()
        rows.selectExpr(f"sum(length({expression})) as n").collect()
        return time.perf_counter() - start

    head, test = S.head_of("text", L.COORDINATED_VERB), f"string({S.has('text', L.COORDINATED_VERB)})"
    seconds(head), seconds(test)
    assert min(seconds(head) for _ in range(3)) < 2 * min(seconds(test) for _ in range(3)) + 0.3


def test_flat_and_trimmed_as_before(spark):
    rng = random.Random(8)
    bits = ["a", "Pay", ".", " ", " ", "  ", "\n", "\n\n", "\t", " ", " ", "b!", "(c", "1.", "Dr", "No."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    plain = S.replace("text", r"(?U)\s+", " ")
    assert df.where(f"{S.flat('text')} != btrim({plain})").count() == 0
    found = df.selectExpr("text", f"explode({sentences('text')}) as s")
    assert found.count() > 3000
    wrong = f"s.text != {S.replace('s.text', r'(?U)\A\s+|\s+\z', '')} OR substring(text, s.char_start + 1, char_length(s.text)) != s.text"
    assert found.where(wrong).count() == 0
    boundary = r"(?U)(?<=[.!?;])\s+(?=[A-Z(])|\n(?=\s*(?:\d+[.)]|[-•*]))|\n{2,}"
    assert df.where(f"{S.mark('text', boundary)} != {S.mark('text', L.SENTENCE_BOUNDARY)}").count() == 0


def test_unread_requirements_are_not_computed(docs):
    texts = docs("Deposit the form along with the resume before 4 March 2026. Sign the form and upload it.")
    full, short = with_candidates(texts), with_candidates(texts, requirements=False)
    for name in ("description", "verb", "optional", "rationale"):
        assert full.selectExpr(f"candidates.{name}").first() == short.selectExpr(f"candidates.{name}").first()
    assert "requires" not in short.schema["candidates"].dataType.elementType.names
    assert L.REQUIREMENT_CUE not in short._jdf.queryExecution().optimizedPlan().toString()
