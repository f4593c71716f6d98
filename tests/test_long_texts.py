"""Clauses and sentences looked up by place: equal to cutting the text anew for every match, and in linear time."""

import random
import re
import time

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.operators import eligibility, temporal

TODAY = "date'2026-09-01'"


def test_last_begun(spark):
    starts = sorted(random.Random(2).sample(range(500), 77))
    df = spark.createDataFrame([(starts, p) for p in range(-2, 503)], "xs array<int>, p int")
    got = [r[0] for r in df.selectExpr(S.last_begun("xs", "p")).collect()]
    assert got == [sum(s <= p for s in starts) - 1 for p in range(-2, 503)]
    assert spark.sql(f"select {S.last_begun('cast(array() as array<int>)', '4')}").first()[0] == -1


def passages(rng, n):
    bits = ["pay before", "last date", "the hall opens on", "closing", "4 March 2026", "12/05/2026", "June 3",
            "9 April", ",", ";", ":", ".", "\n\n", "\n \t\n", "\n", "deadline", "rooms", "ends", "é𝒳"]
    return [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def framed(text, at):
    before = re.split(L.CLAUSE_BREAK, text[:at])[-1]
    after = re.split(L.CLAUSE_BREAK, text[at:])[0]
    cue = L.DEADLINE_CUE.replace("(?iU)", "(?i)").replace("(?U)", "")
    return bool(re.search(cue, before) or re.search(cue, after))


def test_cues_equal_cutting_the_text(spark, docs):
    texts = passages(random.Random(11), 300)
    rows = temporal.extract_temporal(docs(*texts), TODAY).where("kind = 'absolute'").collect()
    assert len(rows) > 500 and {r.is_deadline for r in rows} == {True, False}
    wrong = [r for r in rows if r.is_deadline != framed(texts[r.doc_id], r.char_start)]
    assert wrong == []


def test_degrees_in_sentences_of_eligibility(spark, docs):
    rng = random.Random(3)
    bits = ["MBA", "BCA", "must have", "eligible", "hall", ".", "\n", "B.Tech", "open to", "rooms"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    marker = L.ELIGIBILITY_MARKER.replace("(?iU)", "(?i)")

    def speaks(text, at):
        before = re.split(r"[.\n]", text[:at])[-1]
        return bool(re.search(marker, before + re.match(r"[^.\n]*[.\n]?", text[at:]).group()))

    found = S.find_all("text", L.PROGRAMME_DEGREE)
    rows = docs(*texts).selectExpr(
        "doc_id", f"{found}.char_start as every", f"{eligibility._in_eligibility_sentences('text', found)}.char_start as kept").collect()
    assert all(r.kept == [at for at in r.every if speaks(texts[r.doc_id], at)] for r in rows)
    assert 0 < sum(len(r.kept) for r in rows) < sum(len(r.every) for r in rows)


def seconds(counted, text, docs):
    df = counted(docs(text))
    df.collect()
    start = time.time()
    df.collect()
    return time.time() - start


def test_time_is_linear(spark, docs):
    piece = "Pay before 4 March 2026, eligible students of MBA. Rooms open on 12/05/2026; closing 9 April.\n"

    def dates(df):
        return temporal.with_temporal(df, TODAY).selectExpr("size(filter(temporal, t -> t.is_deadline)) as n")

    def degrees(df):
        return df.selectExpr(f"size({eligibility.domicile_programme_criteria('text')}) as n")

    for counted in (dates, degrees):
        short, long = (min(seconds(counted, piece * n, docs) for _ in range(2)) for n in (1500, 3000))
        assert long < 2.6 * short + 0.5, (short, long)
