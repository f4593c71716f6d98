"""Proposals held to the text, merged with the rules' findings; quotes found by any of their words."""

import difflib
import random

import numpy as np
import pytest

from docplan.operators import evidence
from docplan.operators.text import normalize_text
from docplan.plans.analysis import analyse

TEXT = "CIRCULAR\n\nMembers must upload the bonafide certificate by 3 May 1998.\n\nThe annual fair opens at noon on the lawn. Bring a hat.\n"


def analysed(spark, *responses, text=TEXT):
    docs = spark.createDataFrame([(k, text, r) for k, r in enumerate(responses)], "doc_id int, text string, response string")
    return analyse(docs.selectExpr("*", "0.9D as text_confidence", "'plain_text' as source_kind"), "date'1998-01-01'", proposals="response")


def test_fates_of_proposals(spark):
    response = """{"actions": [
      {"instruction": "Visit the fair", "verb": "attend", "quote": "The ANNUAL fair opens  at noon", "deadline_id": "date-1", "optional": true},
      {"instruction": "Upload it", "verb": "submit", "quote": "must upload the bonafide certificate"},
      {"instruction": "Invented", "verb": "submit", "quote": "Pay the moon in advance to the clerk"},
      {"instruction": "Wear it", "verb": "prepare", "quote": "bring the hats", "deadline_id": "date-7", "conditional_on": "if it is sunny"}],
      "gaps": [{"question": "Which lawn is it?", "quote": "on the lawn"}, {"question": "none", "quote": "under the sea"}],
      "requirements": [{"text": "Sun hat", "quote": "Bring a hat"}]}"""
    row = analysed(spark, response).first()
    assert row.verification.asDict() == {"proposed": 7, "hallucinated": 2, "demoted": 1, "rate": 2 / 7}
    assert [(a.description, a.score, str(a.deadline)) for a in row.actions] == [
        ("Upload the bonafide certificate by 3 May 1998", 0.9, "1998-05-03"), ("Visit the fair", 0.86, "1998-05-03"), ("Wear it", 0.55, "None")]
    assert row.actions[1].rationale.endswith("Attached to the stated date of 1998-05-03. The document offers this rather than requiring it.")
    assert "only approximately (" in row.actions[2].rationale and row.actions[2].rationale.endswith("Applies only if it is sunny.")
    assert TEXT[row.actions[1].char_start : row.actions[1].char_end] == "The annual fair opens at noon"
    assert [g.question for g in row.gaps] == ["Which lawn is it?"] and "Sun hat" in [r.text for r in row.requirements]


def test_responses_and_texts_that_say_nothing(spark):
    silent = [None, "", "not json", '{"actions": [', '{"actions": [{"verb": "dance", "quote": "Bring a hat", "instruction": "x"}]}',
              '{"actions": [{"verb": null, "quote": null}]}', "{}", '{"actions": null}']
    asks = '{"gaps": [{"question": "q", "quote": "z"}, {"question": "q", "quote": ""}]}'
    rows = [(TEXT, r) for r in silent] + [(t, asks) for t in (None, "", " \n")]
    docs = spark.createDataFrame([(k, t, r) for k, (t, r) in enumerate(rows)], "doc_id int, text string, response string")
    out = analyse(docs.selectExpr("*", "0.9D as text_confidence", "'plain_text' as source_kind"), "date'1998-01-01'", proposals="response")
    for r in out.select("doc_id", "verification", "actions").collect():
        told = r.verification.asDict()
        assert (told["proposed"], told["hallucinated"], len(r.actions)) == ((0, 0, 1) if r.doc_id < len(silent) else (2, 2, 0))


def test_alignment_equals_the_library_on_small_strings():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b)]
        got = 2 * sum(k for _, k in evidence.aligned_blocks(*codes)) / (len(a) + len(b))
        assert got == pytest.approx(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_a_change_in_each_of_the_rarest_words_is_found(spark):
    body = "the road to the mill is closed for the works of the bridge " * 30
    text = body + "the zealous quartermaster inspects the vaulted granary of the priory on the morrow " + body
    quote = "the zealos quartermastr inspect the vaultd granry of the pryory on the morow"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    quotes = spark.createDataFrame([(1, 1, quote), (2, 1, "a wholly different clause about nobody")], "quote_id int, doc_id int, quote string")
    rows = evidence.anchor_fuzzy(quotes, docs).collect()
    assert [r.quote_id for r in rows] == [1] and rows[0].score > 0.8
    assert rows[0].char_start == len(body) and text[rows[0].char_start : rows[0].char_end].startswith("the zealous quartermaster")


def test_best_places_equal_brute_force(spark):
    """Over all windows that put some word of the quote in place, the best similarity is found."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("mo", "ta", "rel", "sun") for b in ("ra", "dic", "n", "poly")]
    rows = []
    for k in range(25):
        text = " ".join(rng.choice(words) for _ in range(60))
        at = rng.randrange(40)
        quote = text.split()[at : at + 8]
        quote[rng.randrange(8)] = "other"
        rows.append((k, " ".join(text.split()), " ".join(quote)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id int, text string")
    assert all(r.normalized == t for r, (_, t, _) in zip(normalize_text(docs).orderBy("doc_id").collect(), rows))
    quotes = spark.createDataFrame([(k, k, q) for k, _, q in rows], "quote_id int, doc_id int, quote string")
    got = {r.quote_id: r.score for r in evidence.anchored(quotes, docs).collect()}
    for k, text, quote in rows:
        best, size = 0, max(len(quote), int(len(quote) * 1.35))
        for start in range(len(text)) if quote not in text else ():
            window = text[start : start + size]
            if any(text.startswith(w, start + quote.index(w)) for w in quote.split()):
                best = max(best, difflib.SequenceMatcher(None, quote, window, autojunk=False).ratio())
        assert quote in text or got.get(k, 0) >= round(best, 4) * (best >= 0.72) - 1e-9


def by_pairs(rules, proposals):
    kept, out = [tuple(r) for r in rules], []
    for lo, hi in proposals:
        clash = any(min(hi, b) - max(lo, a) > 0 and min(hi - lo, b - a) > 0 and 2 * (min(hi, b) - max(lo, a)) >= min(hi - lo, b - a) for a, b in kept)
        out.append(not clash)
        kept += [] if clash else [(lo, hi)]
    return out


@pytest.mark.parametrize("width", [4, 12, 40])
def test_sweep_equals_all_pairs(width):
    rng = random.Random(width)
    for _ in range(400):
        r, p = (np.array([(s := rng.randrange(60), s + rng.randrange(w)) for _ in range(n)], np.int64).reshape(-1, 2)
                for n, w in ((rng.randrange(8), 12), (rng.randrange(14), width)))
        assert evidence.kept_proposals(r, p).tolist() == by_pairs(r.tolist(), p.tolist())
