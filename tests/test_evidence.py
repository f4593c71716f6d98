"""Approximate quotes: threshold, far places, documents told apart."""

import time

from docplan.operators import evidence


def _quotes(spark, *rows):
    return spark.createDataFrame(list(rows), "quote_id int, doc_id int, quote string")


def test_a_quote_at_a_late_place_of_common_words(docs, spark):
    body = "alpha beta words here. " * 80 + "alpha beta gamma signs the deed today."
    quote = "alpha beta gamma sign the deed today"
    out = evidence.anchor_fuzzy(_quotes(spark, (1, 0, quote)), docs(body)).first()
    assert body[out.char_start : out.char_end].startswith("alpha beta gamma signs") and out.score > 0.95
    common = "alpha beta " * 100 + "alpha beta alpha bet"
    late = evidence.anchor_fuzzy(_quotes(spark, (1, 0, "beta alpha bet")), docs(common + " end"))
    assert late.count() <= 1


def test_threshold(docs, spark):
    quotes = _quotes(spark, (1, 0, "bring the signed letter of the uncle"))
    text = docs("Please bring the signed letter of an aunt to the desk.")
    assert evidence.anchor_fuzzy(quotes, text, threshold=0.5).count() == 1
    assert evidence.anchor_fuzzy(quotes, text, threshold=0.99).count() == 0


def test_equal_quote_ids_of_two_documents(docs, spark):
    quotes = _quotes(spark, (1, 0, "walk to the mill"), (1, 1, "walk to the mill"))
    texts = docs("Now walk to the mill.", "Nothing of the kind.")
    proposals = quotes.selectExpr("quote_id", "doc_id", "'action' as kind")
    rows = evidence.verify_proposals(proposals, evidence.anchored(quotes, texts)).collect()
    assert {r.doc_id: r.outcome for r in rows} == {0: "verified", 1: "hallucinated"}


def test_spans_by_counted_tokens_are_those_of_all_tokens_folded(spark):
    texts = [
        "", "  a  b\n\n c", "Größe und ﬁne Worte", "ein Maß…", "of the co-\noperative", "x­y z", "dia ¨ cri", "İstanbul Ort",
        "tab\tand wide gap \U0001d400lpha 𝟙 end", "well- \n known", "ﬃ ﬃ Straße", "A" * 50 + "ß" + " b" * 40,
    ]
    df = spark.createDataFrame([(text,) for text in texts], "text string").selectExpr("text", f"{evidence.normalize('text')} as hay")
    spans = "transform(sequence(0, char_length(hay) - 1), i -> struct(i as lo, least(i + 3, char_length(hay)) as hi))"
    df = df.where("hay != ''").selectExpr("*", f"{spans} as spans").localCheckpoint()
    counted = df.where(f"NOT {evidence.S.has('text', evidence.UNEVEN)}")
    assert counted.count() >= 7 and df.count() - counted.count() >= 4
    for row in counted.selectExpr("text", f"{evidence._by_counted_tokens('text', 'hay', 'spans')} as a",
                                  f"{evidence._by_folded_tokens('text', 'spans')} as b").collect():
        assert row.a == row.b, row.text


def test_quotes_in_even_texts_fold_few_tokens(docs, spark):
    texts = docs(*[f"Nummer {i} größer " + "alle Wörter über die Straße " * 400 for i in range(100)])
    df = texts.selectExpr("text", f"{evidence.normalize('text')} as hay", "array(struct(60 as lo, 70 as hi)) as spans").localCheckpoint()

    def seconds(spans: str) -> float:
        begin = time.time()
        df.selectExpr(f"{spans} as p").write.format("noop").mode("overwrite").save()
        return time.time() - begin

    seconds(evidence.source_spans("text", "hay", "spans"))
    assert seconds(evidence.source_spans("text", "hay", "spans")) < seconds(evidence._by_folded_tokens("text", "spans"))
