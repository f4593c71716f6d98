"""Folding of every assigned character against the standard library."""

import unicodedata

from docplan.operators import text


def test_every_assigned_character(spark):
    chars = [chr(c) for c in range(0x21, 0x110000)
             if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co", "Cc") and not chr(c).isspace()]
    rows = [("".join(f"{c}\n" for c in chars[i:i + 500]),) for i in range(0, len(chars), 500)]
    df = spark.createDataFrame(rows, "text string").repartition(8)
    wrong = []
    for source, folded in df.selectExpr("text", f"{text.fold_characters('text')} as folded").collect():
        for c, got in zip(source.split("\n"), folded.split("\n"), strict=True):
            expected = text._FOLD.get(c) or unicodedata.normalize("NFKC", c).casefold()
            if got != expected and c not in text._EXTRA_SPACE and got != expected.lower():
                wrong.append((hex(ord(c)) if c else "", got, expected))
    assert wrong == []


def test_foldings_to_several_keep_their_place(spark):
    df = spark.createDataFrame([("Ⅻ. ﷺ ½ 𝐀𝟗 ㎏ straße ﬃ…",)], "text string")
    assert df.selectExpr(f"{text.normalize('text')} as n").first()[0] == (
        "xii. صلى الله عليه وسلم 1⁄2 a9 kg strasse ffi...")
