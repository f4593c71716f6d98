"""Texts that several documents share, analysed once.

An analysis depends on a document's text and what is known of its source, never on its id, and circulars
are handed out again in the same words. `distinct_texts` leaves one row for each text with the ids of its
documents, `per_document` gives every document its rows back. Nothing is left out: a corpus without repeated
texts keeps all its rows and pays one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.functions.storage import settled
from docplan.plans.analysis import analyse
from docplan.sources.notices import spread

#: About as many documents as one row names; the ids of a text that more documents share are dealt to several rows.
DOCUMENTS = 10_000


def distinct_texts(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """The distinct rows of all columns but ``doc_id``, each with the ``doc_ids`` that it stands for."""
    others = [c for c in docs.columns if c != "doc_id"]
    keyed = docs.withColumn("_key", F.xxhash64(*others))
    # few: at most one in so many documents
    crowded = keyed.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > documents)
    dealt = keyed.join(F.broadcast(crowded), "_key", "left").withColumn(
        "_part", F.expr(f"pmod(xxhash64(doc_id), coalesce(_n div {documents} + 1, 1L))"))
    return dealt.groupBy(*others, "_part").agg(F.collect_list(F.struct("doc_id")).alias("doc_ids")).drop("_part")


def per_document(rows: DataFrame) -> DataFrame:
    """Rows of distinct texts as rows of their documents."""
    others = [c for c in rows.columns if c != "doc_ids"]
    return rows.selectExpr("explode(doc_ids) as _d", *others).selectExpr("_d.doc_id", *others)


def distinct_versions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Documents in both tables: the distinct pairs of their texts, numbered and written once, with ``doc_ids``."""

    def packed(docs: DataFrame, name: str) -> DataFrame:
        return docs.select("doc_id", F.struct("text", "text_confidence", "source_kind").alias(name))

    pairs = settled(distinct_texts(packed(previous, "was").join(packed(current, "now"), "doc_id")))
    return pairs.withColumn("pair", F.monotonically_increasing_id())


def analysed_versions(versions: DataFrame, today: str, *columns: str) -> DataFrame:
    """``doc_ids`` with the columns asked for of both versions' analyses, as structs ``p`` and ``c``."""

    def analysed(version: str, name: str) -> DataFrame:
        texts = spread(versions.select("pair", f"{version}.*", *(["doc_ids"] if version == "was" else [])), "pair")
        kept = ["pair", "doc_ids"] if version == "was" else ["pair"]
        return analyse(texts, today).select(*kept, F.struct(*columns).alias(name))

    return analysed("was", "p").join(analysed("now", "c"), "pair").drop("pair")
