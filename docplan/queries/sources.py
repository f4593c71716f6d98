"""Queries over ingestion and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from docplan.functions import spans as S
from docplan.functions.rows import table_of
from docplan.operators import evidence as M
from docplan.plans.analysis import with_dates
from docplan.queries.expected import with_expected
from docplan.queries.registry import register
from docplan.sources import ingest as I
from docplan.sources.notices import TODAY, plain_notices


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


# --- uploads, pages, OCR ----------------------------------------------------


@register("SELECT doc_id, length(text) AS n_chars FROM documents WHERE trim(text) <> ''")
def read_notices(spark, sf):
    return I.read_notices(spark, f"{sf}/documents.parquet").selectExpr(
        "doc_id", "char_length(text) as n_chars")


#: Prefixes in hex and what triage makes of the text behind them.
_HEADERS = (
    ("255044462D", "pdf"), ("89504E470D0A1A0A", "image/PNG"), ("FFD8FF", "image/JPEG"),
    ("49492A00", "image/TIFF"), ("4D4D002A", "image/TIFF"), ("424D", "image/BMP"),
    ("524946460000000057454250", "image/WEBP"), ("00", "binary"), ("EFBBBF", "text/utf-8"),
    ("", "text/utf-8"),
)


def _uploads(spark, sf):
    arms = " ".join(f"WHEN {i} THEN unhex('{h}')" for i, (h, _) in enumerate(_HEADERS))
    return _documents(spark, sf).selectExpr(
        "doc_id",
        f"CASE WHEN doc_id % 12 = 10 THEN concat(unhex('FFFE'), encode(text, 'UTF-16LE')) "
        "WHEN doc_id % 12 = 11 THEN encode('caf\\u00e9 and more plain words', 'ISO-8859-1') "
        f"ELSE concat(CASE doc_id % 12 {arms} END, encode(text, 'UTF-8')) END as content")


_KINDS = "CASE doc_id % 12 " + " ".join(
    f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_HEADERS)
) + " WHEN 10 THEN 'text/utf-16' ELSE 'text/single-byte' END"


@register(f"""
SELECT doc_id, {_KINDS} AS kind, CASE WHEN {_KINDS} = 'binary' THEN
  'looks like a binary format this engine cannot read' ELSE '' END AS refusal FROM documents""")
def triage_uploads(spark, sf):
    return I.triage_uploads(_uploads(spark, sf)).selectExpr(
        "doc_id", "kind", "coalesce(refusal, '') as refusal")


@register("""
SELECT doc_id, CASE WHEN doc_id % 12 = 11 THEN
  'café and more plain words' ELSE text END AS text FROM documents WHERE doc_id % 12 IN (8, 9, 10, 11)""")
def decode_text(spark, sf):
    return I.triage_uploads(_uploads(spark, sf)).where("startswith(kind, 'text/')").select(
        "doc_id", "text")


@register(r"""
SELECT doc_id, regexp_replace(regexp_replace(replace(replace(concat('a', chr(13), chr(10), text, '  ',
  chr(13), chr(10), chr(10), chr(10), 'b'), concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)),
  '[ \t]+\n', chr(10), 'g'), '\n{3,}', concat(chr(10), chr(10)), 'g') AS text FROM documents""")
def tidy_text(spark, sf):
    untidy = "concat('a\\r\\n', text, '  \\r\\n\\n\\nb')"
    return _documents(spark, sf).selectExpr("doc_id", f"{I.tidy(untidy)} as text")


def _conversation_pages(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "conv_id as doc_id", "cast(turn + 1 as int) as page", "text")


_BOUNDS = """
SELECT conv_id AS doc_id, turn + 1 AS page, text, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY
  conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS char_start
FROM conversations"""


@register("""
SELECT conv_id AS doc_id, string_agg(text, concat(chr(10), chr(10)) ORDER BY turn) AS text,
  count(*) AS pages FROM conversations GROUP BY conv_id""")
def assemble_pages(spark, sf):
    return I.assemble_pages(_conversation_pages(spark, sf)).selectExpr(
        "doc_id", "text", "size(pages) as pages")


@register(f"""
SELECT doc_id, CAST(char_start + unnest([0, length(text) - 1]) AS INT) AS char_offset, page
FROM ({_BOUNDS}) WHERE length(text) > 0""")
def page_for_offset(spark, sf):
    """Pages of the first and the last character of every page."""
    docs = I.assemble_pages(_conversation_pages(spark, sf))
    starts = table_of(docs, "pages", "doc_id").where("char_end > char_start")
    offsets = starts.selectExpr("doc_id", "explode(array(char_start, char_end - 1)) as char_offset")
    return I.page_for_offset(offsets, docs)


@register("""
WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id,
  string_split_regex(text, ' ') AS ws FROM documents)),
r AS (SELECT doc_id, i, word, i // 9 AS line, CASE WHEN i % 7 = 0 THEN -1 ELSE 50 + i % 50 END AS conf
  FROM w WHERE trim(word) <> '')
SELECT doc_id, round(coalesce(avg(conf) FILTER (WHERE conf >= 0) / 100, 0), 4) AS confidence,
  (SELECT string_agg(l, chr(10) ORDER BY line) FROM (SELECT line, string_agg(word, ' ' ORDER BY i) AS l
    FROM r s WHERE s.doc_id = r.doc_id GROUP BY line)) AS text FROM r GROUP BY doc_id""")
def ocr_words_to_pages(spark, sf):
    """Documents cut into word boxes, nine to a line, and put together again."""
    words = _documents(spark, sf).selectExpr("doc_id", "posexplode(split(text, ' ')) as (i, word)")
    boxes = words.selectExpr(
        "doc_id", "1 as page", "i as word_no", "1 as block", "1 as par",
        "cast(i div 9 as int) as line", "word",
        "cast(if(i % 7 = 0, -1, 50 + i % 50) as double) as conf")
    return I.ocr_words_to_pages(boxes).select("doc_id", "text", "confidence")


@register("""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS t,
  text AS ocr, (conv_id % 10) / 10.0 AS conf FROM conversations),
q AS (SELECT *, length(trim(t)) < 24 AS sparse, length(trim(t)) < 24 AND trim(ocr) <> '' AND conf >= 0.45
  AS usable FROM p),
f AS (SELECT *, CASE WHEN usable THEN ocr ELSE t END AS body FROM q)
SELECT doc_id, CASE WHEN bool_and(sparse) THEN 'scanned_pdf' ELSE 'native_pdf' END AS source_kind,
  CAST(coalesce(round(avg(conf) FILTER (WHERE usable), 4), 1) AS DOUBLE) AS text_confidence,
  count(*) FILTER (WHERE length(trim(body)) < 24) AS unread
FROM f GROUP BY doc_id HAVING bool_or(trim(body) <> '')""")
def ocr_rollup(spark, sf):
    reads = spark.read.parquet(f"{sf}/conversations.parquet").selectExpr(
        "conv_id as doc_id", "cast(turn + 1 as int) as page",
        "if(turn % 3 = 0, '', text) as native_text", "text as ocr_text",
        "cast(conv_id % 10 as double) / 10 as ocr_conf")
    return I.ocr_rollup(reads).selectExpr(
        "doc_id", "source_kind", "text_confidence", "size(pages_needing_ocr) as unread")


@register("SELECT doc_id, sha256(text) AS content_hash, left(sha256(text), 16) AS document_id FROM documents")
def fingerprint(spark, sf):
    return I.fingerprint(_documents(spark, sf))


@register("""
SELECT doc_id, sha256(text) AS content_hash, copies, first_doc_id FROM (SELECT *, count(*) OVER
  (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS first_doc_id FROM documents)
WHERE copies > 1""")
def reuploads(spark, sf):
    return I.reuploads(_documents(spark, sf))


# --- evidence ---------------------------------------------------------------


def _quotes(spark, sf):
    """Per document: words 3-10 respaced and upper-cased, and words nobody wrote."""
    words = "slice(split(text, ' '), 3, 8)"
    docs = _documents(spark, sf)
    return docs.selectExpr(
        "doc_id", "explode(array(struct(doc_id * 2 as quote_id, "
        f"concat('  ', upper(array_join({words}, '  \\n'))) as quote), struct(doc_id * 2 + 1 as "
        f"quote_id, concat(array_join({words}, ' '), ' zzqx') as quote))) as q"
    ).select("q.quote_id", "doc_id", "q.quote")


@register("""
SELECT doc_id * 2 AS quote_id, doc_id, 1.0::DOUBLE AS score FROM documents
WHERE len(string_split(text, ' ')) >= 3""")
def anchor_exact(spark, sf):
    return M.anchor_exact(_quotes(spark, sf), _documents(spark, sf)).select(
        "quote_id", "doc_id", "score")


@register()
def anchor_exact_spans(spark, sf):
    """Where the benchmark-like slices stand in their source."""
    return M.anchor_exact(_quotes(spark, sf), _documents(spark, sf))


def _notice_quotes(spark, sf):
    """Quotes from notices: verbatim, with a word dropped, or invented."""
    return plain_notices(spark, sf).selectExpr(
        "doc_id", "doc_id as quote_id",
        "CASE WHEN doc_id % 5 = 4 THEN 'Bring a signed bond of the zonal registrar within a fortnight' "
        "WHEN doc_id % 5 = 3 THEN replace(substring(text, 1, 90), ' the ', ' ') "
        "ELSE upper(substring(text, 1, 60)) END as quote")


@register()
def anchor_fuzzy(spark, sf):
    return M.anchor_fuzzy(_notice_quotes(spark, sf), plain_notices(spark, sf))


def _verified(spark, sf):
    quotes = _notice_quotes(spark, sf)
    anchors = M.anchored(quotes, plain_notices(spark, sf))
    proposals = quotes.selectExpr(
        "quote_id", "doc_id",
        "CASE doc_id % 3 WHEN 0 THEN 'action' WHEN 1 THEN 'requirement' ELSE 'gap' END as kind")
    return M.verify_proposals(proposals, anchors)


@register()
def verify_proposals(spark, sf):
    return _verified(spark, sf).select("quote_id", "kind", "outcome", "confidence")


@register("""
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'action' WHEN 1 THEN 'requirement' ELSE 'gap' END AS kind,
  count(*) AS proposed, count(*) FILTER (WHERE o_orderkey % 5 = 4) AS hallucinated,
  count(*) FILTER (WHERE o_orderkey % 5 = 4) / count(*) AS rate FROM orders GROUP BY 1""")
def hallucination_rate(spark, sf):
    return M.hallucination_rate(_verified(spark, sf), "kind").drop("demoted")


@register(with_expected("""
SELECT doc_id, concat('date-', CAST(1 + cust % 3 AS STRING)) AS deadline_id, d.resolved AS deadline
FROM n LEFT JOIN (SELECT doc_id, resolved, row_number() OVER (PARTITION BY doc_id ORDER BY char_start)
  AS pos FROM dates) d USING (doc_id) WHERE false OR d.pos = 1 + cust % 3
UNION ALL SELECT doc_id, concat('date-', CAST(1 + cust % 3 AS STRING)), NULL FROM n WHERE NOT EXISTS
  (SELECT 1 FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) AS pos FROM
  dates) d WHERE d.doc_id = n.doc_id AND d.pos = 1 + cust % 3)"""))
def resolve_date_refs(spark, sf):
    docs = with_dates(plain_notices(spark, sf), TODAY)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    proposals = orders.selectExpr(
        "o_orderkey as doc_id", "concat('date-', 1 + o_custkey % 3) as deadline_id")
    return M.resolve_date_refs(proposals, M.date_catalogue(docs))


_LINE_SPAN = (
    "cast(l_linenumber * 10 as int) as char_start, "
    "cast(l_linenumber * 10 + 4 + l_quantity % 20 as int) as char_end"
)


@register("""
WITH RECURSIVE spans AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 2 = 0 AS rule,
  CAST(l_linenumber * 10 AS INT) AS s, CAST(l_linenumber * 10 + 4 + l_quantity % 20 AS INT) AS e FROM lineitem),
arms AS (SELECT doc_id, coalesce(list(struct_pack(s := s, e := e) ORDER BY s, e) FILTER (WHERE rule), []) AS r,
  coalesce(list(struct_pack(s := s, e := e) ORDER BY s, e) FILTER (WHERE NOT rule), []) AS p FROM spans GROUP BY 1),
walk AS (SELECT doc_id, 1 AS i, r AS kept, p FROM arms UNION ALL
  SELECT doc_id, i + 1, CASE WHEN len(list_filter(kept, lambda k: least(p[i].e, k.e) - greatest(p[i].s, k.s) > 0
    AND 2 * (least(p[i].e, k.e) - greatest(p[i].s, k.s)) >= least(p[i].e - p[i].s, k.e - k.s))) > 0 THEN kept
    ELSE list_append(kept, p[i]) END, p FROM walk WHERE i <= len(p))
SELECT doc_id, m.s AS char_start, m.e AS char_end FROM (SELECT doc_id, unnest(kept) AS m FROM walk WHERE i > len(p))""")
def merge_arms(spark, sf):
    """Rule findings of an order merged with proposals that overlap none of them.

    Spans of an order are first reduced to distinct ones, so that an order with
    very many lines stays as small as its positions.
    """
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey as doc_id", "l_partkey % 2 = 0 as rule", *_LINE_SPAN.split(", "))
    spans = lines.distinct()
    arms = spans.groupBy("doc_id").agg(
        F.expr("array_sort(collect_list(struct(char_start, char_end)) FILTER (WHERE rule))").alias("r"),
        F.expr("array_sort(collect_list(struct(char_start, char_end)) FILTER (WHERE NOT rule))").alias("p"))
    return table_of(M.merge_arms(arms, "r", "p", "m"), "m", "doc_id")
