"""Queries over what single documents say."""

from __future__ import annotations

from pyspark.sql import functions as F

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.rows import table_of
from docplan.operators import actions as A
from docplan.operators import classify, eligibility, gaps, requirements
from docplan.operators import claims as K
from docplan.operators import temporal as T
from docplan.operators import text as X
from docplan.plans.analysis import with_dates, with_requirements
from docplan.plans.repeated import distinct_texts, per_document
from docplan.queries import expected as E
from docplan.queries.expected import with_expected
from docplan.queries.registry import register
from docplan.sources.notices import TODAY, notices, plain_notices, profiled_notices

_D = TODAY


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


# --- text -------------------------------------------------------------------

_SENTENCES = """
SELECT doc_id, sent_no - 1 AS sent_no, CAST(strpos(text, s) - 1 AS INT) AS char_start,
       CAST(strpos(text, s) - 1 + length(s) AS INT) AS char_end, s AS text
FROM (SELECT doc_id, text, unnest(parts) AS s, generate_subscripts(parts, 1) AS sent_no
  FROM (SELECT doc_id, text, list_filter(string_split(
          replace(replace(text, 'NO. ', 'NO.~'), '. ', concat('.', chr(10), chr(10))), concat(chr(10), chr(10))),
          lambda x: trim(x, concat(' ', chr(10))) <> '') AS raw,
        list_transform(raw, lambda x: replace(trim(x, concat(' ', chr(10))), 'NO.~', 'NO. ')) AS parts FROM n))
"""


@register(with_expected(_SENTENCES))
def split_sentences(spark, sf):
    """Sentences of every notice; the number after "NO." belongs to its heading."""
    return X.split_sentences(notices(spark, sf).select("doc_id", "text"))


@register()
def split_sentences_documents(spark, sf):
    return X.split_sentences(_documents(spark, sf))


@register(r"""
SELECT doc_id, trim(regexp_replace(lower(replace(replace(regexp_replace(replace(
  text, '­', ''), '([^\W\d_])-\s*\n\s*([^\W\d_])', '\1\2', 'g'), 'ß', 'ss'), '…', '...')),
  '[\s  ​]+', ' ', 'g')) AS normalized FROM documents""")
def normalize_text(spark, sf):
    return X.normalize_text(_documents(spark, sf))


@register(r"""
SELECT doc_id, line AS value, CASE WHEN line = upper(line) AND line <> lower(line) THEN 0.8::DOUBLE ELSE 0.62::DOUBLE
  END AS score FROM (SELECT doc_id, trim(list_filter(string_split(text, chr(10)),
  lambda x: length(x) BETWEEN 6 AND 120 AND length(trim(x)) >= 6
    AND regexp_matches(x, '[A-Za-z]{3}'))[1]) AS line FROM documents) WHERE line IS NOT NULL""")
def title_claim(spark, sf):
    return X.title_claim(_documents(spark, sf)).select("doc_id", "value", "score")


@register(r"""
SELECT doc_id, CASE WHEN length(flat) <= 160 THEN flat ELSE
  concat(rtrim(left(flat, 159)), '…') END AS excerpt
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)""")
def excerpt(spark, sf):
    return X.excerpts(_documents(spark, sf))


# --- document types ---------------------------------------------------------


@register(with_expected(
    "SELECT doc_id, type, CAST(confidence AS DOUBLE) AS confidence, rationale FROM types"))
def classify_documents(spark, sf):
    return classify.classify_documents(plain_notices(spark, sf))


@register(with_expected("""
SELECT doc_id, value, CASE WHEN evidence IS NULL OR score < 0.6 THEN 'UNCERTAIN' ELSE 'INFERENCE' END
  AS classification, score, evidence FROM (
  SELECT doc_id, CASE type WHEN 'notice' THEN 'Notice' WHEN 'form' THEN 'Form' WHEN
    'job_description' THEN 'Job description' WHEN 'policy' THEN 'Policy' ELSE 'Document' END AS value,
    least(confidence, text_confidence) AS score, CASE type WHEN 'other' THEN NULL WHEN 'form' THEN
    '______' WHEN 'policy' THEN 'policy' WHEN 'job_description' THEN 'Key duties' ELSE
    CASE WHEN contains(text, 'CIRCULAR') THEN 'CIRCULAR' WHEN contains(text, 'NOTICE') THEN 'NOTICE'
    ELSE 'Notice' END END AS evidence FROM types)"""))
def document_type_claim(spark, sf):
    return classify.document_type_claim(plain_notices(spark, sf)).select(
        "doc_id", "value", "classification", "score", "evidence"
    )


# --- dates ------------------------------------------------------------------

_SPAN = "doc_id, char_start, char_end, text"


@register(with_expected(
    f"SELECT {_SPAN}, resolved, confidence, is_deadline FROM dates WHERE kind = 'absolute' AND "
    "confidence IN (0.97, 0.72) UNION ALL SELECT doc_id, CAST(strpos(text, p) - 1 AS INT), "
    "CAST(strpos(text, p) - 1 + length(p) AS INT), p, d, 0.97, false FROM (SELECT doc_id, text, "
    "unnest([opens, due]) AS d FROM n WHERE tpl = 5 AND cust % 5 <> 0), LATERAL (SELECT "
    + E.N.long_date("d") + " AS p)"))
def named_dates(spark, sf):
    """Day-month and month-day dates before overlaps are settled."""
    found = S.let("text", lambda t: S.let(
        T.issue_date(t, _D),
        lambda ref: f"concat({T.named_dates(t, ref, True)}, {T.named_dates(t, ref, False)})"))
    dated = plain_notices(spark, sf).selectExpr(
        "doc_id", f"{found} as found", f"{T.cued_clauses('text')} as clauses")
    dated = dated.selectExpr("doc_id", f"{T.with_cutoffs('found', 'clauses')} as dates")
    return table_of(dated, "dates", "doc_id").select(
        "doc_id", "char_start", "char_end", "text", "resolved", "confidence", "is_deadline"
    )


@register("""
SELECT o_orderkey AS doc_id, CASE WHEN month(d) = 2 AND day(d) = 29 THEN
  CASE WHEN year(r) % 4 = 0 AND make_date(year(r), 2, 29) >= r THEN make_date(year(r), 2, 29)
       ELSE make_date(year(r) + 1, 2, 28) END
  WHEN make_date(year(r), month(d), day(d)) >= r THEN make_date(year(r), month(d), day(d))
  ELSE make_date(year(r) + 1, month(d), day(d)) END AS resolved
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
        CAST(o_orderdate AS DATE) + CAST(o_custkey % 900 AS INT) AS r FROM orders)""")
def resolve_missing_year(spark, sf):
    """The order's day and month, next seen from a later reference date."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey as doc_id", "cast(o_orderdate as date) as d",
        "date_add(cast(o_orderdate as date), cast(o_custkey % 900 as int)) as r",
    )
    return orders.selectExpr("doc_id", f"{T.next_occurrence('month(d)', 'day(d)', 'r')} as resolved")


@register(with_expected(
    f"SELECT {_SPAN}, resolved, confidence, alternate, rationale FROM dates WHERE confidence IN (0.45, 0.88)"))
def numeric_dates(spark, sf):
    found = S.let("text", T.numeric_dates)
    return plain_notices(spark, sf).selectExpr("doc_id", f"inline({found})").select(
        "doc_id", "char_start", "char_end", "text", "resolved", "confidence", "alternate",
        "rationale",
    )


@register(with_expected(
    f"SELECT {_SPAN}, resolved, confidence, rationale FROM dates WHERE kind = 'relative'"))
def relative_dates(spark, sf):
    found = S.let("text", lambda t: S.let(T.issue_date(t, _D), lambda r: T.relative_dates(t, r)))
    return plain_notices(spark, sf).selectExpr("doc_id", f"inline({found})").select(
        "doc_id", "char_start", "char_end", "text", "resolved", "confidence", "rationale"
    )


@register("""
SELECT o_orderkey AS doc_id, CASE WHEN k = 0 THEN d ELSE list_filter(list_transform(range(1, 60),
  lambda i: d + CAST(i AS INT)), lambda x: isodow(x) < 6)[k] END AS due
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey % 31 AS INT) AS k FROM orders)""")
def add_working_days(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey as doc_id", "cast(o_orderdate as date) as d", "cast(o_custkey % 31 as int) as k"
    ).selectExpr("doc_id", f"{T.add_working_days('d', 'k')} as due")


@register(with_expected(
    f"SELECT {_SPAN}, resolved, window_end, confidence FROM dates WHERE kind = 'window'"))
def date_windows(spark, sf):
    found = S.let("text", lambda t: S.let(T.issue_date(t, _D), lambda r: T.date_windows(t, r)))
    return plain_notices(spark, sf).selectExpr("doc_id", f"inline({found})").select(
        "doc_id", "char_start", "char_end", "text", "resolved", "window_end", "confidence"
    )


@register("""
WITH line AS (
  SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber * 3 AS INT) AS s,
    CAST(l_linenumber * 3 + 1 + l_quantity % 9 AS INT) AS e FROM lineitem),
spans AS (SELECT DISTINCT l_orderkey AS doc_id, s AS char_start, e AS char_end FROM line)
SELECT a.* FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE a.doc_id = b.doc_id
  AND b.char_start <= a.char_start AND a.char_end <= b.char_end
  AND (b.char_start < a.char_start OR a.char_end < b.char_end))""")
def drop_covered_spans(spark, sf):
    """Widest spans only, over spans laid out by the lines of an order.

    The relational form of the rule, for findings that arrive as a table: a
    span is dropped if a distinct one contains it. Containment is looked up
    per start position, so an order with very many lines is spread over its
    positions rather than sorted in one window.
    """
    spans = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey as doc_id", "cast(l_linenumber * 3 as int) as char_start",
        "cast(l_linenumber * 3 + 1 + l_quantity % 9 as int) as char_end",
    )
    widest = spans.groupBy("doc_id", "char_start").agg(F.max("char_end").alias("char_end"))
    reach = widest.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("spans")
    )
    kept = S.ordered_fold(
        "spans", "-1",
        lambda far, s: (f"greatest({far}, {s}.char_end)",
                        f"if({s}.char_end > {far}, array({s}), "
                        f"{S.empty('struct<char_start:int,char_end:int>')})"),
        "struct<char_start:int,char_end:int>",
    )
    return reach.selectExpr("doc_id", f"inline({kept})")


@register(with_expected(
    f"SELECT {_SPAN}, is_deadline FROM dates WHERE kind = 'absolute' ORDER BY doc_id"))
def deadline_cue(spark, sf):
    return T.extract_temporal(plain_notices(spark, sf), _D).where("kind = 'absolute'").select(
        "doc_id", "char_start", "char_end", "text", "is_deadline"
    )


@register(with_expected(
    f"SELECT doc_id, CASE WHEN tpl IN (0, 4) THEN issued ELSE {E.TODAY} END AS issued FROM n"))
def issue_date(spark, sf):
    issued = S.let("text", lambda t: T.issue_date(t, _D))
    return plain_notices(spark, sf).selectExpr("doc_id", f"{issued} as issued")


@register(with_expected(
    "SELECT doc_id, char_start, char_end, text, kind, resolved, window_end, confidence, rationale, "
    "is_deadline, alternate FROM dates"))
def extract_temporal(spark, sf):
    return T.extract_temporal(plain_notices(spark, sf), _D)


def _claims(spark, sf):
    return with_dates(plain_notices(spark, sf), _D)


@register(with_expected(
    "SELECT doc_id, value, classification, CAST(score AS DOUBLE) AS score, rationale, char_start, "
    "char_end, evidence FROM claims"))
def deadline_claims(spark, sf):
    return table_of(_claims(spark, sf), "deadlines", "doc_id")


@register(with_expected(f"""
SELECT doc_id, char_start, CASE WHEN wrong THEN 'UNCERTAIN' ELSE classification END
  AS classification, CAST(CASE WHEN wrong THEN least(score, 0.35) ELSE score END AS DOUBLE)
  AS score, CASE WHEN wrong THEN {E._q(T.UNSTATED)} ELSE rationale END AS rationale
FROM (SELECT *, NOT (regexp_matches(words, concat('\\b0?', day(moved), '\\b')) AND (contains(words,
    lower(left(strftime(moved, '%B'), 3))) OR regexp_matches(words, concat('\\b0?', month(moved), '\\b')))) AS wrong
  FROM (SELECT *, lower(evidence) AS words, CAST(value + CAST(doc_id % 2 AS INT) AS DATE) AS moved FROM claims))"""))
def verify_date_spans(spark, sf):
    """Date claims whose value was moved by a day in odd documents are demoted, like those whose words spell
    out no date."""
    claims = table_of(_claims(spark, sf), "deadlines", "doc_id")
    moved = claims.withColumn("value", F.expr("date_add(value, cast(doc_id % 2 as int))"))
    return K.demote(moved, f"NOT {T.states_date('value', 'evidence')}", T.UNSTATED).select(
        "doc_id", "char_start", "classification", "score", "rationale"
    )


def _board(spark, sf):
    return table_of(_claims(spark, sf), "array_compact(array(primary_deadline))", "doc_id")


@register(with_expected("SELECT doc_id, due FROM prim"))
def primary_deadline(spark, sf):
    return _board(spark, sf).selectExpr("doc_id", "value as due")


@register(with_expected("""
SELECT c.doc_id, c.value AS due, c.classification, CAST(c.score AS DOUBLE) AS score, c.evidence
FROM claims c JOIN prim p ON c.doc_id = p.doc_id AND c.value = p.due"""))
def deadline_board(spark, sf):
    """Each notice's primary deadline with the words that state it."""
    return _board(spark, sf).selectExpr(
        "doc_id", "value as due", "classification", "score", "evidence"
    )


# --- actions ----------------------------------------------------------------


@register("""
SELECT word AS form, bucket, base, count(*) AS uses FROM (SELECT unnest(regexp_extract_all(lower(text),
  '[a-z]+')) AS word FROM n) JOIN (VALUES FORMS) f(form, bucket, base) ON form = word GROUP BY ALL""".replace(
    "FORMS", ", ".join(f"('{f}', '{b}', '{w}')" for f, b, w in L.VERB_FORMS)).join(
        [f"WITH n AS ({E.N.notices_sql()}) ", ""]))
def verb_lexicon(spark, sf):
    """How often each inflected form of the verb lexicon occurs in the notices."""
    words = plain_notices(spark, sf).selectExpr(
        "explode(regexp_extract_all(lower(text), '([a-z]+)', 1)) as form")
    counts = words.groupBy("form").agg(F.count("*").alias("uses"))
    return counts.join(F.broadcast(A.verb_lexicon(spark)), "form").select("form", "bucket", "base", "uses")


@register(with_expected("""
SELECT doc_id, char_start, max(confidence) AS confidence FROM acts GROUP BY doc_id, char_start"""))
def obligation_score(spark, sf):
    """Sentences that instruct through a verb, with the strength of their wording."""
    found = A.governed_verbs(plain_notices(spark, sf), "s").df
    return table_of(found, "s", "doc_id").selectExpr(
        "doc_id", "char_start", f"if(tier > 0, tier, {S.lit(L.IMPERATIVE_SCORE)}) as confidence"
    )


@register(with_expected("""
SELECT doc_id, char_start, verb, CASE doc_id % 12 WHEN 0 THEN 'deposit' WHEN 1 THEN 'upload' WHEN 2
  THEN 'furnish' WHEN 3 THEN 'collect' WHEN 4 THEN 'complete' WHEN 5 THEN 'apply' WHEN 6 THEN
  CASE action_no WHEN 1 THEN 'collect' ELSE 'send' END WHEN 7 THEN CASE action_no WHEN 1 THEN 'attach'
  WHEN 2 THEN 'return' ELSE 'upload' END ELSE 'submit' END AS base
FROM acts WHERE NOT (doc_id % 12 = 6 AND action_no IN (2, 3))"""))
def governed_verb(spark, sf):
    found = A.governed_verbs(plain_notices(spark, sf), "s").df
    return table_of(found, "s", "doc_id").select("doc_id", "char_start", "verb", "base")


def _candidates(spark, sf):
    return table_of(A.with_candidates(plain_notices(spark, sf), requirements=False), "candidates", "doc_id")


@register(with_expected("SELECT doc_id, char_start, description FROM acts"))
def as_instruction(spark, sf):
    return _candidates(spark, sf).select("doc_id", "char_start", "description")


@register(with_expected(
    "SELECT doc_id, description, verb, confidence, rationale FROM acts WHERE confidence = 0.741"))
def coordinated_actions(spark, sf):
    return _candidates(spark, sf).where("rationale LIKE 'Coordinated%'").select(
        "doc_id", "description", "verb", "confidence", "rationale"
    )


@register(with_expected(
    "SELECT doc_id, description, conditional_on FROM acts WHERE conditional_on IS NOT NULL"))
def restriction(spark, sf):
    return _candidates(spark, sf).where("conditional_on IS NOT NULL").select(
        "doc_id", "description", "conditional_on"
    )


@register(with_expected("SELECT doc_id, description, optional FROM acts"))
def optional_flag(spark, sf):
    return _candidates(spark, sf).select("doc_id", "description", "optional")


def _actions(spark, sf):
    """Actions of each distinct text, with the ``doc_ids`` of its documents."""
    docs = A.with_actions(A.with_candidates(with_dates(distinct_texts(plain_notices(spark, sf)), _D)))
    return table_of(docs, "actions", "doc_ids")


@register(with_expected("SELECT doc_id, action_id, deadline FROM acts WHERE deadline IS NOT NULL"))
def attach_deadlines(spark, sf):
    return per_document(_actions(spark, sf).where("deadline IS NOT NULL").select("doc_ids", "action_id", "deadline"))


@register(with_expected(f"""
SELECT doc_id, action_no, action_id, description, verb, score, classification,
  concat(rationale, {E.OCR_NOTE}) AS rationale, char_start, char_end, effort_days, requires,
  coalesce(conditional_on, '') AS conditional_on, optional FROM sched"""))
def extract_actions(spark, sf):
    return per_document(_actions(spark, sf).selectExpr(
        "doc_ids", "action_no", "action_id", "description", "verb", "score", "classification",
        "rationale", "char_start", "char_end", "effort_days", "array_join(requires, '|') as requires",
        "coalesce(conditional_on, '') as conditional_on", "optional",
    ))


@register(with_expected(
    "SELECT doc_id, 'action-4' AS node, 'action-1' AS dep FROM n WHERE tpl = 6"))
def link_dependencies(spark, sf):
    return per_document(_actions(spark, sf).selectExpr(
        "doc_ids", "action_id as node", "explode_outer(depends_on) as dep"
    ).where("dep IS NOT NULL"))


# --- requirements -----------------------------------------------------------

_REQ_ROWS = (
    "SELECT doc_id, char_start, description, unnest(string_split(requires, '|')) AS requirement "
    "FROM acts WHERE requires <> ''"
)


@register(with_expected(
    f"SELECT doc_id, requirement FROM ({_REQ_ROWS}) WHERE doc_id % 12 = 0 AND requirement <> "
    "'Allotment form' UNION ALL SELECT doc_id, 'Fee challan' FROM n WHERE tpl = 7"))
def cued_requirements(spark, sf):
    """What follows "along with", "attach" and the like."""
    docs = A.governed_verbs(plain_notices(spark, sf), "s").df
    rows = table_of(docs, "s", "doc_id")
    return rows.selectExpr(
        "doc_id", f"explode({requirements.cued_requirements('text')}) as requirement")


@register(with_expected("""
SELECT doc_id, char_start, string_split(requires, '|')[1] AS requirement FROM acts
WHERE requires <> '' AND NOT (doc_id % 12 = 6 AND action_no = 2)"""))
def direct_object_requirement(spark, sf):
    """The object of the first verb, where it names something to hand in."""
    rows = table_of(A.governed_verbs(plain_notices(spark, sf), "s").df, "s", "doc_id")
    tail = S.head_of(S.after("text", "verb_end"), L.TRAILING_CLAUSE)
    return rows.selectExpr(
        "doc_id", "char_start", f"explode({requirements.direct_object(tail, 'verb')}) as requirement")


@register("""
SELECT l_orderkey AS doc_id, l_linenumber AS line, unnest([
  CASE l_partkey % 3 WHEN 0 THEN 'Income certificate' WHEN 1 THEN 'Resume' ELSE 'Offer letter' END,
  CASE l_suppkey % 2 WHEN 0 THEN 'Two photographs' ELSE 'Scanned copy of ID card' END])
  AS requirement FROM lineitem""")
def series_requirements(spark, sf):
    """Comma series of artefacts, one sentence per order line."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey as doc_id", "l_linenumber as line",
        "concat(' your ', CASE l_partkey % 3 WHEN 0 THEN 'income certificate' WHEN 1 THEN 'resume' "
        "ELSE 'offer letter' END, ', the ', CASE l_suppkey % 2 WHEN 0 THEN 'two photographs' ELSE "
        "'scanned copy of the ID card' END, ' and so') as tail",
    )
    listed = S.let("tail", requirements.series_requirements)
    return lines.selectExpr("doc_id", "line", f"explode({listed}) as requirement")


@register("""
SELECT l_orderkey AS doc_id, l_linenumber AS line, CASE l_partkey % 5 WHEN 0 THEN 'Income certificate'
  WHEN 1 THEN 'Offer letter' WHEN 2 THEN '~' WHEN 3 THEN concat('Form ', CAST(l_suppkey AS STRING))
  ELSE 'Self-attested copy of marksheet' END AS requirement FROM lineitem""")
def clean_requirement(spark, sf):
    fragment = (
        "CASE l_partkey % 5 WHEN 0 THEN ' their income   certificate ' WHEN 1 THEN "
        "'the offer letter issued' WHEN 2 THEN ' it ' WHEN 3 THEN concat('form! ', l_suppkey, '.') "
        "ELSE 'a self-attested copy of the marksheet' END"
    )
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey as doc_id", "l_linenumber as line", f"{fragment} as fragment")
    return lines.selectExpr(
        "doc_id", "line",
        f"coalesce({requirements.clean_requirement('fragment')}, '~') as requirement")


_PHRASES = (
    ("minimum 60% in the qualifying marksheet", "condition"), ("bank account details", "information"),
    ("income certificate", "document"), ("domicile certificate", "document"),
    ("aged persons", "condition"), ("email", "information"), ("two hats", "unclassified"),
)
_PHRASE_SQL = "CASE l_partkey % 7 " + " ".join(
    f"WHEN {i} THEN '{p}'" for i, (p, _) in enumerate(_PHRASES)) + " END"
_KIND_SQL = "CASE l_partkey % 7 " + " ".join(
    f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(_PHRASES)) + " END"


@register(f"""
SELECT l_orderkey AS doc_id, {_PHRASE_SQL} AS text, {_KIND_SQL} AS kind,
  l_partkey % 7 IN (0, 1, 2, 3) AS artefact FROM lineitem""")
def classify_requirement(spark, sf):
    phrases = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey as doc_id", f"{_PHRASE_SQL} as text")
    return requirements.classify_requirements(phrases)


def _grouped(spark, sf):
    docs = A.with_actions(A.with_candidates(with_dates(distinct_texts(plain_notices(spark, sf)), _D)))
    return per_document(table_of(with_requirements(docs), "requirements", "doc_ids"))


_DOC_REQS = (
    "SELECT DISTINCT doc_id, requirement AS text, CASE WHEN requirement LIKE '%not later than%' "
    f"THEN 'document' ELSE 'document' END AS kind FROM ({_REQ_ROWS})"
)


@register(with_expected(_DOC_REQS))
def group_requirements(spark, sf):
    return _grouped(spark, sf)


@register(with_expected(
    f"SELECT kind, count(*) AS requirements, count(DISTINCT doc_id) AS documents FROM ({_DOC_REQS}) "
    "GROUP BY kind"))
def requirements_by_kind(spark, sf):
    return _grouped(spark, sf).groupBy("kind").agg(
        F.count("*").alias("requirements"), F.count_distinct("doc_id").alias("documents"))


# --- gaps -------------------------------------------------------------------


@register(with_expected(f"SELECT {_SPAN}, rule FROM gaps"))
def vague_referents(spark, sf):
    return gaps.vague_referents(plain_notices(spark, sf))


@register(with_expected("""
SELECT doc_id, variant = 0 AS resolved FROM n WHERE tpl = 8"""))
def resolved_nearby(spark, sf):
    """Whether the mention of a portal is followed by its address."""
    docs = plain_notices(spark, sf)
    found = S.transform(S.find_all("text", L.GAP_RULES[2][0]), lambda m: S.struct(
        resolved=gaps.resolved_nearby("text", m, fee=False)))
    return docs.selectExpr("doc_id", f"inline({found})")


@register(with_expected(
    "SELECT doc_id, question, why, suggestion, char_start, char_end, text FROM gaps"))
def extract_gaps(spark, sf):
    return gaps.extract_gaps(plain_notices(spark, sf))


@register(with_expected(
    "SELECT suggestion, count(*) AS gaps FROM gaps GROUP BY suggestion"))
def suggest_resolution(spark, sf):
    found = gaps.extract_gaps(plain_notices(spark, sf))
    return found.selectExpr(f"{gaps.suggest_resolution('question')} as suggestion").groupBy(
        "suggestion").agg(F.count("*").alias("gaps"))


# --- eligibility ------------------------------------------------------------

_CRIT = (
    "doc_id, char_start, char_end, text, attribute, comparator, num_value, "
    "coalesce(accepted, '') AS accepted, requirement"
)


def _criteria_of(build, attributes: str):
    def query(spark, sf):
        found = S.let("text", build)
        return plain_notices(spark, sf).selectExpr("doc_id", f"inline({found})").where(
            f"attribute IN ({attributes})"
        ).selectExpr(
            "doc_id", "char_start", "char_end", "text", "attribute", "comparator",
            "coalesce(num_value, -1) as num_value",
            "coalesce(array_join(accepted, '|'), '') as accepted", "requirement",
        )

    return query


def _criteria_sql(attributes: str) -> str:
    return with_expected(
        f"SELECT {_CRIT.replace('num_value', 'coalesce(num_value, -1) AS num_value')} FROM crit "
        f"WHERE attribute IN ({attributes})")


for _name, _build, _attrs in (
    ("year_criteria", eligibility.year_criteria, "'year'"),
    ("score_cgpa_criteria", eligibility.score_criteria, "'score', 'cgpa'"),
    ("age_criteria", eligibility.age_criteria, "'age'"),
    ("domicile_programme_criteria", eligibility.domicile_programme_criteria,
     "'domicile', 'programme'"),
):
    register(_criteria_sql(_attrs), _name)(_criteria_of(_build, _attrs))

register(
    with_expected(
        "SELECT doc_id, text, accepted FROM crit WHERE attribute = 'category' UNION ALL "
        "SELECT doc_id, 'SC/ST category students', 'SC|ST' FROM n WHERE tpl = 9"),
    "category_criteria",
)(lambda spark, sf: plain_notices(spark, sf).selectExpr(
    "doc_id", f"inline({S.let('text', eligibility.category_criteria)})"
).selectExpr("doc_id", "text", "array_join(accepted, '|') as accepted"))


@register(with_expected(
    f"SELECT pos, {_CRIT.replace('num_value', 'coalesce(num_value, -1) AS num_value')} FROM crit"))
def extract_criteria(spark, sf):
    return eligibility.extract_criteria(plain_notices(spark, sf)).selectExpr(
        "pos", "doc_id", "char_start", "char_end", "text", "attribute", "comparator",
        "coalesce(num_value, -1) as num_value",
        "coalesce(array_join(accepted, '|'), '') as accepted", "requirement",
    )


_P = E.N.PROFILE
_FINDINGS = f"""
SELECT c.*, p.profile_id,
  CASE c.attribute
    WHEN 'category' THEN CASE WHEN p.category IN ('SC', 'ST') THEN 'matches' ELSE 'conflicts' END
    WHEN 'domicile' THEN CASE WHEN p.domicile = c.accepted THEN 'matches' ELSE 'unknown' END
    WHEN 'programme' THEN CASE WHEN p.programme LIKE 'B.Tech%' THEN 'matches' ELSE 'unknown' END
    ELSE CASE WHEN p.num IS NULL THEN 'unknown' WHEN p.num >= c.num_value THEN 'matches'
         ELSE 'conflicts' END END AS match,
  CASE c.attribute WHEN 'category' THEN p.category WHEN 'domicile' THEN p.domicile
    WHEN 'programme' THEN p.programme ELSE CASE WHEN p.num = floor(p.num) THEN
      CAST(CAST(p.num AS BIGINT) AS STRING) ELSE CAST(p.num AS STRING) END END AS profile_value
FROM crit c JOIN (SELECT c_custkey AS profile_id, attribute, {_P['category']} AS category,
    {_P['domicile']} AS domicile, {_P['programme']} AS programme,
    CASE attribute WHEN 'year' THEN {_P['year']} WHEN 'score' THEN {_P['score']}
      WHEN 'cgpa' THEN {_P['cgpa']} WHEN 'age' THEN {_P['age']} END AS num
  FROM customer, (SELECT unnest(['category', 'domicile', 'programme', 'year', 'score', 'cgpa',
    'age']) AS attribute)) p ON p.profile_id = c.cust AND p.attribute = c.attribute"""
_SAID = "CASE attribute " + " ".join(
    f"WHEN '{a}' THEN concat({E._q(x)}, profile_value, {E._q(y)})"
    for a, (x, y) in L.ATTRIBUTE_STATEMENTS.items()) + " END"
_LABEL = "CASE attribute " + " ".join(
    f"WHEN '{a}' THEN '{v}'" for a, v in L.ATTRIBUTE_LABELS.items()) + " END"


@register(with_expected(f"""
SELECT doc_id, profile_id, pos, attribute, match, coalesce(profile_value, '') AS profile_value,
  CASE WHEN profile_value IS NULL THEN concat('The document requires ', requirement,
      '; your profile does not state your ', {_LABEL}, '.')
    WHEN match = 'matches' THEN concat({_SAID}, ' That meets the requirement of ', requirement, '.')
    WHEN match = 'conflicts' AND attribute = 'category' THEN concat({_SAID}, ' This is limited to ',
      requirement, '.')
    WHEN match = 'conflicts' THEN concat({_SAID}, ' This asks for ', requirement, '.')
    ELSE concat({_SAID}, ' The document says ', requirement, '. Those do not obviously match, and '
      'abbreviations are not expanded here — worth settling yourself rather than trusting either '
      'reading.') END AS explanation FROM ({_FINDINGS})""".replace("and '\n      'abb", "and abb").replace(
    "than trusting either '\n      'reading", "than trusting either reading")))
def check_eligibility(spark, sf):
    docs = eligibility.with_criteria(profiled_notices(spark, sf))
    return eligibility.check_eligibility(docs).selectExpr(
        "doc_id", "profile_id", "pos", "attribute", "match",
        "coalesce(profile_value, '') as profile_value", "explanation",
    )


_ASSESS = f"""
SELECT n.doc_id, n.cust AS profile_id, n.text_confidence, count(f.doc_id) AS total,
  count(*) FILTER (WHERE match = 'conflicts') AS bad, count(*) FILTER (WHERE match = 'matches') AS good,
  CASE WHEN total = 0 THEN 'not_restricted' WHEN bad > 0 THEN 'does_not_apply' WHEN good > 0 THEN
    'applies' ELSE 'undetermined' END AS verdict,
  CASE WHEN total = 0 THEN 0.6 WHEN bad > 0 THEN 0.85 WHEN good = total THEN 0.88 WHEN good > 0 THEN
    CAST(round(0.5 + CAST(0.35 AS DOUBLE) * (good / total) , 2) AS DOUBLE) ELSE 0.4 END AS confidence,
  arg_min(f.text, struct_pack(r := CASE match WHEN 'conflicts' THEN 0 WHEN 'matches' THEN 1 ELSE 2 END,
    p := f.pos)) AS evidence
FROM n JOIN customer ON c_custkey = cust LEFT JOIN ({_FINDINGS}) f ON f.doc_id = n.doc_id
GROUP BY ALL"""


def _assessed(spark, sf):
    docs = eligibility.with_findings(eligibility.with_criteria(profiled_notices(spark, sf)))
    return docs.selectExpr("*", f"{eligibility.assess('findings')} as assessment")


@register(with_expected(
    f"SELECT doc_id, profile_id, verdict, CAST(confidence AS DOUBLE) AS confidence FROM ({_ASSESS})"))
def assess(spark, sf):
    return _assessed(spark, sf).select(
        "doc_id", "profile_id", "assessment.verdict", "assessment.confidence")


@register(with_expected(f"""
SELECT doc_id, CASE verdict WHEN 'applies' THEN 'This applies to you' WHEN 'does_not_apply' THEN
  'This does not appear to apply to you' WHEN 'undetermined' THEN 'Not enough about you to tell' ELSE
  'The document never says who it is for' END AS value, CASE WHEN verdict = 'not_restricted' THEN
  'MISSING' WHEN least(confidence, text_confidence) >= 0.6 THEN 'INFERENCE' ELSE 'UNCERTAIN' END AS
  classification, CAST(round(least(confidence, text_confidence), 4) AS DOUBLE) AS score, evidence
FROM ({_ASSESS})"""))
def relevance_claim(spark, sf):
    claim = eligibility.relevance_claim(
        "findings", "assessment", "text_confidence", "source_kind")
    return _assessed(spark, sf).selectExpr("doc_id", f"inline(array({claim}))").select(
        "doc_id", "value", "classification", "score", "evidence")


@register(with_expected("SELECT doc_id, pos, attribute FROM crit"))
def asked_attributes(spark, sf):
    return eligibility.asked_attributes(plain_notices(spark, sf))


# --- claims -----------------------------------------------------------------


@register("""
SELECT o_orderkey AS doc_id, (o_custkey % 101) / 100.0 AS score, CASE WHEN o_custkey % 101 >= 85 THEN
  'FACT' WHEN o_custkey % 101 >= 60 THEN 'INFERENCE' ELSE 'UNCERTAIN' END AS classification FROM orders""")
def classify_confidence(spark, sf):
    scored = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey as doc_id", "cast(o_custkey % 101 as double) / 100 as score")
    return K.classify_claims(scored)


@register(with_expected("""
SELECT doc_id, CAST(least((cust % 101) / 100.0, text_confidence) AS DOUBLE) AS score, CASE WHEN
  least((cust % 101) / 100.0, text_confidence) >= 0.85 THEN 'FACT' WHEN least((cust % 101) / 100.0,
  text_confidence) >= 0.6 THEN 'INFERENCE' ELSE 'UNCERTAIN' END AS classification FROM n"""))
def cap_by_text_confidence(spark, sf):
    docs = notices(spark, sf)
    claims = docs.selectExpr("doc_id", "cast(cust % 101 as double) / 100 as score")
    return K.cap_claims(claims, docs)


@register(with_expected("""
SELECT doc_id, char_start, CASE WHEN doc_id % 3 = 0 THEN 'UNCERTAIN' ELSE classification END AS
  classification, CAST(CASE WHEN doc_id % 3 = 0 THEN least(score, 0.35) ELSE score END AS DOUBLE) AS
  score, CASE WHEN doc_id % 3 = 0 THEN 'not entailed' ELSE rationale END AS rationale, evidence
FROM claims"""))
def demote(spark, sf):
    claims = table_of(_claims(spark, sf), "deadlines", "doc_id").drop("value", "char_end")
    return K.demote(claims, "doc_id % 3 = 0", "not entailed")


_BROKEN = (
    "CASE doc_id % 6 WHEN 0 THEN 'wrong_slice' WHEN 1 THEN 'score_range' WHEN 2 THEN "
    "'rationale_length' WHEN 3 THEN 'empty_span' WHEN 4 THEN 'unsourced' ELSE 'sourced_absence' END"
)


@register(with_expected(f"""
SELECT doc_id, {_BROKEN} AS violation FROM claims WHERE doc_id % 12 >= 6 UNION ALL
SELECT doc_id, 'wrong_slice' FROM claims WHERE doc_id % 12 >= 6 AND doc_id % 6 = 3"""))
def audit_claims(spark, sf):
    """Sound claims pass; in half of the templates one rule each is broken on purpose."""
    docs = _claims(spark, sf)
    claims = table_of(docs, "deadlines", "doc_id", "text")
    spoiled = claims.withColumn(
        "fault", F.expr(f"if(doc_id % 12 >= 6, {_BROKEN}, 'none')")
    ).selectExpr(
        "doc_id", "text", "char_start",
        "CASE fault WHEN 'unsourced' THEN 'FACT' WHEN 'sourced_absence' THEN 'MISSING' "
        "ELSE classification END as classification",
        "if(fault = 'score_range', 1.5D, score) as score",
        "if(fault = 'rationale_length', '', rationale) as rationale",
        "if(fault = 'empty_span', char_start, char_end) as char_end",
        "CASE fault WHEN 'unsourced' THEN NULL WHEN 'wrong_slice' THEN concat(evidence, '?') "
        "ELSE evidence END as evidence",
    )
    return K.audit_claims(spoiled)


@register(with_expected(
    "SELECT doc_id, char_start, CAST(score AS DOUBLE) AS score, score >= 0.75 AS is_actionable, "
    "score >= 0.35 AS is_reportable FROM claims"))
def actionable(spark, sf):
    claims = table_of(_claims(spark, sf), "deadlines", "doc_id")
    return K.actionable(claims).select(
        "doc_id", "char_start", "score", "is_actionable", "is_reportable")
