"""Queries over workspaces, quality reports and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from docplan.functions import spans as S
from docplan.functions.rows import table_of
from docplan.operators import quality as Q
from docplan.operators import usage as U
from docplan.operators import workspace as Ws
from docplan.operators.classify import classify_documents
from docplan.plans.analysis import analyse
from docplan.queries import expected as E
from docplan.queries.expected import with_expected
from docplan.queries.registry import register
from docplan.sources.notices import SENTENCES, TODAY, long_date, notices
from docplan.streaming import quota

# --- workspace: events as a write log ---------------------------------------


def _workspace(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "user_id as owner_id", "event_id as doc_id", "concat('file-', event_id) as filename",
        "sha2(cast(event_id as string), 256) as content_hash",
        "cast(array() as array<string>) as completed", "cast(NULL as string) as profile",
        "event_id as sequence", "event_id as written")


_WS = """
ws AS (SELECT user_id AS owner_id, event_id AS doc_id, concat('file-', event_id) AS filename,
  event_id AS sequence FROM events)"""


@register("""
SELECT event_id AS doc_id, user_id AS owner_id, CASE WHEN event_id % 3 = 0 THEN concat('new-', event_id)
  ELSE concat('file-', event_id) END AS filename, sha256(CAST(event_id AS STRING)) AS content_hash,
  CASE WHEN event_id % 3 = 0 THEN 'action-1' ELSE '' END AS completed, event_id AS sequence FROM events
UNION ALL SELECT event_id + 50000000, user_id, concat('new-', event_id), 'fresh', 'action-1',
  event_id + 100000000 FROM events WHERE event_id % 3 <> 0""")
def apply_uploads(spark, sf):
    """Every event uploads once more: every third one its own document, the others a new one."""
    uploads = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "user_id as owner_id", "if(event_id % 3 = 0, event_id, event_id + 50000000) as doc_id",
        "concat('new-', event_id) as filename",
        "'fresh' as content_hash", "array('action-1') as completed", "'p' as profile",
        "event_id + 100000000 as arrival")
    return Ws.apply_uploads(_workspace(spark, sf), uploads).selectExpr(
        "doc_id", "owner_id", "filename", "content_hash",
        "array_join(completed, ',') as completed", "sequence")


@register(f"""
WITH {_WS} SELECT owner_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY
  sequence DESC) AS rank FROM ws) WHERE rank <= 20""")
def recent_documents(spark, sf):
    return Ws.recent_documents(_workspace(spark, sf)).select("owner_id", "doc_id", "rank")


@register(f"""
WITH {_WS} SELECT e.event_id AS request_id, e.event_id // 3 AS doc_id, e.user_id AS owner_id,
  w.doc_id IS NOT NULL AS found FROM events e LEFT JOIN ws w ON w.doc_id = e.event_id // 3 AND w.owner_id =
  e.user_id""")
def owner_scoped(spark, sf):
    requests = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "event_id as request_id", "event_id div 3 as doc_id", "user_id as owner_id")
    return Ws.owner_scoped(_workspace(spark, sf), requests).select(
        "request_id", "doc_id", "owner_id", "found")


def _erasures(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where(
        "event_type = 'error' OR (event_type = 'signup' AND user_id % 50 = 0)"
    ).selectExpr("user_id as owner_id", "if(event_type = 'error', event_id, NULL) as doc_id")


_ERASED = (
    "(SELECT event_id FROM events WHERE event_type = 'error')",
    "(SELECT user_id FROM events WHERE event_type = 'signup' AND user_id % 50 = 0)",
)


@register(f"""
WITH {_WS} SELECT owner_id, doc_id FROM ws WHERE doc_id NOT IN {_ERASED[0]} AND owner_id NOT IN
  {_ERASED[1]}""")
def erase(spark, sf):
    return Ws.erase(_workspace(spark, sf), _erasures(spark, sf)).select("owner_id", "doc_id")


@register(f"""
WITH {_WS} SELECT owner_id, count(*) AS removed FROM ws WHERE doc_id IN {_ERASED[0]} OR owner_id IN
  {_ERASED[1]} GROUP BY owner_id""")
def erased_counts(spark, sf):
    return Ws.erased_counts(_workspace(spark, sf), _erasures(spark, sf))


@register(f"""
WITH {_WS} SELECT owner_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'patched' WHEN doc_id % 3 <> 0 THEN
  'unchanged' WHEN doc_id % 4 = 1 THEN 'rejected' ELSE 'patched' END AS status,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 4 = 1 THEN 'action-9' ELSE '' END AS unknown,
  CASE WHEN doc_id % 2 = 0 THEN 'action-2' WHEN doc_id % 3 = 0 AND doc_id % 4 <> 1 THEN 'action-1'
  ELSE '' END AS completed, CASE WHEN doc_id % 3 <> 0 OR doc_id % 4 = 1 THEN '' WHEN doc_id % 5 = 0 THEN ''
  ELSE 'year 2' END AS profile FROM ws
UNION ALL SELECT owner_id + 1000000, doc_id, 'not_found', '', '', '' FROM ws WHERE doc_id % 7 = 0""")
def apply_patches(spark, sf):
    """Every third document has a patch (some name an unknown action), every second a later one that
    leaves the profile alone, every seventh one of somebody who does not own it."""
    base = _workspace(spark, sf)
    patches = base.where("doc_id % 3 = 0").selectExpr(
        "owner_id", "doc_id", "1 as arrival",
        "if(doc_id % 4 = 1, array('action-9'), array('action-1')) as completed",
        "'year 2' as profile", "doc_id % 5 = 0 as clear_profile"
    ).unionByName(base.where("doc_id % 2 = 0").selectExpr(
        "owner_id", "doc_id", "2 as arrival", "array('action-2') as completed",
        "cast(NULL as string) as profile", "false as clear_profile")
    ).unionByName(base.where("doc_id % 7 = 0").selectExpr(
        "owner_id + 1000000 as owner_id", "doc_id", "3 as arrival", "array('action-1') as completed",
        "'x' as profile", "false as clear_profile"))
    plans = base.selectExpr("doc_id", "array('action-1', 'action-2') as action_ids")
    return Ws.apply_patches(base, patches, plans).selectExpr(
        "owner_id", "doc_id", "status", "array_join(unknown, ',') as unknown",
        "coalesce(array_join(completed, ','), '') as completed", "coalesce(profile, '') as profile")


@register(f"WITH {_WS} SELECT doc_id FROM ws ORDER BY sequence DESC LIMIT 64")
def retain_newest(spark, sf):
    return Ws.retain_newest(_workspace(spark, sf)).select("doc_id")


# --- quality ----------------------------------------------------------------
# Gold labels come from the columns of the notices, with planted errors: the
# value of every tenth document is a day off.

_GOLD_DATE = S.when(
    ("tpl IN (0, 6, 7)", "array(" + S.struct(
        value="date_add(due, if(doc_id % 10 = 0, 1, 0))",
        char_start=f"instr(text, {long_date('due')}) - 1",
        char_end=f"instr(text, {long_date('due')}) - 1 + char_length({long_date('due')})") + ")"),
    otherwise=S.empty("struct<value:date,char_start:int,char_end:int>"),
)


def _labelled(spark, sf):
    docs = notices(spark, sf).drop("issued")
    return analyse(docs, TODAY).selectExpr("*", f"{_GOLD_DATE} as gold_dates")


def _date_tallies(spark, sf):
    docs = _labelled(spark, sf)
    found = S.keep("temporal", lambda e: f"{e}.resolved IS NOT NULL")
    preds = S.transform(found, lambda e: S.struct(
        value=f"{e}.resolved", char_start=f"{e}.char_start", char_end=f"{e}.char_end"))
    matched = docs.selectExpr("doc_id", "tpl", "gold_dates", f"{preds} as preds").selectExpr(
        "*", f"{Q.match_in_order('gold_dates', 'preds', Q.span_fit(True))} as matches")
    counts = S.let_all(["gold_dates", "preds", "matches"], Q.outcome_counts)
    return matched.selectExpr("doc_id", "tpl", f"{counts} as t").selectExpr("doc_id", "tpl", "t.*")


_DATE_TALLY = """
SELECT n.doc_id, tpl, CASE WHEN tpl IN (0, 6, 7) AND doc_id % 10 <> 0 THEN 1 ELSE 0 END AS tp,
  coalesce(c, 0) - CASE WHEN tpl IN (0, 6, 7) AND doc_id % 10 <> 0 THEN 1 ELSE 0 END AS fp,
  CASE WHEN tpl IN (0, 6, 7) AND doc_id % 10 = 0 THEN 1 ELSE 0 END AS fn
FROM n LEFT JOIN (SELECT doc_id, count(*) AS c FROM dates GROUP BY 1) d USING (doc_id)"""


@register("""
SELECT doc_id, quote, CASE doc_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'not_found' ELSE CASE WHEN
  strpos(substr(text, strpos(text, quote) + 1), quote) > 0 THEN 'ambiguous' ELSE 'ok' END END AS status
FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'zzqx not there' WHEN 2 THEN
  left(text, 40) ELSE left(text, 3) END AS quote FROM documents)""")
def resolve_gold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = docs.selectExpr(
        "doc_id", "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'zzqx not there' WHEN 2 THEN "
        "left(text, 40) ELSE left(text, 3) END as quote")
    return Q.resolve_gold(labels, docs).select("doc_id", "quote", "status")


@register(with_expected(f"SELECT doc_id, tp, fp, fn FROM ({_DATE_TALLY})"))
def match_spans(spark, sf):
    return _date_tallies(spark, sf).drop("tpl")


@register(with_expected("""
SELECT n.doc_id, CASE WHEN tpl = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 2 END ELSE 0 END AS tp,
  coalesce(c, 0) - CASE WHEN tpl = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 2 END ELSE 0 END AS fp,
  CASE WHEN tpl = 0 AND doc_id % 10 = 0 THEN 1 ELSE 0 END AS fn,
  CASE WHEN tpl = 0 THEN CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 2 END - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END ELSE 0 END AS kind_tp,
  CASE WHEN tpl = 0 AND doc_id % 7 = 0 THEN 1 ELSE 0 END AS kind_fp,
  CASE WHEN tpl = 0 AND doc_id % 10 = 0 THEN 1 ELSE 0 END AS kind_fn FROM n LEFT JOIN (SELECT doc_id,
  count(DISTINCT r) AS c FROM (SELECT doc_id, unnest(string_split(requires, '|')) AS r FROM acts WHERE
  requires <> '') GROUP BY 1) a USING (doc_id)"""))
def match_requirements(spark, sf):
    """Two labelled requirements per numbered notice, one misnamed in every tenth, one of another kind in every seventh."""
    gold = S.when(
        ("tpl = 0", "array(named_struct('text', 'the allotment form', 'kind', if(doc_id % 7 = 0, 'information', 'document')), "
         "named_struct('text', if(doc_id % 10 = 0, 'zonal bond', art1), 'kind', 'document'))"),
        otherwise=S.empty("struct<text:string,kind:string>"))
    docs = _labelled(spark, sf).selectExpr("doc_id", "requirements", f"{gold} as gold")
    return docs.selectExpr("doc_id", f"{Q.match_requirements('gold', 'requirements')} as t").selectExpr("doc_id", "t.*")


@register(with_expected("""
SELECT doc_id, CASE WHEN tpl = 9 THEN 1 ELSE 0 END AS tp, CASE WHEN tpl = 9 THEN 6 ELSE 0 END AS fp,
  CASE WHEN tpl = 9 THEN 1 ELSE 0 END AS fn FROM n"""))
def match_conditions(spark, sf):
    """Gold: a year floor, an age ceiling (wrong comparator) and a second year condition."""
    gold = S.when(
        ("tpl = 9", "array(named_struct('attribute', 'year', 'comparator', 'at_least'), "
         "named_struct('attribute', 'age', 'comparator', 'at_most'), "
         "named_struct('attribute', 'year', 'comparator', 'equals'))"),
        otherwise=S.empty("struct<attribute:string,comparator:string>"))
    docs = _labelled(spark, sf).selectExpr("doc_id", "criteria", f"{gold} as gold")
    return docs.selectExpr("doc_id", f"{Q.match_conditions('gold', 'criteria')} as t").selectExpr(
        "doc_id", "t.*")


_RATES = """
tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS precision, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS
recall, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1"""


@register(with_expected(f"""
SELECT tpl, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1
FROM (SELECT *, {_RATES} FROM (SELECT tpl, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
  CAST(sum(fn) AS BIGINT) AS fn FROM ({_DATE_TALLY}) GROUP BY tpl))"""))
def precision_recall(spark, sf):
    rated = Q.precision_recall(_date_tallies(spark, sf), "tpl")
    return rated.selectExpr(
        "tpl", "tp", "fp", "fn", "round(precision, 9) as precision", "round(recall, 9) as recall",
        "round(f1, 9) as f1")


@register(with_expected(f"""
SELECT CASE WHEN grouping(stage) = 1 THEN '(all)' ELSE stage END AS stage, tag, CAST(sum(tp) AS BIGINT) AS tp,
  CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'early'
  WHEN 1 THEN 'late' END AS stage, unnest(['(all)', concat('t', tpl), CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE
  'odd' END]) AS tag, tp, fp, fn FROM ({_DATE_TALLY})) GROUP BY GROUPING SETS ((stage, tag), (tag))"""))
def stage_and_tag_totals(spark, sf):
    """Two stages and notices of none, each with two tags."""
    tagged = _date_tallies(spark, sf).selectExpr(
        "CASE doc_id % 3 WHEN 0 THEN 'early' WHEN 1 THEN 'late' END as stage",
        "array(concat('t', tpl), if(doc_id % 2 = 0, 'even', 'odd')) as tags", "tp", "fp", "fn")
    return Q.stage_and_tag_totals(tagged)


@register(with_expected("""
SELECT doc_id, CASE WHEN tpl = 7 THEN 3 ELSE 0 END AS tp, coalesce(c, 0) - CASE WHEN tpl = 7 THEN 3 ELSE 0
  END AS fp, 0 AS fn FROM n LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE optional OR conditional_on IS
  NOT NULL) AS c FROM acts GROUP BY 1) a USING (doc_id)"""))
def modality_score(spark, sf):
    """Gold marks the three restricted or optional steps of template 7 only."""

    def gold(name: str, conditional: str, optional: str) -> str:
        sentence = SENTENCES[name]
        return S.struct(
            char_start=f"instr(text, {sentence}) - 1",
            char_end=f"instr(text, {sentence}) - 1 + char_length({sentence})",
            conditional=conditional, optional=optional)

    labels = S.when(
        ("tpl = 7", S.array([gold("attach", "true", "false"), gold("outside", "true", "false"),
                             gold("sample", "false", "true")])),
        otherwise=S.empty("struct<char_start:int,char_end:int,conditional:boolean,optional:boolean>"))
    docs = _labelled(spark, sf).selectExpr("doc_id", "actions", f"{labels} as gold")
    return docs.selectExpr("doc_id", f"{Q.modality_score('gold', 'actions')} as t").selectExpr(
        "doc_id", "t.*")


@register(with_expected("""
SELECT count(*) AS documents, avg(CASE WHEN type = CASE WHEN doc_id % 10 = 0 THEN 'policy' ELSE type END
  THEN 1.0 ELSE 0.0 END) AS accuracy FROM types"""))
def type_accuracy(spark, sf):
    """Predicted types against labels that call every tenth document a policy."""
    docs = notices(spark, sf)
    gold = docs.selectExpr("doc_id", f"{E.TYPES} as true_type").selectExpr(
        "doc_id", "if(doc_id % 10 = 0, 'policy', true_type) as gold_type")
    return Q.type_accuracy(classify_documents(docs).join(gold, "doc_id"))


@register(with_expected("""
SELECT least(floor(score * 10) / 10, 0.9) AS bucket, count(*) AS n, round(avg(score), 6) AS claimed,
  round(avg(CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS actual, round(avg(score), 6) -
  round(avg(CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) > 0.15 AS overconfident FROM claims
GROUP BY 1"""))
def calibration(spark, sf):
    """Deadline claims, of which those of every fourth document are held wrong."""
    docs = _labelled(spark, sf)
    claims = table_of(docs, "deadlines", "doc_id").selectExpr(
        "score as confidence", "doc_id % 4 != 0 as correct")
    return Q.calibration(claims)


@register("""
SELECT arm, stage, tp, fp, fn, round(tp / (tp + fp), 9) AS precision FROM (
  SELECT 'rules' AS arm, l_returnflag AS stage, count(*) AS tp, CAST(sum(CASE WHEN l_linenumber > 4 THEN 1
   ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM lineitem GROUP BY l_returnflag)""")
def ablation(spark, sf):
    """Two arms over the order lines; the second lacks the response to one order in a thousand."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "explode(array('rules', 'hybrid')) as arm", "l_returnflag as stage", "1 as tp",
        "if(l_linenumber > 4, 1, 0) as fp", "if(l_quantity > 25, 1, 0) as fn")
    orders = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "explode(array('rules', 'hybrid')) as arm", "o_orderkey as doc_id")
    answered = orders.where("arm = 'rules' OR doc_id % 1000 != 7")
    return Q.ablation(lines, orders, answered).selectExpr(
        "arm", "stage", "tp", "fp", "fn", "round(precision, 9) as precision")


# --- usage ------------------------------------------------------------------


_QUOTA_SQL = """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, epoch(ts) AS t, row_number() OVER (
  PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS taken, CAST(NULL AS BIGINT) AS event_id,
  CAST(NULL AS TIMESTAMP) AS ts, true AS accepted, 0 AS retry_after FROM events UNION ALL
  SELECT user_id, n, CASE WHEN len(still) < 3 THEN list_append(still, t) ELSE still END, event_id, ts, len(still) < 3,
    CASE WHEN len(still) < 3 THEN 0 ELSE CAST(trunc(28800 - (t - still[1])) AS INT) + 1 END
  FROM (SELECT e.*, list_filter(w.taken, lambda x: e.t - x <= 28800) AS still
    FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT user_id, event_id, ts, accepted, retry_after FROM walk WHERE n > 0"""


@register(_QUOTA_SQL)
def quota_audit(spark, sf):
    """At most three events per user in eight hours."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts")
    return U.quota_audit(events, allowance=3, window_seconds=8 * 3600)


@register(_QUOTA_SQL)
def quota_audit_stream(spark, sf):
    """The same decisions by keyed state over a stream of the events."""
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a file or a folder
    return quota.audited(events, allowance=3, window_seconds=8 * 3600)


@register("""
WITH RECURSIVE e AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS TIMESTAMP[]) AS taken, CAST(NULL AS BIGINT) AS event_id,
  CAST(NULL AS TIMESTAMP) AS ts, true AS accepted, 0 AS retry_after UNION ALL
  SELECT n, CASE WHEN len(still) < 40 THEN list_append(still, ts) ELSE still END, event_id, ts, len(still) < 40,
    CASE WHEN len(still) < 40 THEN 0 ELSE CAST((14400000000 - date_diff('microsecond', still[1], ts)) // 1000000 AS INT) + 1 END
  FROM (SELECT e.*, list_filter(w.taken, lambda x: date_diff('microsecond', x, e.ts) <= 14400000000) AS still
    FROM walk w JOIN e ON e.n = w.n + 1))
SELECT event_id, ts, accepted, retry_after FROM walk WHERE n > 0""")
def quota_audit_one_user(spark, sf):
    """All events as those of one user who never rests: its run is cut into blocks of 500 events."""
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("0L as user_id", "event_id", "ts")
    return U.quota_audit(events, allowance=40, window_seconds=4 * 3600, block_events=500).drop("user_id")


@register("""
SELECT count(*) AS requests, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS input_tokens,
  CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS cache_read_tokens,
  round(sum(CAST(json_extract(props, '$.k') AS BIGINT)) / (sum(CAST(floor(value) AS BIGINT)) +
  sum(CAST(json_extract(props, '$.k') AS BIGINT))), 3) AS cache_hit_rate FROM events""")
def usage_rollup(spark, sf):
    usage = spark.read.parquet(f"{sf}/events.parquet").selectExpr(
        "cast(floor(value) as bigint) as input_tokens", "cast(NULL as bigint) as output_tokens",
        "from_json(props, 'k bigint').k as cache_read_tokens")
    return U.usage_rollup(usage).drop("output_tokens")
