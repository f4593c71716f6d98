"""Queries over schedules, revisions, portfolios and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.rows import table_of
from docplan.functions.storage import settled
from docplan.operators import outputs as O
from docplan.operators import pages as Pages
from docplan.operators import portfolio as Z
from docplan.operators import revisions as V
from docplan.operators.proposals import GAP_REASON
from docplan.plans import schedule as P
from docplan.plans.analysis import analyse, with_dates, with_plan
from docplan.plans.repeated import analysed_versions, distinct_texts, distinct_versions, per_document
from docplan.queries import expected as E
from docplan.queries.expected import with_expected
from docplan.queries.registry import register
from docplan.sources.notices import REISSUED, TODAY, long_date, notices, plain_notices, profiled_notices, spread

# --- action graphs, one per order -------------------------------------------
# Action i of order k: effort, deadline and prerequisites by arithmetic on k and i.

_N = "CAST(o_orderkey % 7 + 2 AS INT)"
_DEADLINE = (
    "CASE WHEN i = n OR (k + i) % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(i * 5 AS INT) END"
)
_EFFORT = "CAST((k + i * 3) % 6 + 1 AS INT)"
_CLASS = "CASE WHEN (k + i) % 9 = 0 THEN 'UNCERTAIN' ELSE 'FACT' END"
_ON_PREVIOUS = "i > 1 AND (k + i) % 4 <> 0"
_ON_SECOND = "i > 2 AND (k + i) % 3 = 0"


def graphs(spark, sf, cyclic: bool = False):
    """``doc_id, actions, completed`` with dangling and self edges, every eleventh one cyclic if asked."""
    orders = spread(
        spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate")
    )
    action = S.struct(
        action_id="concat('a', i)", deadline=_DEADLINE, effort_days=_EFFORT,
        classification=_CLASS,
        depends_on="array_compact(array("
        f"if({_ON_PREVIOUS}, concat('a', i - 1), NULL), if({_ON_SECOND}, concat('a', i - 2), NULL), "
        "if(i = 1 AND k % 5 = 0, 'zz', NULL), if(i = 2 AND k % 4 = 0, 'a2', NULL), "
        f"if({str(cyclic).lower()} AND i = 1 AND k % 11 = 0, concat('a', n), NULL)))",
    )
    rows = orders.selectExpr("o_orderkey as k", "o_orderdate", f"{_N} as n")
    return rows.selectExpr(
        "k as doc_id", f"transform(sequence(1, n), i -> {action}) as actions",
        "if(k % 2 = 0, array('a1', 'a3'), array('a2')) as completed",
    )


_G = f"""
orders_n AS (SELECT o_orderkey AS k, o_orderdate, {_N} AS n FROM orders),
g AS (SELECT k, k AS doc_id, n, i, concat('a', CAST(i AS STRING)) AS id, {_DEADLINE} AS deadline,
  {_EFFORT} AS effort, {_CLASS} AS classification,
  CASE WHEN k % 2 = 0 THEN i IN (1, 3) ELSE i = 2 END AS done
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM orders_n)),
e AS (SELECT doc_id, i, i - 1 AS j FROM g WHERE {_ON_PREVIOUS} UNION ALL
  SELECT doc_id, i, i - 2 FROM g WHERE {_ON_SECOND}),
depth AS (SELECT doc_id, i, 0 AS d FROM g UNION ALL
  SELECT e.doc_id, e.i, depth.d + 1 FROM depth JOIN e ON e.doc_id = depth.doc_id AND e.j = depth.i),
due AS (SELECT doc_id, i, deadline AS d FROM g WHERE deadline IS NOT NULL UNION ALL
  SELECT e.doc_id, e.j, due.d - g.effort FROM due JOIN e ON e.doc_id = due.doc_id AND e.i = due.i
  JOIN g ON g.doc_id = due.doc_id AND g.i = due.i),
listed AS (SELECT doc_id, max(n) AS n, list(struct_pack(undated := CASE WHEN deadline IS NULL THEN 1
    ELSE 0 END, deadline := deadline, neg := -effort, id := id, deps := coalesce((SELECT list(concat(
    'a', CAST(j AS STRING))) FROM e WHERE e.doc_id = g.doc_id AND e.i = g.i), []))) AS nodes
  FROM g GROUP BY doc_id),
topo AS (SELECT doc_id, n, nodes, CAST([] AS VARCHAR[]) AS done FROM listed UNION ALL
  SELECT doc_id, n, nodes, list_append(done, list_sort(list_filter(nodes, lambda x:
    NOT list_contains(done, x.id) AND len(list_filter(x.deps, lambda d: NOT list_contains(done, d)))
    = 0))[1].id) FROM topo WHERE len(done) < n),
placed AS (SELECT doc_id, unnest(done) AS id, generate_subscripts(done, 1) - 1 AS ord FROM topo
  WHERE len(done) = n),
s AS (SELECT g.*, CAST(p.ord AS INT) AS ord, CAST(dp.d AS INT) AS depth, du.d AS effective,
    du.d - g.effort AS latest, datediff('day', {E.TODAY}, du.d - g.effort) AS slack,
    EXISTS (SELECT 1 FROM e WHERE e.doc_id = g.doc_id AND e.j = g.i) AS blocks,
    coalesce((SELECT string_agg(concat('a', CAST(j AS STRING)), ',' ORDER BY j) FROM e JOIN g h ON
      h.doc_id = e.doc_id AND h.i = e.j WHERE e.doc_id = g.doc_id AND e.i = g.i AND NOT h.done), '')
      AS blocked_by
  FROM g JOIN placed p ON p.doc_id = g.doc_id AND p.id = g.id
  LEFT JOIN (SELECT doc_id, i, max(d) AS d FROM depth GROUP BY ALL) dp ON dp.doc_id = g.doc_id AND
    dp.i = g.i
  LEFT JOIN (SELECT doc_id, i, min(d) AS d FROM due GROUP BY ALL) du ON du.doc_id = g.doc_id AND
    du.i = g.i)
"""


def _sql(body: str) -> str:
    return f"WITH RECURSIVE {_G} {body}"


_DAYS = "concat(CAST(abs(slack) AS STRING), CASE WHEN abs(slack) = 1 THEN ' day' ELSE ' days' END)"
_SOURCE = (
    "concat(CASE WHEN effective IS NOT DISTINCT FROM deadline THEN 'Stated deadline of ' ELSE "
    "'Governed by a dependent action''s deadline of ' END, CAST(effective AS STRING), '.')"
)
_PRIORITY = (
    "CASE WHEN classification = 'UNCERTAIN' OR slack IS NULL THEN 'low' WHEN slack < 0 THEN 'overdue' "
    "WHEN slack <= 2 THEN 'critical' WHEN slack <= 7 THEN 'high' WHEN slack <= 21 THEN 'medium' ELSE "
    "'low' END"
)
_WHY = (
    "CASE WHEN classification = 'UNCERTAIN' THEN 'Held back because the action itself is unconfirmed "
    "— verify it before scheduling.' WHEN slack IS NULL THEN 'No deadline governs this action, "
    "directly or through anything that depends on it.' WHEN slack < 0 THEN "
    f"concat({_SOURCE}, ' Needed to start ', {_DAYS}, ' ago to finish in time.') WHEN slack <= 2 THEN "
    f"concat({_SOURCE}, ' Must start ', CASE WHEN slack = 0 THEN 'today' ELSE concat('within ', "
    f"{_DAYS}) END, '.') ELSE concat({_SOURCE}, ' ', {_DAYS}, ' of buffer.', CASE WHEN slack <= 7 "
    "AND blocks THEN ' It also blocks later work.' ELSE '' END) END"
)


def _plan(spark, sf, cyclic=False):
    return P.with_schedule(graphs(spark, sf, cyclic), TODAY, passed_on=[])


def _steps(spark, sf):
    return table_of(_plan(spark, sf), "schedule", "doc_id")


@register(_sql("""
SELECT doc_id, 'a1' AS node, 'zz' AS dep FROM (SELECT DISTINCT doc_id FROM g) WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'a2', 'a2' FROM (SELECT DISTINCT doc_id FROM g) WHERE doc_id % 4 = 0"""))
def prune_dangling(spark, sf):
    pruned = graphs(spark, sf).selectExpr("doc_id", f"{P.graph_of('actions')} as graph")
    return table_of(pruned, "graph.dangling", "doc_id")


@register()
def break_cycles(spark, sf):
    """Edges cut from the cyclic orders (about one in eleven)."""
    return table_of(P.with_graph(graphs(spark, sf, cyclic=True)), "broken_edges", "doc_id")


@register(_sql("SELECT doc_id, id AS action_id, CAST(ord AS INT) AS ord FROM placed"))
def topological_order(spark, sf):
    ordered = graphs(spark, sf).selectExpr("doc_id", f"{P.graph_of('actions')} as g").selectExpr(
        "doc_id", f"{P.topological_order('g.nodes')} as ids")
    placed = ordered.selectExpr("doc_id", "posexplode_outer(ids) as (ord, action_id)")
    return placed.where("ord IS NOT NULL").select("doc_id", "action_id", "ord")


@register(_sql("SELECT doc_id, id AS action_id, depth FROM s"))
def depths(spark, sf):
    return _steps(spark, sf).select("doc_id", "action_id", "depth")


@register(_sql("SELECT doc_id, id AS action_id, effective AS effective_deadline FROM s"))
def propagate_deadlines(spark, sf):
    return _steps(spark, sf).select("doc_id", "action_id", "effective_deadline")


@register(_sql("""
SELECT doc_id, id AS action_id, latest AS latest_start, CAST(slack AS STRING) AS slack_days FROM s"""))
def latest_start_slack(spark, sf):
    return _steps(spark, sf).selectExpr(
        "doc_id", "action_id", "latest_start", "cast(slack_days as string) as slack_days")


@register(_sql(f"""
SELECT doc_id, id AS action_id, {_PRIORITY} AS priority, {_WHY} AS rationale FROM s"""))
def prioritize(spark, sf):
    return _steps(spark, sf).select("doc_id", "action_id", "priority", "rationale")


@register(_sql("SELECT doc_id, id AS action_id, blocked_by FROM s WHERE blocked_by <> ''"))
def blocked_by(spark, sf):
    return _steps(spark, sf).where("size(blocked_by) > 0").selectExpr(
        "doc_id", "action_id", "array_join(blocked_by, ',') as blocked_by")


@register(_sql("""
SELECT doc_id, id AS action_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN slack IS NULL
  THEN 1 ELSE 0 END, coalesce(slack, 0), ord) AS rank FROM s WHERE NOT done AND blocked_by = ''"""))
def next_actions(spark, sf):
    ready = _plan(spark, sf).selectExpr("doc_id", f"{P.next_actions('schedule')} as ready")
    return table_of(ready, "ready", "doc_id", position="pos").selectExpr(
        "doc_id", "action_id", "pos + 1 as rank")


@register(_sql("""
SELECT doc_id, bool_and(done OR slack IS NULL OR slack >= 0) AS feasible FROM s GROUP BY doc_id"""))
def is_feasible(spark, sf):
    return _plan(spark, sf).selectExpr("doc_id", f"{P.is_feasible('schedule')} as feasible")


@register(with_expected("""
SELECT n.doc_id, coalesce(g.c, 0) + coalesce(s.c, 0) AS unresolved FROM n
LEFT JOIN (SELECT doc_id, count(DISTINCT question) AS c FROM gaps GROUP BY 1) g ON g.doc_id = n.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS c FROM sched WHERE classification = 'UNCERTAIN' GROUP BY 1) s
  ON s.doc_id = n.doc_id"""))
def unresolved_count(spark, sf):
    return analyse(plain_notices(spark, sf), TODAY).select(
        "doc_id", F.col("unresolved_count").alias("unresolved"))


@register(_sql(f"""
SELECT doc_id, id AS action_id, ord, depth, effective AS effective_deadline, latest AS latest_start,
  blocked_by, blocks AS blocks_others, {_PRIORITY} AS priority, {_WHY} AS rationale FROM s"""))
def build_plan(spark, sf):
    return _steps(spark, sf).selectExpr(
        "doc_id", "action_id", "ord", "depth", "effective_deadline", "latest_start",
        "array_join(blocked_by, ',') as blocked_by", "blocks_others", "priority", "rationale")


@register()
def build_plan_cyclic(spark, sf):
    """Plans of all orders, cyclic ones repaired first."""
    return table_of(_plan(spark, sf, cyclic=True), "schedule", "doc_id").selectExpr(
        "doc_id", "action_id", "ord", "depth", "effective_deadline", "latest_start", "priority")


@register(with_expected(f"""
SELECT doc_id, action_id, effective_deadline, latest_start, depends_on, depth,
  CAST(datediff('day', {E.TODAY}, latest_start) AS STRING) AS slack_days FROM sched"""))
def notice_plan(spark, sf):
    """The plan of every notice, from its text."""
    docs = with_plan(with_dates(plain_notices(spark, sf), TODAY), TODAY)
    return table_of(docs, "schedule", "doc_id").selectExpr(
        "doc_id", "action_id", "effective_deadline", "latest_start",
        "array_join(depends_on, ',') as depends_on", "depth",
        "cast(slack_days as string) as slack_days")


# --- revisions --------------------------------------------------------------
# Version 1 is the notice, version 2 its reissue; expected values by columns.


def _versions(spark, sf, *columns: str):
    """The analyses' columns of both versions as structs ``p`` and ``c``; each pair of texts is analysed once for its ``doc_ids``."""
    texts = distinct_versions(plain_notices(spark, sf), plain_notices(spark, sf, REISSUED))
    return analysed_versions(texts, TODAY, *columns)


#: Primary deadline of a version: stated due date for these templates.
_NEXT2 = E.NEXT_DUE
_PRIM2 = f"""
SELECT a.doc_id, a.tpl, a.cust, a.p AS was, b.p AS now, b.added, a.due AS due1, b.due AS due2 FROM
 (SELECT *, CASE WHEN tpl IN (0, 2, 3, 6, 7) THEN due WHEN tpl = 1 THEN {_NEXT2} WHEN tpl = 4 THEN
   {E.RELATIVE} END AS p FROM n) a JOIN
 (SELECT *, CASE WHEN tpl IN (0, 2, 3, 6, 7) THEN due WHEN tpl = 1 THEN {_NEXT2} WHEN tpl = 4 THEN
   {E.RELATIVE} END AS p FROM n2) b ON a.doc_id = b.doc_id"""
_HUMAN = "strftime({}, '%d %B %Y')"
_GAP = "datediff('day', was, now)"
_DEADLINE_CHANGES = f"""
SELECT doc_id, 'deadline_moved' AS kind, CASE WHEN now < was THEN 'critical' ELSE 'notable' END AS
  severity, concat('The deadline moved ', CASE WHEN now < was THEN 'forward' ELSE 'back' END, ' by ',
  CAST(abs({_GAP}) AS STRING), CASE WHEN abs({_GAP}) = 1 THEN ' day' ELSE ' days' END, ', from ',
  {_HUMAN.format('was')}, ' to ', {_HUMAN.format('now')}, '.', CASE WHEN now < was THEN
  ' You have less time than the plan assumed.' ELSE '' END) AS summary, CAST(was AS STRING) AS before,
  CAST(now AS STRING) AS after FROM ({_PRIM2}) WHERE was <> now"""


@register(with_expected(_DEADLINE_CHANGES))
def deadline_changes(spark, sf):
    before = with_dates(plain_notices(spark, sf), TODAY).selectExpr(
        "doc_id", "primary_deadline.value as was")
    after = with_dates(plain_notices(spark, sf, REISSUED), TODAY).selectExpr(
        "doc_id", "primary_deadline.value as now")
    pairs = before.join(after, "doc_id", "full_outer")
    return table_of(pairs.selectExpr("doc_id", f"{V.deadline_change('was', 'now')} as c"), "c", "doc_id")


@register("""
SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 3 = 0 THEN 1.0::DOUBLE WHEN o_custkey % 3 = 1 THEN
  0.5 ELSE 0.0 END AS relatedness FROM orders""")
def relatedness(spark, sf):
    """Jaccard overlap of two short vocabularies per order."""
    docs = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey as doc_id", "'submit the income certificate and your passport' as a",
        "CASE o_custkey % 3 WHEN 0 THEN 'Passport: income certificate, submit!' WHEN 1 THEN "
        "'submit income' ELSE 'attend hostel allotment' END as b")
    score = S.let_all([V.identity("a"), V.identity("b")], V.jaccard)
    return docs.selectExpr("doc_id", f"{score} as relatedness")


@register()
def revision_relatedness(spark, sf):
    """How much of its vocabulary each notice shares with its reissue."""
    score = S.let_all([V.vocabulary("p"), V.vocabulary("c")], V.jaccard)
    versions = _versions(spark, sf, "document_type", "title", "schedule", "requirements", "gaps", "deadlines")
    return per_document(versions.selectExpr("doc_ids", f"round({score}, 3) as relatedness"))


@register()
def pair_findings(spark, sf):
    """Steps of both versions paired by wording."""
    paired = V.with_pairings(_versions(spark, sf, "schedule", "requirements"))
    return _changes(paired, "step_pairs.pairs", "l", "r")


def _changes(versions, changes: str, *columns: str):
    """The rows of one kind of change; other findings than those it compares are not looked for."""
    found = table_of(versions.selectExpr("doc_ids", f"{changes} as changes"), "changes", "doc_ids")
    return per_document(found.select("doc_ids", *columns))


@register(with_expected("""
SELECT doc_id, 'requirement_added' AS kind, 'critical' AS severity,
  'You now also need: Bank statement.' AS summary, 'Bank statement' AS after FROM n2
  WHERE tpl = 0 AND added <> ''
"""))
def requirement_changes(spark, sf):
    """A requirement the reissue adds; the moved date inside T2's wording pairs up."""
    paired = V.with_pairings(_versions(spark, sf, "schedule", "requirements"))
    changes = S.let_all(["requirement_pairs", "p.requirements", "c.requirements"], V.requirement_changes)
    return _changes(paired, changes, "kind", "severity", "summary", "after")


@register(with_expected(
    "SELECT doc_id, 'none' AS kind FROM n WHERE false"))
def action_changes(spark, sf):
    """No step is added or removed: reworded steps are recognised."""
    paired = V.with_pairings(_versions(spark, sf, "schedule", "requirements"))
    return _changes(paired, S.let_all(["step_pairs", "p.schedule", "c.schedule"], V.action_changes), "kind")


_STARTS = f"""
SELECT p.doc_id, s.action_no, s.description, p.tpl, s.latest_start AS was, s.latest_start +
  CAST(datediff('day', due1, due2) AS INT) AS now FROM sched s JOIN ({_PRIM2}) p ON p.doc_id = s.doc_id
WHERE p.tpl = 5 AND cust % 5 <> 0 AND due1 <> due2"""


@register(with_expected(f"""
SELECT doc_id, 'action_rescheduled' AS kind, CASE WHEN now < was THEN 'notable' ELSE 'minor' END AS
  severity, CAST(was AS STRING) AS before, CAST(now AS STRING) AS after FROM ({_STARTS})"""))
def reschedule_changes(spark, sf):
    """Only window ends move a start without moving the stated deadline."""
    paired = V.with_pairings(_versions(spark, sf, "schedule", "requirements", "primary_deadline"))
    shift = "datediff(c.primary_deadline.value, p.primary_deadline.value)"
    changes = S.let_all(["step_pairs", "p.schedule", "c.schedule", shift], V.reschedule_changes)
    return _changes(paired, changes, "kind", "severity", "before", "after")


@register(with_expected(
    "SELECT doc_id, 'none' AS kind FROM n WHERE false"))
def unchanged_conditions_and_gaps(spark, sf):
    """Conditions and open questions are the same in both versions."""
    versions = _versions(spark, sf, "criteria", "gaps")
    conditions = S.let_all(["p.criteria", "c.criteria"], V.condition_changes)
    gaps = S.let_all(["p.gaps", "c.gaps"], V.gap_changes)
    return _changes(versions, f"concat({conditions}, {gaps})", "kind")


def _flip(spark, sf, column: str):
    """Conditions or gaps of neighbouring scholarship/registration notices, compared."""
    docs = analyse(plain_notices(spark, sf), TODAY).select("doc_id", F.col(column).alias("found"))
    earlier = docs.where("doc_id % 24 < 12")
    later = docs.where("doc_id % 24 >= 12").selectExpr("doc_id - 12 as doc_id", "found as now")
    both = earlier.join(later, "doc_id", "full_outer")
    return both.selectExpr("doc_id", "coalesce(found, slice(now, 1, 0)) as found", "coalesce(now, slice(found, 1, 0)) as now")


@register(with_expected("""
SELECT a.doc_id, CASE WHEN side = 1 THEN 'condition_added' ELSE 'condition_removed' END AS kind,
  CASE WHEN side = 1 THEN 'critical' ELSE 'notable' END AS severity, requirement FROM (
  SELECT c.doc_id - 12 AS doc_id, 1 AS side, requirement FROM crit c WHERE c.doc_id % 24 >= 12 AND NOT
    EXISTS (SELECT 1 FROM crit d WHERE d.doc_id = c.doc_id - 12 AND d.requirement = c.requirement)
  UNION ALL SELECT c.doc_id, 0, requirement FROM crit c WHERE c.doc_id % 24 < 12 AND NOT EXISTS
    (SELECT 1 FROM crit d WHERE d.doc_id = c.doc_id + 12 AND d.requirement = c.requirement)
  ) a"""))
def condition_changes(spark, sf):
    """Conditions of a scholarship notice against the one twelve orders later."""
    pairs = _flip(spark, sf, "criteria").selectExpr(
        "doc_id", f"{S.let_all(['found', 'now'], V.condition_changes)} as c")
    return table_of(pairs, "c", "doc_id").selectExpr(
        "doc_id", "kind", "severity", "coalesce(after, before) as requirement")


@register(with_expected("""
SELECT a.doc_id, CASE WHEN side = 1 THEN 'gap_opened' ELSE 'gap_closed' END AS kind,
  CASE WHEN side = 1 THEN 'notable' ELSE 'minor' END AS severity, question FROM (
  SELECT c.doc_id - 12 AS doc_id, 1 AS side, question FROM gaps c WHERE c.doc_id % 24 >= 12 AND NOT
    EXISTS (SELECT 1 FROM gaps d WHERE d.doc_id = c.doc_id - 12 AND d.question = c.question)
  UNION ALL SELECT c.doc_id, 0, question FROM gaps c WHERE c.doc_id % 24 < 12 AND NOT EXISTS
    (SELECT 1 FROM gaps d WHERE d.doc_id = c.doc_id + 12 AND d.question = c.question)
  ) a"""))
def gap_changes(spark, sf):
    pairs = _flip(spark, sf, "gaps").selectExpr(
        "doc_id", f"{S.let_all(['found', 'now'], V.gap_changes)} as c")
    return table_of(pairs, "c", "doc_id").selectExpr(
        "doc_id", "kind", "severity", "coalesce(after, before) as question")


@register(with_expected(f"""
SELECT p.doc_id, CAST((was <> now) IS TRUE AS INT) + CAST(tpl = 0 AND added <> '' AS INT) +
  CAST(tpl = 5 AND cust % 5 <> 0 AND due1 <> due2 AS INT) AS changes,
  CASE WHEN was < now AND tpl = 0 AND added <> '' THEN 'You now also need: Bank statement.'
    WHEN was <> now THEN d.summary WHEN tpl = 0 AND added <> '' THEN
    'You now also need: Bank statement.' WHEN tpl = 5 AND cust % 5 <> 0 AND due1 <> due2 THEN
    '(rescheduled)' ELSE 'Nothing that affects your plan has changed.' END AS headline
FROM ({_PRIM2}) p LEFT JOIN ({_DEADLINE_CHANGES}) d ON d.doc_id = p.doc_id"""))
def compare_revisions(spark, sf):
    """Number of changes and the headline of every reissue."""
    return per_document(V.with_changes(_versions(spark, sf, *V.COMPARED), "doc_ids").selectExpr(
        "doc_ids", "size(changes) as changes",
        "if(startswith(headline, '“'), '(rescheduled)', headline) as headline"))


# --- portfolios: eight neighbouring orders ----------------------------------


def _members(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").selectExpr(
        "o_orderkey div 8 as portfolio_id", "o_orderkey as doc_id",
        "cast(o_orderkey % 8 as int) as pos", "concat('notice ', o_orderkey) as name")


def _portfolios(spark, sf):
    return Z.portfolio_rows(_members(spark, sf), analyse(plain_notices(spark, sf), TODAY))


_SUBJECT = f"""
subj AS (SELECT t.doc_id, list_distinct(list_filter(regexp_extract_all(lower(concat_ws(' ', h, d, r)),
   '[a-z]{{4,}}'), lambda w: NOT list_contains({list(L.SUBJECT_FILLER)!r}, w))) AS words, p.due
 FROM (SELECT doc_id, {E.HEADING} AS h FROM n) t
 LEFT JOIN (SELECT doc_id, string_agg(description, ' ') AS d, string_agg(requires, ' ') AS r FROM acts
   GROUP BY 1) a ON a.doc_id = t.doc_id LEFT JOIN prim p ON p.doc_id = t.doc_id),
pairs AS (SELECT l.doc_id // 8 AS portfolio_id, l.doc_id AS left_id, r.doc_id AS right_id, l.due AS
   left_due, r.due AS right_due, CASE WHEN least(len(l.words), len(r.words)) = 0 THEN 0.0 ELSE
   len(list_intersect(l.words, r.words)) / CAST(least(len(l.words), len(r.words)) AS DOUBLE) END AS rel
 FROM subj l JOIN subj r ON l.doc_id // 8 = r.doc_id // 8 AND l.doc_id < r.doc_id)"""


def _pairs_sql(body: str) -> str:
    return with_expected("").rstrip() + f", {_SUBJECT} {body}"


@register(_pairs_sql("""
SELECT portfolio_id, left_id, right_id, round(rel, 3) AS relatedness, rel >= 0.25 AS same_subject
FROM pairs WHERE rel > 0"""))
def subject_overlap(spark, sf):
    return Z.subject_overlap(_portfolios(spark, sf))


_DUE_CONFLICT = """
SELECT portfolio_id, left_id, right_id, left_due, right_due, round(rel, 3) AS relatedness,
  concat('Two documents about the same process state different deadlines: ', strftime(least(left_due,
  right_due), '%d %B %Y'), ' in notice ', CASE WHEN left_due < right_due THEN left_id ELSE right_id END,
  ', ', strftime(greatest(left_due, right_due), '%d %B %Y'), ' in notice ', CASE WHEN left_due <
  right_due THEN right_id ELSE left_id END, '.') AS summary,
  concat('Work to ', strftime(least(left_due, right_due), '%d %B %Y'), ' until the issuing office confirms which is current. The earlier date is the only one that cannot cost you the opportunity if it turns out to be the right one.') AS resolution
FROM pairs WHERE left_due <> right_due AND rel >= 0.25"""


@register(_pairs_sql(_DUE_CONFLICT))
def deadline_conflicts(spark, sf):
    return Z.deadline_conflicts(_portfolios(spark, sf))


@register(_pairs_sql("""
SELECT l.doc_id // 24 AS portfolio_id, l.doc_id AS left_id, r.doc_id AS right_id, l.attribute,
  l.requirement AS left_requirement, r.requirement AS right_requirement,
  'Assume the stricter of the two until the issuing office says otherwise, and ask which document supersedes the other.' AS resolution
FROM crit l JOIN crit r ON l.doc_id // 24 = r.doc_id // 24 AND l.doc_id < r.doc_id AND l.attribute =
  r.attribute WHERE l.attribute IN ('year', 'score', 'cgpa', 'age', 'category') AND l.requirement <>
  r.requirement"""))
def eligibility_conflicts(spark, sf):
    """Notices of 24 neighbouring orders; those about scholarships set different bars."""
    members = _members(spark, sf).withColumn("portfolio_id", F.expr("doc_id div 24")).withColumn(
        "pos", F.expr("cast(doc_id % 24 as int)"))
    texts = distinct_texts(plain_notices(spark, sf)).withColumn("doc_id", F.col("doc_ids"))
    once = settled(Z.compact(analyse(texts, TODAY)).withColumnRenamed("doc_id", "doc_ids"))
    barred = per_document(once.where("size(criteria) > 0"))  # a document without a bar conflicts with none
    return Z.eligibility_conflicts(Z.portfolio_rows(members, barred)).drop("relatedness", "summary")


_STEP_ROWS = (
    "SELECT doc_id // 8 AS portfolio_id, doc_id, action_id, concat('notice ', doc_id) AS name, "
    "latest_start, effective_deadline, deadline, row_number() OVER (PARTITION BY doc_id ORDER BY "
    "CASE WHEN deadline IS NULL THEN 1 ELSE 0 END, deadline, -effort_days, action_id) AS r, "
    "doc_id % 12 AS tpl, action_no FROM sched"
)
#: Ordering within a notice: only the sending step of template 6 has to wait for the first.
_ORD = "CASE WHEN tpl = 6 THEN CASE action_no WHEN 1 THEN 0 WHEN 4 THEN 1 ELSE action_no END ELSE r END"


def _portfolio_steps(spark, sf):
    return Z.portfolio_steps(_members(spark, sf), analyse(plain_notices(spark, sf), TODAY))


@register(with_expected(f"""
SELECT portfolio_id, doc_id, action_id, latest_start, row_number() OVER (PARTITION BY portfolio_id
  ORDER BY latest_start, name, {_ORD}, doc_id) AS pos FROM ({_STEP_ROWS}) WHERE latest_start IS NOT
  NULL"""))
def merged_timeline(spark, sf):
    return Z.merged_timeline(_portfolio_steps(spark, sf)).select(
        "portfolio_id", "doc_id", "action_id", "latest_start", "pos")


@register(with_expected(f"""
SELECT portfolio_id, doc_id, action_id FROM ({_STEP_ROWS}) WHERE latest_start IS NULL"""))
def undated_steps(spark, sf):
    return Z.undated_steps(_portfolio_steps(spark, sf)).select("portfolio_id", "doc_id", "action_id")


@register(_pairs_sql(f"""
SELECT s.portfolio_id, next_due, next_stated_deadline, d.portfolio_id IS NULL AS is_consistent FROM
 (SELECT p.portfolio_id, next_due, next_stated_deadline FROM (SELECT doc_id // 8 AS portfolio_id FROM n
   GROUP BY 1 HAVING count(DISTINCT doc_id) > 1) p LEFT JOIN (SELECT portfolio_id, min(effective_deadline) FILTER (WHERE latest_start IS NOT NULL) AS next_due,
   min(deadline) FILTER (WHERE latest_start IS NOT NULL) AS next_stated_deadline
  FROM ({_STEP_ROWS}) GROUP BY 1) x ON x.portfolio_id = p.portfolio_id) s LEFT JOIN (SELECT DISTINCT portfolio_id FROM ({_DUE_CONFLICT})) d
 ON d.portfolio_id = s.portfolio_id"""))
def portfolio_summary(spark, sf):
    analysed, members = analyse(plain_notices(spark, sf), TODAY), _members(spark, sf)
    once = settled(Z.compact(analysed, "schedule"))  # the notices are analysed once
    found = Z.portfolio_rows(members, once)
    conflicts = Z.deadline_conflicts(found).select("portfolio_id").unionByName(
        Z.eligibility_conflicts(found).select("portfolio_id"))
    return Z.portfolio_summary(members, Z.portfolio_steps(members, once), conflicts)


# --- outputs ----------------------------------------------------------------


def _named(spark, sf):
    docs = profiled_notices(spark, sf)
    return analyse(docs, TODAY).withColumn("name", F.concat(F.lit("notice "), "doc_id"))


@register(with_expected("""
SELECT doc_id, concat(doc_id, '-', action_id) AS event_id, latest_start AS starts, latest_start + 1 AS
  ends, concat('Start: ', description) AS summary, upper(verb) AS category, CASE WHEN score >= 0.75 THEN
  'CONFIRMED' ELSE 'TENTATIVE' END AS status FROM sched WHERE latest_start IS NOT NULL
UNION ALL SELECT p.doc_id, concat(p.doc_id, '-deadline'), due, due + 1, concat('Deadline: notice ',
  p.doc_id), '', CASE WHEN c.score >= 0.75 THEN 'CONFIRMED' ELSE 'TENTATIVE' END FROM prim p JOIN claims
  c ON c.doc_id = p.doc_id AND c.value = p.due"""))
def calendar_events(spark, sf):
    return O.calendar_events(_named(spark, sf)).selectExpr(
        "doc_id", "event_id", "starts", "ends", "summary", "coalesce(category, '') as category",
        "status")


@register()
def calendar_descriptions(spark, sf):
    docs = profiled_notices(spark, sf).select("doc_id", "text", "text_confidence", "source_kind")
    once = analyse(distinct_texts(docs), TODAY).select("doc_ids", "text", "schedule", "primary_deadline", "is_feasible")
    named = per_document(once).withColumn("name", F.concat(F.lit("notice "), "doc_id"))
    return O.calendar_events(named).select("event_id", "description")


_QUESTIONS = f"""
SELECT doc_id, count(*) AS c, string_agg(concat(CAST(i AS STRING), '. ', line), concat(chr(10), chr(10)) ORDER BY i) AS listed FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY part, place) AS i FROM (
    SELECT doc_id, 0 AS part, min(char_start) AS place, concat(question, chr(10), '   (the notice says "',
      arg_min(text, char_start), '")') AS line FROM gaps GROUP BY doc_id, question
    UNION ALL SELECT doc_id, 1, pos, concat('The notice is limited to ', requirement, '. Does that cover ', profile_value, '?')
      FROM (FINDINGS) WHERE match = 'unknown' AND profile_value IS NOT NULL)) GROUP BY doc_id"""
_TOPIC = E.HEADING.replace("doc_id", "n.doc_id")


@register(with_expected(f"""
SELECT n.doc_id, coalesce(q.c, 0) AS question_count, concat(CASE WHEN q.c IS NULL THEN 'Query regarding '
  ELSE 'Clarification needed: ' END, {_TOPIC}) AS subject,
  concat('Dear Sir/Madam,', chr(10), chr(10), 'I am writing with reference to ', {_TOPIC}, CASE WHEN q.c IS NULL THEN
    concat('.', chr(10), chr(10), 'The notice appears complete — there are no unanswered points to raise. This draft is here in case you want to confirm anything before submitting.')
    ELSE concat('. Before I can act on it I need to confirm a few points the notice does not state.', chr(10), chr(10), q.listed,
    chr(10), chr(10), 'I would be grateful for clarification on the above.', CASE WHEN p.due IS NULL THEN '' ELSE
    concat(' The stated deadline is ', strftime(p.due, '%d %B %Y'), ', so an early reply would help.') END) END,
    chr(10), chr(10), 'Thank you,', chr(10)) AS body
FROM n JOIN customer ON c_custkey = n.cust LEFT JOIN ({_QUESTIONS}) q ON q.doc_id = n.doc_id
LEFT JOIN prim p ON p.doc_id = n.doc_id"""))
def enquiry_drafts(spark, sf):
    """The whole letter of every notice: subject, questions and body."""
    return O.enquiry_drafts(_named(spark, sf)).select("doc_id", "question_count", "subject", "body")


def _insert_findings() -> None:
    from docplan.queries.extraction import _FINDINGS
    from docplan.queries.registry import ORACLES

    #: Every step pairs with itself: the reissue only moves dates and adds papers.
    place = f"CAST({_ORD} - CASE WHEN tpl = 6 THEN 0 ELSE 1 END AS INT)"
    ORACLES["pair_findings"] = with_expected(
        f"SELECT doc_id, {place} AS l, {place} AS r FROM ({_STEP_ROWS})")
    ORACLES["enquiry_drafts"] = ORACLES["enquiry_drafts"].replace("(FINDINGS)", f"({_FINDINGS})")


_insert_findings()


@register()
def enquiry_bodies(spark, sf):
    return O.enquiry_drafts(_named(spark, sf)).select("doc_id", "body")


@register(with_expected("""
SELECT n.doc_id, coalesce(d.c, 0) AS deadlines, coalesce(a.c, 0) AS actions, coalesce(g.c, 0) AS gaps,
  coalesce(c.c, 0) AS criteria, p.due AS primary_due, coalesce(s.ok, true) AS is_feasible
FROM n JOIN customer ON c_custkey = n.cust
LEFT JOIN (SELECT doc_id, count(*) AS c FROM claims GROUP BY 1) d ON d.doc_id = n.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS c FROM acts GROUP BY 1) a ON a.doc_id = n.doc_id
LEFT JOIN (SELECT doc_id, count(DISTINCT question) AS c FROM gaps GROUP BY 1) g ON g.doc_id = n.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS c FROM crit GROUP BY 1) c ON c.doc_id = n.doc_id
LEFT JOIN prim p ON p.doc_id = n.doc_id
LEFT JOIN (SELECT doc_id, bool_and(latest_start IS NULL OR latest_start >= DATE '1998-06-15') AS ok
  FROM sched GROUP BY 1) s ON s.doc_id = n.doc_id"""), "analyse")
def analyse_notices(spark, sf):
    """The wide row of every notice, counted."""
    return analyse(profiled_notices(spark, sf), TODAY).selectExpr(
        "doc_id", "size(deadlines) as deadlines", "size(schedule) as actions", "size(gaps) as gaps",
        "size(criteria) as criteria", "primary_deadline.value as primary_due", "is_feasible")


@register()
def analyse_documents(spark, sf):
    """The analysis over the supplied prose, which holds hardly any instruction."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id", "text", "1D as text_confidence", "'plain_text' as source_kind")
    return analyse(docs, TODAY).selectExpr(
        "doc_id", "document_type.value as document_type", "title.value as title",
        "size(deadlines) as deadlines", "size(schedule) as actions", "size(gaps) as gaps",
        "size(criteria) as criteria")


#: Responses of a proposing arm by template: verbatim, overlapping, loose and invented quotes, a requirement,
#: a response that is cut off, and one with a verb of no class.
_RESPONSES = """CASE tpl
 WHEN 0 THEN concat('{"actions":[{"instruction":"Note the date of issue","verb":"confirm","quote":"Dated ', ISSUED,
   '.","deadline_id":"date-1"}]}')
 WHEN 1 THEN '{"actions":[{"instruction":"Send it","verb":"submit","quote":"Candidates should upload the"}],"gaps":[{"question":"Which office issued this circular?","quote":"CIRCULAR"}]}'
 WHEN 2 THEN '{"actions":[{"instruction":"Cut off'
 WHEN 3 THEN '{"actions":[{"instruction":"Dance","verb":"dance","quote":"EXAMINATION NOTICE"}]}'
 WHEN 8 THEN '{"actions":[{"instruction":"Watch for details","verb":"confirm","quote":"Details would be announced shortly","deadline_id":"date-9"}]}'
 WHEN 9 THEN '{"requirements":[{"text":"Bond","quote":"Bring a signed bond of the zonal registrar within a fortnight"}]}'
 WHEN 10 THEN CASE WHEN variant = 0 THEN '{"requirements":[{"text":"Hall photograph","quote":"The hall was built in 1920"}]}' END
 END""".replace("ISSUED", long_date("issued"))


def _hybrid(spark, sf):
    docs = notices(spark, sf).selectExpr("doc_id", "text", "text_confidence", "source_kind", f"{_RESPONSES} as response")
    return analyse(docs, TODAY, proposals="response")


@register(with_expected("""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY char_start, arm, action_no) AS INT) AS action_no,
  description, round(least(confidence, text_confidence), 4) AS score, deadline FROM (
  SELECT doc_id, 0 AS arm, action_no, description, confidence, text_confidence, deadline, char_start FROM acts
  UNION ALL SELECT doc_id, 1, 0, 'Note the date of issue', 0.86, text_confidence, issued, strpos(text, 'Dated') - 1 FROM n WHERE tpl = 0
  UNION ALL SELECT doc_id, 1, 0, 'Watch for details', 0.55, text_confidence, NULL, strpos(text, 'Details will') - 1 FROM n WHERE tpl = 8)"""))
def analyse_hybrid(spark, sf):
    """Actions of the rules and of verified proposals, merged: the rules win where both found one."""
    return table_of(_hybrid(spark, sf), "actions", "doc_id").select("doc_id", "action_no", "description", "score", "deadline")


@register(with_expected("""
SELECT doc_id, CASE tpl WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 8 THEN 1 WHEN 9 THEN 1 WHEN 10 THEN CAST(variant = 0 AS INT) ELSE 0 END AS proposed,
  CAST(tpl = 9 AS INT) AS hallucinated, CAST(tpl = 8 AS INT) AS demoted, CAST(tpl = 9 AS INT)::DOUBLE AS rate,
  CASE tpl WHEN 1 THEN 'Which office issued this circular?' ELSE '' END AS asked, tpl = 10 AND variant = 0 AS photograph FROM n"""))
def hybrid_verification(spark, sf):
    """What became of each notice's proposals, and the gap and requirement that they add."""
    return _hybrid(spark, sf).selectExpr(
        "doc_id", "verification.*", f"array_join(transform(filter(gaps, g -> g.why = {S.lit(GAP_REASON)}), g -> g.question), '|') as asked",
        "exists(requirements, r -> r.text = 'Hall photograph') as photograph")


def _paged(spark, sf):
    """Notices whose heading is one page and whose body another."""
    break_at = "cast(instr(text, concat(chr(10), chr(10))) as int)"
    docs = plain_notices(spark, sf).selectExpr(
        "*", f"array(named_struct('page', 1, 'char_start', 0, 'char_end', {break_at} - 1), "
        f"named_struct('page', 2, 'char_start', {break_at} + 1, 'char_end', char_length(text))) as pages")
    return analyse(docs, TODAY)


_SPAN_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, char_start, char_end FROM {rows}" for kind, rows in (
        ("deadlines", "claims"), ("actions", "acts"), ("criteria", "crit"),
        ("gaps", "(SELECT doc_id, question, min(char_start) AS char_start, min(char_end) AS char_end FROM gaps GROUP BY doc_id, question)")))


@register(with_expected(f"""
SELECT doc_id, kind, char_start, char_end, CASE WHEN char_start <= strpos(text, concat(chr(10), chr(10))) THEN 1 ELSE 2 END AS page
FROM ({_SPAN_ROWS}) JOIN n USING (doc_id)"""))
def evidence_pages(spark, sf):
    """The page of every deadline, action, gap and condition."""
    return Pages.evidence_pages(_paged(spark, sf))


@register(with_expected("""
SELECT 'deadlines' AS kind, count(*) AS claims, 0 AS violations FROM claims UNION ALL
SELECT 'actions', count(*), 0 FROM acts UNION ALL SELECT 'document_type', count(*), 0 FROM n UNION ALL
SELECT 'title', count(*), 0 FROM n"""))
def audit_all_claims(spark, sf):
    """The rules of claims, the page among them, over all claims of the notices."""
    return Pages.audit_all_claims(_paged(spark, sf)).selectExpr("kind", "claims", "cast(violations as int) as violations")
