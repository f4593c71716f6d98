"""Folds and distributed forms against small sequential versions of our own."""

import datetime as dt
import random

from docplan.functions import spans as S
from docplan.functions.rows import table_of
from docplan.operators import usage
from docplan.plans import schedule as P

TODAY = "date'2026-09-01'"


def test_ordered_fold_is_linear_scan(spark):
    lengths = [random.Random(1).randrange(9) for _ in range(700)]
    df = spark.createDataFrame([(lengths,)], "xs array<int>")
    got = df.selectExpr(S.running_starts("xs")).first()[0]
    assert got == [sum(lengths[:i]) for i in range(len(lengths))]


def walk_cuts(nodes):
    """Depth-first walk that removes the edge into the latest member of each cycle."""
    deps, cuts, done = {n: sorted(d) for n, (_, d) in nodes.items()}, [], set()

    def visit(n, path):
        if n in done:
            return
        path = path + [n]
        for d in deps[n]:
            if d in path:
                cycle = path[path.index(d):]
                worst = max(cycle, key=lambda x: (nodes[x][0] is None, nodes[x][0] or dt.date.min))
                i = cycle.index(worst)
                edge = (cycle[i - 1], worst)
                if edge not in cuts:
                    cuts.append(edge)
            else:
                visit(d, path)
        done.add(n)

    for n in sorted(nodes):
        visit(n, [])
    return cuts


def test_cycles_and_order(spark):
    rng, rows = random.Random(7), []
    for doc in range(40):
        names = [f"a{i}" for i in range(rng.randint(2, 7))]
        rows.append((doc, [
            (n, None if rng.random() < 0.4 else dt.date(2026, 9, rng.randint(1, 28)),
             rng.randint(1, 5), rng.sample(names, rng.randint(0, min(3, len(names)))), "FACT")
            for n in names
        ], []))
    df = spark.createDataFrame(
        rows, "doc_id int, actions array<struct<action_id:string,deadline:date,effort_days:int,"
        "depends_on:array<string>,classification:string>>, completed array<string>")
    planned = P.with_schedule(df, TODAY, passed_on=[]).collect()
    for row in planned:
        nodes = {a.action_id: (a.deadline, set(a.depends_on) - {a.action_id}) for a in row.actions}
        want = walk_cuts(nodes)
        assert [(e.node, e.dep) for e in row.broken_edges] == want
        left = {n: d - {e for m, e in want if m == n} for n, (_, d) in nodes.items()}
        effort = {a.action_id: a.effort_days for a in row.actions}
        order, todo = [], {n: set(d) for n, d in left.items()}
        while todo:
            ready = [n for n, d in todo.items() if not d]
            # the cuts need not open every cycle; then the earliest step goes next
            pick = min(ready or todo, key=lambda n: (
                nodes[n][0] is None, nodes[n][0] or dt.date.min, -effort[n] if ready else 0, n))
            order.append(pick)
            todo.pop(pick)
            for d in todo.values():
                d.discard(pick)
        assert [s.action_id for s in row.schedule] == order


def test_quota_matches_sequential(spark):
    rng, rows, t = random.Random(3), [], 1_700_000_000
    for i in range(1500):
        t += rng.choice((5, 20, 60, 60, 400, 9000 if i % 97 == 0 else 30))
        rows.append((rng.choice((1, 1, 1, 2, 3)), i, dt.datetime.fromtimestamp(t, dt.UTC)))
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp")
    got = {r.event_id: (r.accepted, r.retry_after)
           for r in usage.quota_audit(df, allowance=4, window_seconds=300).collect()}
    kept, want = {}, {}
    for user, event, ts in rows:
        now = ts.timestamp()
        seen = [x for x in kept.get(user, []) if now - x <= 300]
        full = len(seen) >= 4
        want[event] = (not full, int(300 - (now - seen[0])) + 1 if full else 0)
        kept[user] = seen if full else seen + [now]
    assert got == want


def test_stream_extraction(spark, docs, tmp_path):
    from docplan.operators import temporal

    docs("Pay by 18 September 2026.").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(
        "doc_id int, text string, text_confidence double, source_kind string"
    ).parquet(str(tmp_path / "in"))
    found = temporal.extract_temporal(stream, TODAY)
    query = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [str(r.resolved) for r in spark.table("found").collect()] == ["2026-09-18"]


def test_registry_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert table_of is not None
