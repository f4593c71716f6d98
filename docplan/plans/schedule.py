"""Backward scheduling of a document's actions along their dependencies.

A document's actions and their prerequisites sit in one array of its row, so
ordering, depth and deadline propagation are array folds: scheduling a corpus
needs no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from docplan.functions import lexicon as L
from docplan.functions import spans as S
from docplan.functions.rows import Findings

_NODE = "struct<id:string,deadline:date,effort:int,deps:array<string>>"
_EDGE = "struct<node:string,dep:string>"
_STRINGS = "array<string>"


def graph_of(actions: str) -> str:
    """``{nodes, dangling}``: edges to unknown actions or to itself are dropped."""

    def build(xs: str, ids: str) -> str:
        def known(a: str, d: str) -> str:
            return f"array_contains({ids}, {d}) AND {d} != {a}.action_id"

        nodes = S.transform(
            xs,
            lambda a: S.struct(
                id=f"{a}.action_id", deadline=f"{a}.deadline", effort=f"{a}.effort_days",
                deps="array_sort(array_distinct("
                + S.keep(f"{a}.depends_on", lambda d: known(a, d)) + "))",
            ),
        )
        dangling = S.transform(
            xs,
            lambda a: S.transform(
                "array_sort(array_distinct("
                + S.keep(f"{a}.depends_on", lambda d: f"NOT ({known(a, d)})") + "))",
                lambda d: S.struct(node=f"{a}.action_id", dep=d),
            ),
        )
        return S.struct(
            nodes=f"cast({nodes} as array<{_NODE}>)",
            dangling=f"cast(flatten({dangling}) as array<{_EDGE}>)",
        )

    return S.let(actions, lambda xs: S.let(
        S.transform(xs, lambda a: f"{a}.action_id"), lambda ids: build(xs, ids)
    ))


def topological_order(nodes: str, complete: bool = False) -> str:
    """Prerequisites first; ties by deadline (undated last), longer effort, id.

    Nodes on a cycle are left out, so a short result tells a cyclic graph.
    With ``complete``, should nothing be ready, the node with the earliest
    deadline and then the smallest id goes next, so that no step is lost.
    """

    def step(acc: str, _: str) -> str:
        ready = S.transform(S.keep(f"{acc}.left", lambda r: f"size({r}.deps) = 0"), lambda r: f"{r}.key")

        def take(chosen: str) -> str:
            rest = S.transform(
                S.keep(f"{acc}.left", lambda r: f"{r}.key.id != {chosen}.id"),
                lambda r: S.struct(key=f"{r}.key", deps=f"array_remove({r}.deps, {chosen}.id)"),
            )
            moved = S.struct(left=rest, done=f"concat({acc}.done, array({chosen}.id))")
            return f"if({chosen} IS NULL, {acc}, {moved})"

        if not complete:
            return S.let(f"array_min({ready})", take)
        waiting = S.transform(
            f"{acc}.left",
            lambda r: f"struct({r}.key.undated, {r}.key.deadline, {r}.key.id, {r}.key as key)",
        )
        return S.let(f"coalesce(array_min({ready}), array_min({waiting}).key)", take)

    def whole(xs: str) -> str:
        keyed = S.transform(
            xs,
            lambda n: S.struct(
                key=S.struct(
                    undated=f"if({n}.deadline IS NULL, 1, 0)", deadline=f"{n}.deadline",
                    effort=f"-{n}.effort", id=f"{n}.id",
                ),
                deps=f"{n}.deps",
            ),
        )
        init = S.struct(left=keyed, done=S.empty("string"))
        folded = f"aggregate(sequence(1, size({xs})), {init}, {S.lam(step, 2)}).done"
        return S.when((f"size({xs}) > 0", folded), otherwise=S.empty("string"))

    return S.let(nodes, whole)


def cycle_cuts(nodes: str) -> str:
    """Edges to remove so that the graph is acyclic.

    A depth-first walk from the smallest id on. Each closed cycle loses the
    edge into its member with the latest deadline; an undated member counts as
    latest and the first of equals is taken. The walk is a fold over as many
    steps as there are roots, visits and edges.
    """
    path_type = f"array<struct<id:string,todo:{_STRINGS}>>"

    def of(nodes_: str, node_id: str) -> str:
        return f"element_at({S.keep(nodes_, lambda n: f'{n}.id = {node_id}')}, 1)"

    def state(path: str, done: str, roots: str, cut: str) -> str:
        return S.struct(
            path=f"cast({path} as {path_type})", done=done, roots=roots,
            cut=f"cast({cut} as array<{_EDGE}>)",
        )

    def enter(nodes_: str, node_id: str) -> str:
        return f"array({S.struct(id=node_id, todo=f'{of(nodes_, node_id)}.deps')})"

    def edge_of(nodes_: str, cycle: str) -> str:
        ranked = S.lam(
            lambda c, i: S.let(
                of(nodes_, c),
                lambda n: f"struct(if({n}.deadline IS NULL, 1, 0), "
                f"coalesce({n}.deadline, date'0001-01-01'), -{i} as neg)",
            ),
            2,
        )
        return S.let(
            f"-array_max(transform({cycle}, {ranked})).neg",
            lambda i: S.struct(
                node=f"{cycle}[pmod({i} - 1, size({cycle}))]", dep=f"{cycle}[{i}]"
            ),
        )

    def whole(ns: str) -> str:
        def step(acc: str, _: str) -> str:
            p, d, r, c = (f"{acc}.{f}" for f in ("path", "done", "roots", "cut"))

            def on_path(top: str) -> str:
                popped = state(f"slice({p}, 1, size({p}) - 1)", f"array_append({d}, {top}.id)", r, c)

                def examine(dep: str, advanced: str) -> str:
                    ids = S.transform(p, lambda x: f"{x}.id")

                    def cut_edge(cycle: str) -> str:
                        return S.let(
                            edge_of(ns, cycle),
                            lambda e: f"if(array_contains({c}, {e}), {c}, array_append({c}, {e}))",
                        )

                    closes = S.let(
                        ids,
                        lambda xs: S.let(
                            f"slice({xs}, cast(array_position({xs}, {dep}) as int), size({xs}))",
                            cut_edge,
                        ),
                    )
                    return S.when(
                        (f"{S.any_of(p, lambda x: f'{x}.id = {dep}')}",
                         state(advanced, d, r, closes)),
                        (f"array_contains({d}, {dep})", state(advanced, d, r, c)),
                        otherwise=state(f"concat({advanced}, {enter(ns, dep)})", d, r, c),
                    )

                rest = S.struct(id=f"{top}.id", todo=f"slice({top}.todo, 2, size({top}.todo))")
                advanced = f"concat(slice({p}, 1, size({p}) - 1), array({rest}))"
                return (
                    f"if(size({top}.todo) = 0, {popped}, "
                    + S.let_all([f"{top}.todo[0]", advanced], examine) + ")"
                )

            tail = f"slice({r}, 2, size({r}))"
            start = S.when(
                (f"size({r}) = 0", acc),
                (f"array_contains({d}, {r}[0])", state(p, d, tail, c)),
                otherwise=state(enter(ns, f"{r}[0]"), d, tail, c),
            )
            return f"if(size({p}) = 0, {start}, {S.let(f'element_at({p}, -1)', on_path)})"

        steps = f"3 * size({ns}) + aggregate({ns}, 0, (a, n) -> a + size(n.deps)) + 1"
        init = state(
            f"cast(array() as {path_type})", S.empty("string"),
            f"array_sort({S.transform(ns, lambda n: f'{n}.id')})", S.empty(_EDGE),
        )
        return f"aggregate(sequence(1, {steps}), {init}, {S.lam(step, 2)}).cut"

    return S.let(nodes, whole)


def without_edges(nodes: str, cuts: str) -> str:
    def pruned(cs: str) -> str:
        return S.transform(
            nodes,
            lambda n: S.struct(
                id=f"{n}.id", deadline=f"{n}.deadline", effort=f"{n}.effort",
                deps=S.keep(
                    f"{n}.deps",
                    lambda d: f"NOT array_contains({cs}, {S.struct(node=f'{n}.id', dep=d)})",
                ),
            ),
        )

    return S.let(cuts, pruned)


def in_order(nodes: str, order: str) -> str:
    return S.transform(
        order, lambda i: f"element_at({S.keep(nodes, lambda n: f'{n}.id = {i}')}, 1)"
    )


def depths(ordered: str) -> str:
    """Length of the longest prerequisite chain of each ordered node."""

    def step(acc: str, n: str) -> str:
        before = S.transform(
            S.keep(acc, lambda a: f"array_contains({n}.deps, {a}.id)"), lambda a: f"{a}.depth"
        )
        return f"array_append({acc}, {S.struct(id=f'{n}.id', depth=f'1 + coalesce(array_max({before}), -1)')})"

    init = S.empty("struct<id:string,depth:int>")
    return S.transform(f"aggregate({ordered}, {init}, {S.lam(step, 2)})", lambda a: f"{a}.depth")


def effective_deadlines(ordered: str) -> str:
    """Own deadline, or the earliest date a dependent action has to start."""

    def step(acc: str, n: str) -> str:
        inherited = S.transform(
            S.keep(acc, lambda a: f"array_contains({a}.deps, {n}.id)"),
            lambda a: f"date_sub({a}.effective, {a}.effort)",
        )
        own = S.struct(
            effective=f"array_min(array_append({inherited}, {n}.deadline))",
            effort=f"{n}.effort", deps=f"{n}.deps",
        )
        return f"array_append({acc}, {own})"

    init = S.empty(f"struct<effective:date,effort:int,deps:{_STRINGS}>")
    folded = f"aggregate(reverse({ordered}), {init}, {S.lam(step, 2)})"
    return f"reverse({S.transform(folded, lambda a: f'{a}.effective')})"


def with_graph(docs: DataFrame, actions: str = "actions") -> DataFrame:
    """Adds ``_ordered`` nodes, ``broken_edges`` and ``dangling_edges``."""
    no_edges = S.empty(_EDGE)
    return (
        docs.selectExpr("*", f"{graph_of(actions)} as _graph")
        .selectExpr("*", f"{topological_order('_graph.nodes')} as _first_order")
        .selectExpr(
            "*",
            f"if(size(_first_order) < size(_graph.nodes), {cycle_cuts('_graph.nodes')}, "
            f"{no_edges}) as broken_edges",
        )
        .selectExpr(
            "*",
            "if(size(broken_edges) > 0, "
            f"{without_edges('_graph.nodes', 'broken_edges')}, _graph.nodes) as _nodes",
        )
        .selectExpr(
            "*",
            f"if(size(broken_edges) > 0, {topological_order('_nodes', complete=True)}, _first_order) as _order",
        )
        .selectExpr(
            *docs.columns, "broken_edges", "_graph.dangling as dangling_edges",
            f"{S.let('_nodes', lambda ns: in_order(ns, '_order'))} as _ordered",
        )
    )


def _prioritize(s: str) -> str:
    """Priority and its reason from slack, class and whether others wait."""
    source = (
        f"concat(if({s}.effective_deadline <=> {s}.deadline, 'Stated deadline of ', "
        "'Governed by a dependent action\\'s deadline of '), "
        f"{s}.effective_deadline, '.')"
    )
    slack = f"{s}.slack_days"

    def outcome(priority: str, why: str) -> str:
        return S.struct(priority=f"'{priority}'", rationale=why)

    buffer = f"concat({source}, ' ', {S.days(slack)}, ' of buffer.')"
    return S.when(
        (
            f"{s}.classification = 'UNCERTAIN'",
            outcome("low", "'Held back because the action itself is unconfirmed — verify it "
                    "before scheduling.'"),
        ),
        (
            f"{slack} IS NULL",
            outcome("low", "'No deadline governs this action, directly or through anything that "
                    "depends on it.'"),
        ),
        (
            f"{slack} < 0",
            outcome("overdue", f"concat({source}, ' Needed to start ', {S.days(f'abs({slack})')}, "
                    "' ago to finish in time.')"),
        ),
        (
            f"{slack} <= {L.CRITICAL_SLACK}",
            outcome("critical", f"concat({source}, ' Must start ', if({slack} = 0, 'today', "
                    f"concat('within ', {S.days(slack)})), '.')"),
        ),
        (
            f"{slack} <= {L.HIGH_SLACK}",
            outcome("high", f"concat({buffer}, if({s}.blocks_others, "
                    "' It also blocks later work.', ''))"),
        ),
        (f"{slack} <= {L.MEDIUM_SLACK}", outcome("medium", buffer)),
        otherwise=outcome("low", buffer),
    )


PASSED_ON = (
    "description verb score char_start char_end requires conditional_on optional"
).split()


def with_schedule(
    docs: DataFrame,
    today: str,
    actions: str = "actions",
    passed_on: list[str] = PASSED_ON,
) -> DataFrame:
    """Adds ``schedule``: the actions in order with slack, priority and blockers.

    ``actions`` needs action_id, deadline, effort_days, depends_on and
    classification; the fields in ``passed_on`` are copied. Documents carry
    ``completed``, the ids of the actions already done.
    """
    docs = with_graph(docs, actions).selectExpr(
        "*",
        f"{S.let('_ordered', depths)} as _depths",
        f"{S.let('_ordered', effective_deadlines)} as _effective",
    )
    item = S.lam(
        lambda n, i: S.struct(node=n, ord=i, depth=f"DEPTHS[{i}]", effective_deadline=f"DUE[{i}]"), 2
    )
    placed = S.let_all(
        ["_depths", "_effective"],
        lambda depth, due: f"transform(_ordered, {item})".replace("DEPTHS[", f"{depth}[").replace(
            "DUE[", f"{due}["
        ),
    )
    plan = Findings(docs, "schedule", placed, "node ord depth effective_deadline")
    joined = S.let_all(
        [actions, "schedule", "completed"],
        lambda acts, sched, done: S.transform(
            sched,
            lambda s: S.let(
                f"element_at({S.keep(acts, lambda a: f'{a}.action_id = {s}.node.id')}, 1)",
                lambda a: S.struct(
                    action_id=f"{s}.node.id", ord=f"{s}.ord", depth=f"{s}.depth",
                    effective_deadline=f"{s}.effective_deadline",
                    latest_start=f"date_sub({s}.effective_deadline, {a}.effort_days)",
                    blocked_by=S.keep(
                        f"{s}.node.deps", lambda d: f"NOT array_contains({done}, {d})"
                    ),
                    blocks_others=S.any_of(
                        sched, lambda o: f"array_contains({o}.node.deps, {s}.node.id)"
                    ),
                    done=f"array_contains({done}, {s}.node.id)",
                    deadline=f"{a}.deadline", effort_days=f"{a}.effort_days",
                    classification=f"{a}.classification", depends_on=f"{s}.node.deps",
                    **{f: f"{a}.{f}" for f in passed_on},
                    **({"claim_rationale": f"{a}.rationale"} if "description" in passed_on else {}),
                ),
            ),
        ),
    )
    extra = ["claim_rationale"] if "description" in passed_on else []
    plan.replace(
        joined,
        "action_id ord depth effective_deadline latest_start blocked_by blocks_others done "
        "deadline effort_days classification depends_on " + " ".join(passed_on + extra),
    )
    plan.add(slack_days=lambda s: f"datediff({s}.latest_start, {today})")
    plan.add(_p=_prioritize)
    plan.add(priority=lambda s: f"{s}._p.priority", rationale=lambda s: f"{s}._p.rationale")
    plan.only(" ".join(f for f in plan.fields if f != "_p"))
    return plan.df.drop("_ordered", "_depths", "_effective")


# --- questions about a schedule ---------------------------------------------


def is_feasible(schedule: str) -> str:
    """Whether the outstanding work can still be finished in time."""
    return (
        f"forall({schedule}, s -> s.done OR s.slack_days IS NULL OR s.slack_days >= 0)"
    )


def next_actions(schedule: str) -> str:
    """Outstanding, unblocked actions: tightest slack first, undated last."""
    ready = S.keep(schedule, lambda s: f"NOT {s}.done AND size({s}.blocked_by) = 0")
    keyed = S.transform(
        ready,
        lambda s: f"struct(if({s}.slack_days IS NULL, 1, 0) as undated, "
        f"coalesce({s}.slack_days, 0) as slack, {s}.ord as ord, {s}.action_id as action_id)",
    )
    return f"array_sort({keyed})"


def unresolved_count(gaps: str, schedule: str) -> str:
    return (
        f"size({gaps}) + "
        f"size({S.keep(schedule, lambda s: f'{s}.classification = {S.lit('UNCERTAIN')}')})"
    )
