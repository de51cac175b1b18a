"""Patterns as DataFrames: scans, joins in a given order or shape, and the rows of every join that ran."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bgpforge.plans.bgp import Bgp, BgpError, Plan, TriplePattern, left_deep


def scan(graph: DataFrame, tp: TriplePattern) -> DataFrame:
    """Constants filter, variables become columns; a repeated variable filters too. Without variables: a row for a match."""
    rows, columns = graph, {}
    for column, term in zip("spo", tp.terms, strict=True):
        if term[0] not in "?$":
            rows = rows.where(F.col(column) == term)
        elif term[1:] in columns:
            rows = rows.where(F.col(column) == F.col(columns[term[1:]]))
        else:
            columns[term[1:]] = column
    return rows.select(*[F.col(c).alias(v) for v, c in columns.items()])


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """On all shared variables; a Cartesian product only where there is none."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared) if shared else left.crossJoin(right)


#: Shares that each side of a product within keys is dealt into; cells of a share of the right side.
SHARES, CELLS = 16, 16


def spread_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of `join` where few keys hold many rows on both sides: both sides are dealt into shares, and every two shares meet in a partition of their own.
    There left's rows go through right's cell by cell, so that values return soon and a file of the rows holds them as short references."""
    shared = [c for c in left.columns if c in right.columns]
    right = right.join(left.select(*shared).distinct(), shared, "left_semi")
    mine, other = (F.pmod(F.xxhash64(*x.columns), F.lit(SHARES * CELLS)).cast("int") for x in (left, right))
    pairs = F.sequence(mine % SHARES * SHARES, mine % SHARES * SHARES + (SHARES - 1)), F.sequence(other % SHARES, F.lit(SHARES * SHARES - 1), F.lit(SHARES))
    left, right = (x.withColumn("__pair", F.explode(of)).repartitionById(SHARES * SHARES, "__pair") for x, of in zip((left, right), pairs, strict=True))
    # Cells are made after the shuffle, which has no row for them.
    left, right = left.withColumn("__cell", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))), right.withColumn("__cell", (other / SHARES).cast("int"))
    return left.join(right, [*shared, "__pair", "__cell"]).drop("__pair", "__cell")


def _multiplies(bgp: Bgp, left: Plan, right: Plan) -> bool:
    """Whether two sides share only variables that are objects in a pattern of each, so that every object's subjects meet all others."""
    sides = [[bgp.patterns[i].terms for i in x.leaves] for x in (left, right)]
    held, objects = ([{t for terms in side for t in pick(terms) if t[0] in "?$"} for side in sides] for pick in (lambda terms: terms, lambda terms: terms[2:]))
    shared = held[0] & held[1]
    return bool(shared) and shared <= objects[0] & objects[1]


def evaluate(graph: DataFrame, bgp: Bgp, plan: Plan | None = None) -> DataFrame:
    """Solutions (a bag), a column for each variable in order of first appearance; joins in the plan's shape."""
    plan = plan or left_deep(range(len(bgp.patterns)))
    if sorted(plan.leaves) != list(range(len(bgp.patterns))):
        raise BgpError(f"{len(plan.leaves)} leaves for {len(bgp.patterns)} patterns")

    def build(x: Plan) -> DataFrame:
        if x.index is not None:
            return scan(graph, bgp.patterns[x.index])
        return (spread_join if _multiplies(bgp, x.left, x.right) else join)(build(x.left), build(x.right))

    return build(plan).select(*bgp.variables)


def evaluate_order(graph: DataFrame, bgp: Bgp, order=()) -> DataFrame:
    """Left-deep in the order given; an empty one keeps the pattern's own."""
    return evaluate(graph, bgp, left_deep(order) if order else None)


def bushy_from_pairs(n: int, pairs) -> Plan:
    """A plan from joins (i, j), the k-th of which is named n + k."""
    made = [Plan(i) for i in range(n)]
    for i, j in pairs:
        made.append(Plan(None, made[i], made[j]))
    return made[-1]


def join_rows(df: DataFrame) -> list[int]:
    """Output rows of every join of an executed plan, innermost first."""
    out: list[int] = []

    def walk(node) -> None:
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if "Join" in name or "CartesianProduct" in name:
            metric = node.metrics().get("numOutputRows")
            out.append(int(metric.get().value()) if metric.isDefined() else -1)

    walk(df._jdf.queryExecution().executedPlan())
    return out


def execute(graph: DataFrame, bgp: Bgp, plan: Plan | None = None) -> dict:
    """Run a plan without fetching rows; returns its signal: rows of each join, their sum, latency, and what failed."""
    df = evaluate(graph, bgp, plan)
    began = time.perf_counter()
    try:
        n = df._jdf.queryExecution().executedPlan().execute().count()
        rows = join_rows(df)
        return {"rows": n, "per_join_rows": rows, "total_cost": sum(rows), "latency": time.perf_counter() - began, "is_error": False, "is_valid_join_row": [x >= 0 for x in rows], "error": None}
    except Exception as error:  # noqa: BLE001  a failed query is a signal, never a count of 0
        return {"rows": None, "per_join_rows": [], "total_cost": None, "latency": time.perf_counter() - began, "is_error": True, "is_valid_join_row": [], "error": type(error).__name__}
