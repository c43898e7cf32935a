"""EXPLAIN and PROFILE: the steps of a statement as rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from knotwork.plans import syntax as s
from knotwork.sources.graph import Space


def steps(space: Space, q) -> list[tuple[str, str, str]]:
    """(operator, access, detail) from the first to run to the last."""
    if isinstance(q, s.Match):
        found = []
        for n, p in enumerate((*q.patterns, *q.optional)):
            first = p.nodes[0]
            found.append(("TagScan" if first.labels else "VertexScan", "frame " + ("|" if first.any_label else ":").join(first.labels) if first.labels else "all tags", first.var))
            for e, node in zip(p.edges, p.nodes[1:], strict=True):
                found.append(("ExpandRange" if e.span else "Expand", f"join on {'dst' if e.direction == 'in' else 'src'}", f"{'|'.join(e.types) or '*'} {e.direction} {node.var}"))
            if n:
                found.append(("LeftJoin" if n >= len(q.patterns) else "Join", "shared variables", ""))
        if q.where is not None:
            found.append(("Filter", "", "WHERE"))
        if q.group is not None or any(isinstance(i.expr, s.Call) and i.expr.name.lower() in ("count", "sum", "avg", "min", "max") for i in q.items):
            found.append(("Aggregate", "", ""))
        found.append(("Project", "", ", ".join(i.alias or "" for i in q.items)))
        if q.order:
            found.append(("Sort", "", ""))
        if q.limit is not None or q.offset:
            found.append(("Limit", "", f"{q.limit} offset {q.offset}"))
        return found
    if isinstance(q, s.Go):
        found = [("Start", "literal ids" if isinstance(q.start, tuple) else "variable", ""), ("Traverse", f"join on {'dst' if q.direction == 'in' else 'src'}", f"{q.low}..{q.high} {', '.join(q.over or ('*',))}")]
        return found + [("Filter", "", "WHERE")] * (q.where is not None) + [("Project", "", "YIELD" if q.items else "src, dst")]
    if isinstance(q, s.Lookup):
        index = next((i.name for i in space.indexes.values() if i.on == q.name and q.where is not None and isinstance(q.where, s.Bin) and q.where.op in ("==", "<", "<=", ">", ">=") and getattr(q.where.left, "name", None) == i.fields[0]), None)
        edge = q.edge or space.tag_name(q.name) is None
        return [("IndexScan" if index else "EdgeScan" if edge else "TagScan", f"index {index}" if index else "pushed filter" if q.where is not None else "FULL SCAN", q.name)]
    if isinstance(q, s.Fetch):
        return [("PointGet", "join on ids", ", ".join(q.names or ("*",)))]
    if isinstance(q, s.Find):
        return [("Weighted" if q.weight else "AllShortest" if q.every else "Shortest", "rounds of joins", q.over or "*")]
    if isinstance(q, s.Recommend):
        return [("Similar", "embedding and edges" if q.embedding and q.structural else "embedding" if q.embedding else "edges", str(q.seed)), ("TopK", "", str(q.limit))]
    return [(type(q).__name__, "", "")]


def executed(plan) -> list[tuple[int, str, int | None, int | None]]:
    """(depth, operator, rows, microseconds) of Spark's plan as it ran, from the last operator to the first."""
    units = {"timing": 1000, "nsTiming": 1e-3}
    found = []

    def visit(node, depth: int) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(node.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return visit(node.plan(), depth)
        if kind not in ("WholeStageCodegenExec", "InputAdapter"):
            rows, took, at = None, 0.0, node.metrics().iterator()
            while at.hasNext():
                name, metric = (lambda pair: (pair._1(), pair._2()))(at.next())
                if name == "numOutputRows":
                    rows = metric.value()
                took += metric.value() * units.get(metric.metricType(), 0)
            found.append((depth, node.nodeName(), rows, int(took) or None))
            depth += 1
        below = node.children()
        for k in range(below.size()):
            visit(below.apply(k), depth)

    visit(plan, 0)
    return found


def explain(space: Space, q, result: DataFrame | None = None, profile: bool = False) -> DataFrame:
    """id, operator, access, detail: the statement's steps and, with a result, Spark's plan for it in the last row.

    With profile the result is run: rows and time_us are added, for the statement as a whole at its last step and then for
    each operator of Spark's plan as it ran, indented below the one that reads it.
    """
    rows = [(k, *x) for k, x in enumerate(steps(space, q))]
    spark = space.spark
    if not profile:
        if result is not None:
            rows.append((len(rows), "Plan", "spark", result._jdf.queryExecution().executedPlan().toString()))
        return spark.createDataFrame(rows, "id int, operator string, access string, detail string")
    began = time.time()
    run = result._jdf.queryExecution()
    n = run.toRdd().count()
    took = int((time.time() - began) * 1e6)
    done = [(i, o, n if i == rows[-1][0] else None, took if i == rows[-1][0] else None, a, d) for i, o, a, d in rows]
    done += [(len(rows) + k, "  " * (depth + 1) + name, own, us, "spark", "") for k, (depth, name, own, us) in enumerate(executed(run.executedPlan()))]
    return spark.createDataFrame(done, "id int, operator string, rows long, time_us long, access string, detail string")
