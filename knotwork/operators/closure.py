"""Derived facts: the closure of declared relation semantics, and why each fact holds.

Rules of one premise (symmetric, inverse, sub-property, equivalent) and of two (transitive, two-link chain) run
semi-naively: each round joins only the facts that the round before found, and what a round finds is written to the shared
folder; earlier rounds are not written again. Justifications are taken in one pass over the closed facts, so re-derivations are among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.errors import QueryError
from knotwork.sources.graph import Space, cut, rounds, union_all

MAX_ROUNDS = 100
#: Rounds whose facts are read side by side before they are written together.
MERGE_ROUNDS = 8
FACT = ("s", "p", "d")


def needed_types(space: Space, wanted) -> set[str]:
    """The edge types on which facts of the types wanted depend, these included."""
    needed, todo = set(), list(wanted)
    rules = [(f, (p,)) for _, p, f, _ in one_premise_rules(space)] + [(f, (a, b)) for _, a, b, f in two_premise_rules(space)]
    while todo:
        t = todo.pop()
        if t not in needed:
            needed.add(t)
            todo += [p for f, premises in rules if f == t for p in premises]
    return needed


def only_rules(space: Space, wanted) -> Space:
    """space with the semantics of just those edge types that the ones wanted depend on."""
    made, needed = space.copy(), needed_types(space, wanted)
    for name, e in made.edges.items():
        e.sub, e.equivalent = tuple(q for q in e.sub if q in needed), tuple(q for q in e.equivalent if q in needed and name in needed)
        if name not in needed:
            e.symmetric = e.transitive = False
            e.chain = None
        if e.inverse and not {name, e.inverse} <= needed:
            e.inverse = None
    return made


def one_premise_rules(space: Space) -> list[tuple[str, str, str, bool]]:
    """(rule, type of the premise, type of the fact, turned round)."""
    rules = []
    for e in space.edges.values():
        if e.symmetric:
            rules.append(("symmetric", e.name, e.name, True))
        if e.inverse:
            rules += [("inverse", e.name, e.inverse, True), ("inverse", e.inverse, e.name, True)]
        rules += [("subproperty", e.name, q, False) for q in e.sub]
        for q in e.equivalent:
            rules += [("equivalent", e.name, q, False), ("equivalent", q, e.name, False)]
    return sorted(set(rules))


def two_premise_rules(space: Space) -> list[tuple[str, str, str, str]]:
    """(rule, first premise, second premise, fact): s-first->x and x-second->d give s-fact->d."""
    rules = [("transitive", e.name, e.name, e.name) for e in space.edges.values() if e.transitive]
    return rules + [("chain", *e.chain, e.name) for e in space.edges.values() if e.chain]


def single_steps(space: Space, facts: DataFrame, why: bool = False) -> list[DataFrame]:
    found = []
    for rule, premise, fact, turned in one_premise_rules(space):
        own = facts.filter(F.col("p") == premise)
        a, b = ("d", "s") if turned else ("s", "d")
        extra = [F.lit(rule).alias("rule"), F.array(F.struct("s", "p", "d")).alias("premises")] if why else []
        found.append(own.select(F.col(a).alias("s"), F.lit(fact).alias("p"), F.col(b).alias("d"), *extra))
    return found


def double_steps(space: Space, left: DataFrame, right: DataFrame, why: bool = False) -> list[DataFrame]:
    found = []
    for rule, first, second, fact in two_premise_rules(space):
        a = left.filter(F.col("p") == first).select(F.col("s").alias("s1"), F.col("d").alias("x"))
        b = right.filter(F.col("p") == second).select(F.col("s").alias("x"), F.col("d").alias("d2"))
        struct = lambda s, p, d: F.struct(F.col(s).alias("s"), F.lit(p).alias("p"), F.col(d).alias("d"))
        extra = [F.lit(rule).alias("rule"), F.array(struct("s1", first, "x"), struct("x", second, "d2")).alias("premises")] if why else []
        found.append(a.join(b, "x").select(F.col("s1").alias("s"), F.lit(fact).alias("p"), F.col("d2").alias("d"), *extra))
    return found


def asserted_facts(space: Space) -> DataFrame:
    used = {x for _, a, b, _ in one_premise_rules(space) for x in (a, b)} | {x for _, *r in two_premise_rules(space) for x in r}
    return space.edges_of(tuple(used) or ("",), asserted_only=True).select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("d")).distinct()


def closed_facts(space: Space, budget: int | None = None) -> DataFrame:
    """(s, p, d): all facts, asserted and derived, of the types that rules mention."""
    with rounds() as keep:
        return union_all(closed_parts(space, budget, keep))


def closed_parts(space: Space, budget: int | None, keep: list) -> list[DataFrame]:
    """closed_facts() as the tables of its rounds, each fact in one of them; `keep` has their paths."""
    delta = cut(asserted_facts(space), keep)
    parts, derived = [delta], 0
    for _ in range(MAX_ROUNDS):
        known = union_all(parts)
        steps = single_steps(space, delta) + double_steps(space, delta, known) + double_steps(space, known, delta)
        if not steps:
            return parts
        delta = cut(union_all(steps).distinct().join(known, list(FACT), "left_anti"), keep)
        new = delta.count()
        if not new:
            return parts
        derived += new
        if budget is not None and derived > budget:
            space.dirty = True
            raise QueryError(f"more than {budget} derived facts")
        parts.append(delta)
        if len(parts) > MERGE_ROUNDS:
            keep.clear()
            parts = [cut(union_all(parts), keep)]
    raise QueryError("the rules did not settle")


def justifications(space: Space, facts: DataFrame) -> DataFrame:
    """(s, p, d, rule, premises): every way in which a rule gives a fact, each once."""
    steps = single_steps(space, facts, True) + double_steps(space, facts, facts, True)
    if not steps:
        return facts.limit(0).withColumns({"rule": F.lit(""), "premises": F.array(F.struct("s", "p", "d"))})
    return union_all(steps).distinct()


def derived_types(space: Space, facts: DataFrame) -> DataFrame:
    """(vid, class): what DOMAIN and RANGE say of the ends of edges, derived ones included."""
    plain = space.edges_of([e.name for e in space.edges.values() if e.domain or e.range] or ("",), asserted_only=True).select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("d"))
    every = plain.unionByName(facts.select(*FACT))
    found = [every.limit(0).select(F.col("s").alias("vid"), F.lit("").alias("class"))]
    for e in space.edges.values():
        if e.domain:
            found.append(every.filter(F.col("p") == e.name).select(F.col("s").alias("vid"), F.lit(e.domain).alias("class")))
        if e.range:
            found.append(every.filter(F.col("p") == e.name).select(F.col("d").alias("vid"), F.lit(e.range).alias("class")))
    return union_all(found).distinct()


def materialize_rules(space: Space, budget: int | None = None) -> Space:
    """space with derived edges (rank 0, marked), derived types and justifications, made anew from what is asserted."""
    made = space.copy()
    made.derived, made.inferred_types, made.provenance, made.dirty = {}, None, None, False
    if not (one_premise_rules(space) or two_premise_rules(space) or any(e.domain or e.range for e in space.edges.values())):
        return made
    facts = closed_facts(space, budget)
    for e in {f for _, _, f, _ in one_premise_rules(space)} | {r[-1] for r in two_premise_rules(space)}:
        new = facts.filter(F.col("p") == e).select(F.col("s").alias("src"), F.col("d").alias("dst"))
        made.derived[e] = new.join(made.asserted(e).select("src", "dst"), ["src", "dst"], "left_anti")
    made.inferred_types = derived_types(space, facts)
    made.provenance = justifications(space, facts)
    return made


WHY_ROWS = 10_000


def explain_fact(space: Space, source: int, target: int, over: str) -> DataFrame:
    """The proof of a fact, depth first: depth, fact, status, rule, premises.

    The part of the justifications that the proof needs is found in rounds of joins from the fact and must not exceed
    WHY_ROWS rows; only that part comes to the driver.
    """
    schema = "depth int, fact string, status string, rule string, premises string"
    spark = space.spark
    wanted = spark.createDataFrame([(source, over, target)], f"s {space.vid_sql}, p string, d {space.vid_sql}")
    asserted: set[tuple] = set()
    every = space.edges_of(None, asserted_only=True).select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("d")).distinct()
    proofs: dict[tuple, list] = {}
    frontier, rows = [(source, over, target)], 0
    # every round but the last finds a step or more, so WHY_ROWS bounds the rounds too
    while frontier:
        wanted = spark.createDataFrame(frontier, wanted.schema)
        asserted |= {tuple(r) for r in every.join(F.broadcast(wanted), list(FACT), "left_semi").collect()}
        for f in frontier:
            proofs[f] = []
        if space.provenance is not None:
            found = space.provenance.join(F.broadcast(wanted), list(FACT), "left_semi").limit(WHY_ROWS + 1 - rows).collect()
            rows += len(found)
            if rows > WHY_ROWS:
                raise QueryError(f"the proof has more than {WHY_ROWS} steps")
            for r in found:
                proofs[r["s"], r["p"], r["d"]].append((r["rule"], tuple((x["s"], x["p"], x["d"]) for x in r["premises"])))
        frontier = sorted({x for f in frontier for _, ps in proofs[f] for x in ps if x not in proofs})
    out, told = [], set()
    text = lambda f: f"{f[0]} -{f[1]}-> {f[2]}"
    stack = [((source, over, target), 0)]
    while stack:
        f, depth = stack.pop()
        ways = sorted(proofs.get(f, []))
        if f in told and ways:
            out.append((depth, text(f), "(already explained above)", "—", "—"))
            continue
        told.add(f)
        if not ways:
            out.append((depth, text(f), "asserted" if f in asserted else "not found", "—", "—"))
            continue
        below = []
        for rule, premises in ways:
            out.append((depth, text(f), "inferred", rule, ", ".join(map(text, premises))))
            below += [(p, depth + 1) for p in premises]
        stack += reversed(below)
    return spark.createDataFrame(out, schema)
