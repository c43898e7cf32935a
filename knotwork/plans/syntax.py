"""Syntax trees of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


# --- expressions ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Prop:
    """a.b"""

    owner: str
    name: str


@dataclass(frozen=True)
class TagProp:
    """a.tag.b"""

    owner: str
    tag: str
    name: str


@dataclass(frozen=True)
class DstProp:
    """$$.tag.b"""

    tag: str
    name: str


@dataclass(frozen=True)
class VarCol:
    """$a.b"""

    var: str
    column: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()
    star: bool = False


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Un:
    op: str
    arg: Any


@dataclass(frozen=True)
class ListOf:
    items: tuple


def walk(e):
    """e and all expressions below it."""
    yield e
    for below in (e.left, e.right) if isinstance(e, Bin) else (e.arg,) if isinstance(e, Un) else e.args if isinstance(e, Call) else e.items if isinstance(e, ListOf) else ():
        yield from walk(below)


@dataclass(frozen=True)
class Item:
    """An expression of RETURN or YIELD with its name."""

    expr: Any
    alias: str | None = None


# --- patterns -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NodePat:
    var: str
    labels: tuple = ()
    any_label: bool = False
    props: tuple = ()


@dataclass(frozen=True)
class EdgePat:
    var: str
    types: tuple = ()
    direction: str = "out"
    span: tuple | None = None
    props: tuple = ()
    named: bool = False


@dataclass(frozen=True)
class Pattern:
    nodes: tuple
    edges: tuple


# --- statements -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Match:
    patterns: tuple
    optional: tuple = ()
    where: Any = None
    items: tuple = ()
    group: tuple | None = None
    order: tuple = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Go:
    low: int
    high: int
    start: Any
    over: tuple | None
    direction: str = "out"
    where: Any = None
    items: tuple = ()


@dataclass(frozen=True)
class Fetch:
    names: tuple | None
    refs: Any
    edge: bool
    as_of: int | None = None


@dataclass(frozen=True)
class Lookup:
    name: str
    where: Any
    edge: bool = False
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Find:
    shortest: bool
    every: bool
    source: Any
    target: Any
    over: str | None
    both: bool = False
    weight: str | None = None
    upto: int | None = None


@dataclass(frozen=True)
class Recommend:
    seed: Any
    over: tuple | None = None
    embedding: str | None = None
    over_weight: float | None = None
    embedding_weight: float | None = None
    structural: bool = False
    where: Any = None
    limit: int = 10


@dataclass(frozen=True)
class Why:
    source: int
    target: int
    over: str


@dataclass(frozen=True)
class InsertVertex:
    tags: tuple  # ((tag, (property, ...)), ...)
    rows: tuple  # ((vid, values), ...)


@dataclass(frozen=True)
class InsertEdge:
    name: str
    props: tuple
    rows: tuple  # ((src, dst, rank, values), ...)


@dataclass(frozen=True)
class Update:
    name: str
    ref: Any
    edge: bool
    changes: tuple
    when: Any = None


@dataclass(frozen=True)
class DeleteVertex:
    vids: tuple
    where: Any = None


@dataclass(frozen=True)
class DeleteEdge:
    name: str
    refs: tuple


@dataclass(frozen=True)
class Create:
    kind: str  # space, tag, edge, class, shape, tag index, edge index
    name: str
    fields: tuple = ()
    quiet: bool = False
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Alter:
    kind: str
    name: str
    action: str
    fields: tuple


@dataclass(frozen=True)
class Drop:
    kind: str
    name: str
    quiet: bool = False


@dataclass(frozen=True)
class Show:
    what: str
    name: str | None = None


@dataclass(frozen=True)
class Describe:
    kind: str
    name: str


@dataclass(frozen=True)
class Check:
    what: str


@dataclass(frozen=True)
class Use:
    name: str


@dataclass(frozen=True)
class Explain:
    statement: Any
    profile: bool = False


@dataclass(frozen=True)
class Unsupported:
    what: str


@dataclass(frozen=True)
class Script:
    """Clauses (variable or None, statement) run one after another."""

    clauses: tuple
