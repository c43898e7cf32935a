"""Expressions to Columns, in the three semantics of the language.

* MATCH: two-valued. A comparison with null, or of types that do not compare, is false.
* EVAL (GO, UPDATE, RECOMMEND, SHAPE): three-valued. Null equals null; types that do not compare are an error.
* LOOKUP: two-valued, one field against literals; equality is strict about integers and floats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.errors import QueryError
from knotwork.functions.scalar import SCALARS
from knotwork.plans import syntax as s

#: Fixed tolerances: floats are equal in EVAL mode within the machine epsilon, in LOOKUP mode within 1e-8.
EVAL_EPSILON, LOOKUP_EPSILON = 2.220446049250313e-16, 1e-8
AGGREGATES = ("count", "sum", "avg", "min", "max")


class Mode(Enum):
    MATCH = "match"
    EVAL = "eval"
    LOOKUP = "lookup"


@dataclass(frozen=True)
class Typed:
    """A Column and its kind: int, float, string, bool, list, null or any."""

    col: Column
    kind: str


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.FractionalType):
        return "float"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.ArrayType):
        return "list"
    return "null" if isinstance(data_type, T.NullType) else "any"


def literal(value) -> Typed:
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("long"), "int")
    if isinstance(value, float):
        return Typed(F.lit(value), "float")
    if isinstance(value, list):
        return Typed(F.array(*[literal(v).col for v in value]), "list")
    return Typed(F.lit(value), "string")


def is_aggregate(e) -> bool:
    return isinstance(e, s.Call) and e.name.lower() in AGGREGATES


def has_aggregate(e) -> bool:
    return any(is_aggregate(x) for x in s.walk(e))


NUMERIC = ("int", "float")


def comparable(left: Typed, right: Typed) -> bool:
    kinds = {left.kind, right.kind}
    return len(kinds) == 1 or kinds <= set(NUMERIC) or bool(kinds & {"null", "any"})


class Compiler:
    """resolve(node) gives the Typed of a name, property or special call, or None where it does not know it."""

    def __init__(self, mode: Mode, resolve: Callable):
        self.mode, self.resolve = mode, resolve

    def condition(self, e) -> Column:
        """The column of a filter: null counts as false."""
        found = self(e)
        if found.kind not in ("bool", "null", "any"):
            if self.mode is Mode.MATCH:
                return F.lit(False)
            raise QueryError("a condition must be true or false")
        return F.coalesce(found.col.cast("boolean"), F.lit(False))

    def filter(self, e) -> Column:
        """The same for a filter of rows, written so that comparisons reach the scan.

        Where a row is dropped for null as for false, AND, OR and comparisons need no care for null; only what stands
        below NOT or inside other expressions does.
        """
        if isinstance(e, s.Bin) and e.op in ("AND", "OR"):
            left, right = self.filter(e.left), self.filter(e.right)
            return left & right if e.op == "AND" else left | right
        if isinstance(e, s.Bin) and e.op in ("==", "<", "<=", ">", ">=") and isinstance(e.right, s.Lit) and e.right.value is not None:
            left, right = self(e.left), self(e.right)
            if self.mode is not Mode.EVAL and comparable(left, right) and left.kind not in ("missing", "null") and not (self.mode is Mode.LOOKUP and e.op == "==" and left.kind != right.kind):
                if e.op != "==":
                    return {"<": left.col < right.col, "<=": left.col <= right.col, ">": left.col > right.col, ">=": left.col >= right.col}[e.op]
                if self.mode is Mode.MATCH or left.kind != "float":
                    return left.col == right.col
                near = F.lit(e.right.value)
                # the range reaches the scan; the exact test stays beside it
                return (left.col >= near - 2 * LOOKUP_EPSILON) & (left.col <= near + 2 * LOOKUP_EPSILON) & self.condition(e)
        return self.condition(e)

    def __call__(self, e) -> Typed:
        if isinstance(e, s.Lit):
            return literal(e.value)
        if isinstance(e, s.ListOf):
            return Typed(F.array(*[self(x).col for x in e.items]), "list")
        if isinstance(e, s.Bin):
            return self.binary(e)
        if isinstance(e, s.Un):
            return self.unary(e)
        found = self.resolve(e)
        if found is not None:
            return found
        if isinstance(e, s.Call):
            return self.call(e)
        raise QueryError(f"unknown name: {getattr(e, 'owner', '')}{'.' if hasattr(e, 'owner') else ''}{getattr(e, 'name', e)}")

    def call(self, e: s.Call) -> Typed:
        known = SCALARS.get(e.name.lower())
        if known is None:
            raise QueryError(f"unknown function: {e.name}")
        fewest, most, build = known
        if not fewest <= len(e.args) <= most:
            raise QueryError(f"{e.name} takes another number of arguments")
        args = [self(a) for a in e.args]
        made = build(args)
        if made is None:
            if self.mode is Mode.MATCH or any(a.kind == "null" for a in args):
                return Typed(F.lit(None), "null")
            raise QueryError(f"{e.name} does not take these types")
        return Typed(*made)

    def unary(self, e: s.Un) -> Typed:
        arg = self(e.arg)
        if e.op == "-":
            if self.mode is Mode.MATCH:
                raise QueryError("MATCH has no arithmetic")
            if arg.kind not in (*NUMERIC, "null", "any"):
                raise QueryError("- takes a number")
            return Typed(-arg.col, arg.kind)
        if arg.kind not in ("bool", "null", "any"):
            raise QueryError("NOT takes a condition")
        col = arg.col.cast("boolean")
        return Typed(~(col if self.mode is Mode.EVAL else F.coalesce(col, F.lit(False))), "bool")

    def binary(self, e: s.Bin) -> Typed:
        if e.op in ("AND", "OR"):
            sides = [self(x) for x in (e.left, e.right)]
            cols = []
            for x in sides:
                if x.kind in ("bool", "null", "any"):
                    cols.append(x.col.cast("boolean") if self.mode is Mode.EVAL else F.coalesce(x.col.cast("boolean"), F.lit(False)))
                elif self.mode is Mode.MATCH:
                    cols.append(F.lit(False))
                else:
                    raise QueryError(f"{e.op} takes conditions")
            return Typed(cols[0] & cols[1] if e.op == "AND" else cols[0] | cols[1], "bool")
        if e.op in ("IN", "NOT IN"):
            return self.membership(e)
        left, right = self(e.left), self(e.right)
        if e.op in ("+", "-", "*", "/", "%"):
            return self.arithmetic(e.op, left, right)
        if e.op in ("CONTAINS", "NOT CONTAINS", "STARTS WITH", "ENDS WITH", "=~"):
            return self.text_test(e, left, right)
        return Typed(self.compare(e.op, left, right), "bool")

    def compare(self, op: str, left: Typed, right: Typed) -> Column:
        mixed = not comparable(left, right)
        if op in ("==", "!="):
            equal = self.equal(left, right)
            if self.mode is Mode.MATCH:
                return F.lit(False) if mixed else F.coalesce(equal if op == "==" else ~equal, F.lit(False))
            return equal if op == "==" else ~equal
        if mixed:
            if self.mode is Mode.EVAL:
                raise QueryError(f"{left.kind} and {right.kind} have no order")
            return F.lit(False)
        if self.mode is Mode.EVAL and "bool" in (left.kind, right.kind):
            raise QueryError("conditions have no order")
        col = {"<": left.col < right.col, "<=": left.col <= right.col, ">": left.col > right.col, ">=": left.col >= right.col}[op]
        return col if self.mode is Mode.EVAL else F.coalesce(col, F.lit(False))

    def equal(self, left: Typed, right: Typed) -> Column:
        floats = "float" in (left.kind, right.kind) and {left.kind, right.kind} <= set(NUMERIC)
        if self.mode is Mode.MATCH:
            return F.lit(False) if not comparable(left, right) else left.col == right.col
        both_null = left.col.isNull() & right.col.isNull()
        if self.mode is Mode.LOOKUP and left.kind != right.kind and not {left.kind, right.kind} & {"null", "any"}:
            return both_null
        if not comparable(left, right):
            return both_null
        if floats:
            near = F.abs(left.col - right.col) < (EVAL_EPSILON if self.mode is Mode.EVAL else LOOKUP_EPSILON)
            return both_null | F.coalesce((left.col == right.col) | near, F.lit(False))
        return left.col.eqNullSafe(right.col)

    def membership(self, e: s.Bin) -> Typed:
        left = self(e.left)
        if not isinstance(e.right, s.ListOf):
            right = self(e.right)
            if right.kind != "list":
                raise QueryError("IN takes a list")
            found = F.array_contains(right.col, left.col)
            return Typed(found if self.mode is Mode.EVAL and e.op == "IN" else F.coalesce(found, F.lit(False)) if e.op == "IN" else ~F.coalesce(found, F.lit(False)), "bool")
        items = [self(x) for x in e.right.items]
        same = [self.equal(left, x) for x in items if x.kind != "null" and comparable(left, x)]
        any_equal = F.lit(False)
        for c in same:
            any_equal = any_equal | F.coalesce(c, F.lit(False))
        if self.mode is Mode.EVAL:
            unknown = left.col.isNull() | F.lit(any(x.kind == "null" for x in items))
            found = F.when(any_equal & left.col.isNotNull(), True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
            return Typed(found if e.op == "IN" else ~found, "bool")
        if self.mode is Mode.LOOKUP and any(x.kind == "null" for x in items):
            any_equal = any_equal | left.col.isNull()
        return Typed(any_equal if e.op == "IN" else ~any_equal, "bool")

    def text_test(self, e: s.Bin, left: Typed, right: Typed) -> Typed:
        if self.mode is Mode.LOOKUP:
            raise QueryError(f"LOOKUP has no {e.op}")
        texts = {left.kind, right.kind} <= {"string", "null", "any"}
        if not texts:
            if self.mode is Mode.EVAL and e.op == "NOT CONTAINS":
                return Typed(F.lit(True), "bool")
            return Typed(F.lit(False), "bool")
        a, b = left.col.cast("string"), right.col.cast("string")
        col = {"CONTAINS": a.contains(b), "NOT CONTAINS": ~a.contains(b), "STARTS WITH": a.startswith(b), "ENDS WITH": a.endswith(b), "=~": F.regexp_like(a, b)}[e.op]
        if self.mode is Mode.EVAL and e.op == "NOT CONTAINS":
            return Typed(F.coalesce(col, F.lit(True)), "bool")
        return Typed(F.coalesce(col, F.lit(False)), "bool")

    def arithmetic(self, op: str, left: Typed, right: Typed) -> Typed:
        if self.mode is not Mode.EVAL:
            raise QueryError(f"{self.mode.name} has no arithmetic")
        if op == "+" and left.kind == right.kind == "string":
            return Typed(F.concat(left.col, right.col), "string")
        if "null" in (left.kind, right.kind):
            return Typed(F.lit(None), "null")
        if not {left.kind, right.kind} <= {*NUMERIC, "any"}:
            raise QueryError(f"{op} takes numbers")
        whole = left.kind == right.kind == "int"
        a, b = left.col, right.col
        if op == "/":
            # whole numbers are divided towards zero; a zero divisor is an error in either case
            zero = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(b)
            return Typed(F.call_function("div", a, zero) if whole else a.cast("double") / zero, "int" if whole else "float")
        if op == "%":
            zero = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(b)
            return Typed(a % zero, "int" if whole else "float")
        return Typed({"+": a + b, "-": a - b, "*": a * b}[op], "int" if whole else "float")
