"""The scalar functions: name to (fewest arguments, most, builder); a builder gives (Column, kind), or None for types it
does not take. Names are looked up in lower case."""

from __future__ import annotations

from pyspark.sql import functions as F


def _text(build, kind: str, n: int = 1):
    def made(args):
        if any(a.kind not in ("string", "any") for a in args):
            return None
        return build(*[a.col.cast("string") for a in args]), kind

    return n, n, made


def _number(build, kind: str | None = None):
    def made(args):
        (a,) = args
        if a.kind not in ("int", "float"):
            return None
        return build(a), kind or a.kind

    return 1, 1, made


def _length(args):
    (a,) = args
    if a.kind == "string":
        return F.octet_length(a.col).cast("long"), "int"
    if a.kind == "list":
        return F.when(a.col.isNotNull(), F.size(a.col)).cast("long"), "int"
    return None


def _coalesce(args):
    kinds = {a.kind for a in args if a.kind != "null"}
    kind = kinds.pop() if len(kinds) == 1 else "float" if kinds and kinds <= {"int", "float"} else "any"
    return F.coalesce(*[a.col for a in args]), kind if args else "null"


_lower, _upper, _len = _text(F.lower, "string"), _text(F.upper, "string"), (1, 1, _length)
_starts, _ends = _text(lambda a, b: a.startswith(b), "bool", 2), _text(lambda a, b: a.endswith(b), "bool", 2)
_null = (1, 1, lambda a: (a[0].col.isNull(), "bool"))
_not_null = (1, 1, lambda a: (a[0].col.isNotNull(), "bool"))

SCALARS = {
    "lower": _lower,
    "tolower": _lower,
    "upper": _upper,
    "toupper": _upper,
    "length": _len,
    "size": _len,
    "contains": _text(lambda a, b: a.contains(b), "bool", 2),
    "starts_with": _starts,
    "startswith": _starts,
    "ends_with": _ends,
    "endswith": _ends,
    "abs": _number(lambda a: F.abs(a.col)),
    "floor": _number(lambda a: F.floor(a.col).cast("long"), "int"),
    "ceil": _number(lambda a: F.ceil(a.col).cast("long"), "int"),
    "round": _number(lambda a: F.round(a.col).cast("long"), "int"),
    "is_null": _null,
    "isnull": _null,
    "is_not_null": _not_null,
    "isnotnull": _not_null,
    "coalesce": (1, 99, _coalesce),
}
