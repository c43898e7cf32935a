"""Errors that a query can end in."""


class QueryError(Exception):
    """The query cannot be run as written: syntax, names, types or guards."""
