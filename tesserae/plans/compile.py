"""A parsed query becomes one boolean Column over a document's flags and positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.plans.query import And, Near, Node, Not, Or, Phrase, Term


def _phrase(positions: list[Column]) -> Column:
    first, rest = positions[0], positions[1:]
    if not rest:
        return F.size(first) > 0
    return F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.array_contains(x, p + i) for i, x in enumerate(rest, 1)]))


def _near(positions: list[Column], distance: int) -> Column:
    first, rest = positions[0], positions[1:]
    if not rest:
        return F.size(first) > 0
    return F.exists(first, lambda p: reduce(lambda a, b: a & b, [F.exists(x, lambda q: q.between(p, p + distance)) for x in rest]))


def compile_query(node: Node, positions: dict[str, Column]) -> Column:
    """positions: for each term an array Column that is never null (empty: the document lacks it)."""
    match node:
        case Term(t):
            return F.size(positions[t]) > 0
        case Phrase(ts):
            return _phrase([positions[t] for t in ts]) if ts else F.lit(False)
        case Near(ts, n):
            return _near([positions[t] for t in ts], n) if ts else F.lit(False)
        case And(a, b):
            return compile_query(a, positions) & compile_query(b, positions)
        case Or(a, b):
            return compile_query(a, positions) | compile_query(b, positions)
        case Not(x):
            return ~compile_query(x, positions)
    raise TypeError(node)
