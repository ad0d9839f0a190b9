"""Predicates of the query builder, as columns. All keep SQL's three-valued logic: null compares as unknown."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq(name: str, value) -> Column:
    return F.col(name) == value


def neq(name: str, value) -> Column:
    return F.col(name) != value


def gt(name: str, value) -> Column:
    return F.col(name) > value


def gte(name: str, value) -> Column:
    return F.col(name) >= value


def lt(name: str, value) -> Column:
    return F.col(name) < value


def lte(name: str, value) -> Column:
    return F.col(name) <= value


def in_(name: str, values: Sequence) -> Column:
    """False for an empty list."""
    return F.col(name).isin(*values) if len(values) else F.lit(False)


def not_in(name: str, values: Sequence) -> Column:
    """True for an empty list."""
    return ~F.col(name).isin(*values) if len(values) else F.lit(True)


def contains(name: str, value: str) -> Column:
    """Literal: no wildcards."""
    return F.contains(F.col(name), F.lit(value))


def has_prefix(name: str, value: str) -> Column:
    return F.startswith(F.col(name), F.lit(value))


def has_suffix(name: str, value: str) -> Column:
    return F.endswith(F.col(name), F.lit(value))


def equal_fold(name: str, value: str) -> Column:
    return F.lower(name) == F.lower(F.lit(value))


def contains_fold(name: str, value: str) -> Column:
    return F.contains(F.lower(name), F.lower(F.lit(value)))


def is_nil(name: str) -> Column:
    return F.col(name).isNull()


def not_nil(name: str) -> Column:
    return F.col(name).isNotNull()


def and_(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def or_(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def not_(part: Column) -> Column:
    return ~part


def uuid_eq(name: str, value: str) -> Column:
    """Compares canonical lower-case forms."""
    return F.lower(name) == value.lower()


def uuid_neq(name: str, value: str) -> Column:
    return F.lower(name) != value.lower()


def uuid_in(name: str, values: Sequence[str]) -> Column:
    return F.lower(name).isin(*[v.lower() for v in values]) if len(values) else F.lit(False)


def uuid_not_in(name: str, values: Sequence[str]) -> Column:
    return ~F.lower(name).isin(*[v.lower() for v in values]) if len(values) else F.lit(True)


def uuid_order(name: str, op: str, value: str) -> Column:
    """op: gt, gte, lt or lte. UUIDs order as their bytes do, which is as their lower-case hexadecimal text does."""
    a, b = F.lower(name), F.lit(value.lower())
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def vector(values: Sequence[float], kind: str = "float") -> Column:
    """A literal for eq(), gt() and the like on vector columns; vectors order by component."""
    return F.array(*[F.lit(float(v)).cast(kind) for v in values])


OPERATORS = {
    "eq": eq,
    "neq": neq,
    "in": in_,
    "not_in": not_in,
    "gt": gt,
    "gte": gte,
    "lt": lt,
    "lte": lte,
    "contains": contains,
    "has_prefix": has_prefix,
    "has_suffix": has_suffix,
    "equal_fold": equal_fold,
    "contains_fold": contains_fold,
    "is_nil": is_nil,
    "not_nil": not_nil,
}
