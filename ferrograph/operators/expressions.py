"""Small expressions over record fields, turned into Spark columns.

A condition is a comparison or a combination of conditions, given as data; Spark's own parser reads textual expressions.
"""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import convert

COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def condition(node: dict[str, Any]) -> Column:
    """A filter from nested data: {"and": [...]}, {"or": [...]}, {"not": x}, {"field", "op", "value"}, {"field", "in": [...]}, {"field", "exists": bool}."""
    if "and" in node:
        return reduce(operator.and_, map(condition, node["and"]), F.lit(True))
    if "or" in node:
        return reduce(operator.or_, map(condition, node["or"]), F.lit(False))
    if "not" in node:
        return ~condition(node["not"])
    field = F.col(node["field"])
    if "in" in node:
        return field.isin(*node["in"])
    if "exists" in node:
        return field.isNotNull() if node["exists"] else field.isNull()
    return COMPARE[node["op"]](field, node["value"])


def all_of(**wanted: Any) -> Column:
    """Equality with every value that is given; None asks for nothing."""
    return reduce(operator.and_, [F.col(k).isin(*v) if isinstance(v, list) else F.col(k) == v for k, v in wanted.items() if v is not None], F.lit(True))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100, whole)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def theoretical_yield(limiting: Column, equivalents: Column, mass: Column) -> Column:
    return limiting * F.coalesce(equivalents, F.lit(1.0)) * mass


def to_unit(value: Column, unit: Column, to: str) -> Column:
    return convert(value, unit, F.lit(to))
