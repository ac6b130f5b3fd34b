"""Filters of the two dialects compiled to column expressions.

The dataset dialect types a filter by the column's declared type; the view dialect by the value
at hand: number, else date, else text.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import ascii_lower, parse_date, parse_number
from .spec import Filter, Group, Schema, SpecError

#: Spellings of the operators.
OPERATORS = {
    "": "equals", "equals": "equals", "is": "equals", "=": "equals", "==": "equals",
    "not_equals": "not_equals", "is_not": "not_equals", "!=": "not_equals",
    "is_empty": "is_empty", "empty": "is_empty", "is_not_empty": "is_not_empty", "not_empty": "is_not_empty",
    "contains": "contains", "not_contains": "not_contains",
    "starts_with": "starts_with", "prefix": "starts_with", "ends_with": "ends_with", "suffix": "ends_with",
    "greater_than": "gt", "gt": "gt", ">": "gt", "greater_than_or_equal": "gte", "gte": "gte", ">=": "gte",
    "less_than": "lt", "lt": "lt", "<": "lt", "less_than_or_equal": "lte", "lte": "lte", "<=": "lte",
    "after": "after", "before": "before", "on_or_after": "on_or_after", "on_or_before": "on_or_before",
    "in": "in", "contains_any": "in", "not_in": "not_in", "contains_none": "contains_none", "contains_all": "contains_all",
}
#: What paged queries offer.
STRICT = ("equals", "not_equals", "is_empty", "is_not_empty", "contains", "not_contains", "starts_with", "ends_with", "gt", "lt")
_DATES = {"after": "gt", "before": "lt", "on_or_after": "gte", "on_or_before": "lte"}


def real(text: str) -> float:
    """The number a text begins with, else 0."""
    m = re.match(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", text)
    return float(m[0]) if m else 0.0


def items_of(value: str) -> list[str]:
    """The members of a set literal: split at commas, else at blanks; brackets around it dropped."""
    inner = value.strip().removeprefix("[").removesuffix("]")
    return [x.strip().strip("'\"") for x in (inner.split(",") if "," in inner else inner.split()) if x.strip()]


def _like(text: Column, pattern: str) -> Column:
    return text.like(pattern.replace("\\", "\\\\"))


def _compare(a: Column, op: str, b: Column) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def compile_filter(f: Filter, schema: Schema, strict: bool = False) -> Column:
    """One filter of the dataset dialect; ``strict`` refuses what paged queries do not offer."""
    name = schema.column(f.key)
    op = OPERATORS.get(f.operator.strip().lower())
    if strict and op not in STRICT:
        raise SpecError(f'filter operator "{f.operator}" is not supported here')
    op = op or "equals"
    kind, c, v = schema.type(name), F.col(name), f.value
    text = c.cast("string")
    if op == "equals" and v == "":
        op = "is_empty"
    if op in ("is_empty", "is_not_empty"):
        empty = F.size(F.coalesce(c, F.array())) == 0 if kind == "list" else F.coalesce(text, F.lit("")) == ""
        return empty if op == "is_empty" else ~empty
    if op in ("in", "not_in", "contains_none", "contains_all"):
        return _members(c, kind, op, items_of(v))
    if op == "contains":
        return _like(ascii_lower(text), f"%{v.lower()}%")
    if op == "not_contains":
        return c.isNull() | ~_like(ascii_lower(text), f"%{v.lower()}%")
    if op == "starts_with":
        return _like(ascii_lower(text), f"{v.lower()}%")
    if op == "ends_with":
        return _like(ascii_lower(text), f"%{v.lower()}")
    if kind in ("number", "integer", "float"):
        left, right = c.cast("double"), F.lit(real(v))
    elif kind in ("date", "datetime") or op in _DATES:
        left, right = (c.cast("timestamp_ntz") if kind in ("date", "datetime") else parse_date(text)), parse_date(F.lit(v))
    elif kind in ("checkbox", "boolean", "bool"):
        left, right = c, F.lit(v.strip().lower() in ("1", "true", "t", "yes"))
    elif op in ("equals", "not_equals"):
        left, right = ascii_lower(text), F.lit(v.lower())
    else:
        left, right = ascii_lower(text), F.lit(v)  # the literal keeps its case
    if op == "equals":
        return c.isNotNull() & (left == right)
    if op == "not_equals":
        return c.isNull() | (left != right)
    return _compare(left, _DATES.get(op, op), right)


def _members(c: Column, kind: str, op: str, items: list[str]) -> Column:
    if not items:
        return F.lit(op in ("not_in", "contains_none"))
    if kind in ("number", "integer", "float"):
        one, wanted = c.cast("double"), [F.lit(real(i)) for i in items]
    elif kind in ("checkbox", "boolean", "bool"):
        one, wanted = c, [F.lit(i.lower() in ("1", "true")) for i in items]
    else:
        one, wanted = ascii_lower(c.cast("string")), [F.lit(i.lower()) for i in items]
    if kind != "list":
        hit = one.isin(*wanted)
        # contains_none looks into containers only, so a scalar always passes
        return {"in": hit, "not_in": c.isNull() | ~hit, "contains_none": F.lit(True), "contains_all": reduce(and_, [one == w for w in wanted])}[op]
    held = F.transform(F.coalesce(c, F.array().cast("array<string>")), ascii_lower)
    some = F.arrays_overlap(held, F.array(*wanted))
    return {"in": some, "not_in": ~some, "contains_none": ~some, "contains_all": F.size(F.array_except(F.array(*wanted), held)) == 0}[op]


def compile_group(g: Group | None, one) -> Column:
    """A nested group; ``one`` compiles a filter."""
    if g is None:
        return F.lit(True)
    members = [*(one(f) for f in g.filters), *(compile_group(x, one) for x in g.groups)]
    return reduce(or_ if g.operator.lower() == "any" else and_, members) if members else F.lit(True)


def compile_all(filters, group: Group | None, schema: Schema, strict: bool = False) -> Column:
    def one(f: Filter) -> Column:
        return compile_filter(f, schema, strict)

    return reduce(and_, [one(f) for f in filters], compile_group(group, one))


def view_filter(f: Filter, value: Column) -> Column:
    """One filter of the view dialect on a property's text (null if it is missing)."""
    op = OPERATORS.get(f.operator.strip().lower(), "equals")
    text, v = F.coalesce(value, F.lit("")), f.value
    folded = F.lower(text)
    if op == "equals" and v == "" or op == "is_empty":
        return text == ""
    if op == "is_not_empty":
        return text != ""
    if op == "contains":
        return folded.contains(v.lower())
    if op == "not_contains":
        return ~folded.contains(v.lower())
    if op == "starts_with":
        return folded.startswith(v.lower())
    if op == "ends_with":
        return folded.endswith(v.lower())
    if op in ("in", "not_in", "contains_none", "contains_all"):
        inner = F.regexp_replace(F.trim(folded), r"^\[|\]$", "")
        held = F.filter(F.transform(F.split(inner, F.when(inner.contains(","), ",").otherwise("\\s+")), lambda x: F.trim(x)), lambda x: x != "")
        wanted = F.array(*(F.lit(i.lower()) for i in items_of(v))).cast("array<string>")
        some = F.arrays_overlap(held, wanted)
        return {"in": some, "not_in": ~some, "contains_none": ~some, "contains_all": (F.size(wanted) > 0) & (F.size(F.array_except(wanted, held)) == 0)}[op]
    n, m = parse_number(text), parse_number(F.lit(v))
    d, e = parse_date(text), parse_date(F.lit(v))
    both_n, both_d = n.isNotNull() & m.isNotNull(), d.isNotNull() & e.isNotNull()
    if op in ("equals", "not_equals"):
        same = F.when(both_n, n == m).when(both_d, d == e).otherwise(folded == v.lower())
        return same if op == "equals" else ~same
    if op in _DATES:
        return F.when(both_d, _compare(d, _DATES[op], e)).otherwise(_compare(folded, _DATES[op], F.lit(v.lower())))
    return F.when(both_n, _compare(n, op, m)).when(both_d, _compare(d, op, e)).otherwise(_compare(folded, op, F.lit(v.lower())))
