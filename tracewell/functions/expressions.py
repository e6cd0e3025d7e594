"""Expressions over columns that know their SQL: one tree gives the Spark column and the text of a translated pipeline."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value) -> str:
    """A constant as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, Decimal):
        digits, scale = len(value.as_tuple().digits), max(0, -value.as_tuple().exponent)
        return f"CAST('{value:f}' AS DECIMAL({min(38, max(digits, scale + 1) + max(0, value.as_tuple().exponent))}, {scale}))"
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


class Expr:
    """A column expression. Operators build larger ones and keep their nesting, so precedence is never lost.

    Comparisons follow SQL: with a null on either side they are null, and a filter drops the row. ``same_as`` treats nulls as
    equal. Division by zero gives null. ``origins`` are the nodes of the frames whose columns were named as ``frame["c"]``.
    """

    __hash__ = None

    def __init__(self, template: str, *parts: Expr, columns: Iterable[str] = (), origins: Iterable = ()):
        self.template, self.parts = template, parts
        self.origins = frozenset(origins).union(*(p.origins for p in parts))
        self.columns = tuple(dict.fromkeys([*columns, *(c for p in parts for c in p.columns)]))

    def sql(self) -> str:
        return self.template.format(*(p.sql() for p in self.parts)) if self.parts else self.template

    def column(self) -> Column:
        return F.expr(self.sql())

    def __repr__(self) -> str:
        return self.sql()

    def _with(self, template: str, other) -> Expr:
        return Expr(template, self, lit(other))

    def __add__(self, other): return self._with("({} + {})", other)  # noqa: E704
    def __radd__(self, other): return lit(other)._with("({} + {})", self)  # noqa: E704
    def __sub__(self, other): return self._with("({} - {})", other)  # noqa: E704
    def __rsub__(self, other): return lit(other)._with("({} - {})", self)  # noqa: E704
    def __mul__(self, other): return self._with("({} * {})", other)  # noqa: E704
    def __rmul__(self, other): return lit(other)._with("({} * {})", self)  # noqa: E704
    def __truediv__(self, other): return self._with("try_divide({}, {})", other)  # noqa: E704
    def __rtruediv__(self, other): return lit(other)._with("try_divide({}, {})", self)  # noqa: E704
    def __eq__(self, other): return self._with("({} = {})", other)  # noqa: E704
    def __ne__(self, other): return self._with("({} <> {})", other)  # noqa: E704
    def __gt__(self, other): return self._with("({} > {})", other)  # noqa: E704
    def __ge__(self, other): return self._with("({} >= {})", other)  # noqa: E704
    def __lt__(self, other): return self._with("({} < {})", other)  # noqa: E704
    def __le__(self, other): return self._with("({} <= {})", other)  # noqa: E704
    def __and__(self, other): return self._with("({} AND {})", other)  # noqa: E704
    def __or__(self, other): return self._with("({} OR {})", other)  # noqa: E704
    def __invert__(self): return Expr("(NOT {})", self)  # noqa: E704

    def same_as(self, other) -> Expr:
        return self._with("({} <=> {})", other)

    def isin(self, values: Iterable) -> Expr:
        """Whether the value is one of ``values``; a null value is in nothing, and an empty list holds nothing."""
        values = [lit(v) for v in values]
        return Expr("({} IN (" + ", ".join(["{}"] * len(values)) + "))", self, *values) if values else lit(False)

    def is_null(self) -> Expr:
        return Expr("({} IS NULL)", self)

    def when_else(self, value, otherwise) -> Expr:
        """``value`` where this condition holds, else ``otherwise``."""
        return Expr("CASE WHEN {} THEN {} ELSE {} END", self, lit(value), lit(otherwise))


def col(name: str, *origins) -> Expr:
    quoted = "`" + name.replace("`", "``") + "`"
    return Expr(quoted, columns=[name], origins=origins)


def lit(value) -> Expr:
    return value if isinstance(value, Expr) else Expr(literal(value))
