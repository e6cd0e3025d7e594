"""Column expressions."""

from tracewell.functions.expressions import Expr, col, lit

__all__ = ["Expr", "col", "lit"]
