"""Relational operators on traced frames."""

from tracewell.operators.frame import GroupedFrame, TracedFrame

__all__ = ["GroupedFrame", "TracedFrame"]
