"""The extension point for inspections."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column

from tracewell.operators.frame import TracedFrame
from tracewell.plans.nodes import DagNode


class Inspection(ABC):
    """Two inspections are the same if they are of one class with one ``key``.

    An inspection says what has to be carried along (``sensitive`` columns, numbered ``rows``, ``notes``: further hidden columns
    computed at every source) and what to compute at each operator.
    """

    sensitive: tuple[str, ...] = ()
    rows = False

    @property
    def key(self) -> object:
        return None

    def notes(self) -> dict[str, Column]:
        return {}

    @abstractmethod
    def visit(self, node: DagNode, frame: TracedFrame | None, parents: list) -> object:
        """The result at ``node``, given the results at its parents. ``frame`` is None where an operator has no rows (an estimator)."""

    def visit_all(self, dag, frames: dict[DagNode, TracedFrame]) -> dict[DagNode, object]:
        """The results at all nodes; an inspection that can answer several operators at once overrides this."""
        return dag.walk(lambda node, parents: self.visit(node, frames.get(node), parents))

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and self.key == other.key

    def __hash__(self) -> int:
        return hash((type(self), self.key))
