"""A session records the operators of one pipeline and knows what they have to carry along for its inspections."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from tracewell.plans.dag import Dag
from tracewell.plans.nodes import CodeLocation, DagNode, Op, caller

#: Columns of this prefix are carried along unseen.
HIDDEN = "__tw_"

_CURRENT: ContextVar = ContextVar("session", default=None)


def row_column(node_id: int) -> str:
    return f"{HIDDEN}row_{node_id}"


def sensitive_column(name: str) -> str:
    return f"{HIDDEN}value_{name}"


class Session:
    """``sensitive``: columns whose values are kept with each row even when they are projected away. ``rows``: whether the rows of
    sources are numbered, for lineage and for first rows in a fixed order."""

    def __init__(self, spark: SparkSession, sensitive: tuple[str, ...] = (), rows: bool = False, locations: bool = True, notes: dict | None = None):
        self.spark, self.sensitive, self.rows, self.locations = spark, tuple(sensitive), rows, locations
        self.notes = dict(notes or {})
        self.dag = Dag()
        self.frames: dict[DagNode, object] = {}
        self._next, self._missing = 0, -1

    def record(self, operator: Op, function: str, description: str, columns, parents: tuple[DagNode, ...] = ()) -> DagNode:
        """A new node; known operators count up from 0, untracked inputs down from -1."""
        if operator is Op.FOREIGN:
            node_id, self._missing = self._missing, self._missing - 1
        else:
            node_id, self._next = self._next, self._next + 1
        location: CodeLocation | None = caller() if self.locations else None
        return self.dag.add(DagNode(node_id, operator, function, description, tuple(columns), location), parents)

    def frame_of(self, node: DagNode) -> DataFrame | None:
        frame = self.frames.get(node)
        return frame.df if frame is not None else None

    @contextmanager
    def active(self):
        """Within this, readers record to this session."""
        token = _CURRENT.set(self)
        try:
            yield self
        finally:
            _CURRENT.reset(token)

    @staticmethod
    def current(spark: SparkSession | None = None) -> Session:
        """The active session; one is made for ``spark`` if there is none."""
        found = _CURRENT.get()
        if found is None:
            if spark is None:
                raise RuntimeError("no active session")
            found = Session(spark)
            _CURRENT.set(found)
        return found
