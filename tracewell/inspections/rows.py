"""Inspections that show rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.inspections.base import Inspection
from tracewell.operators.frame import TracedFrame, quoted
from tracewell.plans.session import HIDDEN


def lineage_of(frame: TracedFrame) -> Column:
    """Set of (op, row) that a row comes from: one hidden column per source, so that a join needs no merging of arrays."""
    parts = []
    for c in frame.hidden():
        if c.startswith(f"{HIDDEN}row_"):
            parts.append(F.struct(F.lit(int(c.removeprefix(f"{HIDDEN}row_").split("_")[0])).alias("op"), F.col(quoted(c)).alias("row")))
    return F.array_sort(F.array_distinct(F.filter(F.array(*parts), lambda x: x["row"].isNotNull()))) if parts else F.array().cast("array<struct<op:int,row:bigint>>")


class FirstRows(Inspection):
    """The first ``row_count`` rows of every operator in the order of its sources' rows, as a list of rows."""

    rows = True

    def __init__(self, row_count: int):
        self.row_count = row_count

    @property
    def key(self):
        return self.row_count

    def visit(self, node, frame, parents):
        if frame is None:
            return None
        return frame.ordered().select(*[F.col(quoted(c)) for c in node.columns if c in frame.df.columns]).limit(self.row_count).collect()


class RowLineage(FirstRows):
    """As ``FirstRows``, with ``lineage``: the source rows that each row was made from."""

    def visit(self, node, frame, parents):
        if frame is None:
            return None
        shown = [F.col(quoted(c)) for c in node.columns if c in frame.df.columns]
        return frame.ordered().select(*shown, lineage_of(frame).alias("lineage")).limit(self.row_count).collect()


class MissingEmbeddings(Inspection):
    """For operators that make vectors of words: how many are all zeros, and up to ``example_count`` of the words."""

    def __init__(self, example_count: int = 10):
        self.example_count = example_count

    @property
    def key(self):
        return self.example_count

    def visit(self, node, frame, parents):
        if frame is None or node.function != "WordVectors":
            return None
        column = node.description.removeprefix("WordVectors of ")
        missing = F.forall(F.col(quoted(column)), lambda x: x == 0)
        made = frame.df
        row = made.select(F.count_if(missing), F.count("*")).first()
        examples = [r[0] for r in made.where(missing).select(f"{HIDDEN}word").distinct().limit(self.example_count).collect()]
        return {"missing": row[0], "rows": row[1], "examples": examples}


class RandomNote(Inspection):
    """A random number for each source row that stays with it; for testing that what is carried along is."""

    def __init__(self, seed: int = 0, row_count: int = 10):
        self.seed, self.row_count = seed, row_count

    rows = True

    @property
    def key(self):
        return self.seed, self.row_count

    def notes(self):
        return {"random": F.rand(self.seed)}

    def visit(self, node, frame, parents):
        name = f"{HIDDEN}note_random"
        return [r[0] for r in frame.ordered().select(name).limit(self.row_count).collect()] if frame is not None and name in frame.df.columns else None
