"""What the graph of a pipeline is made of."""

from __future__ import annotations

import linecache
import sys
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path

PACKAGE = str(Path(__file__).resolve().parents[1])


class Op(Enum):
    """What a node does to its inputs, in this engine's own terms."""

    SCAN = "scan"
    FOREIGN = "foreign"
    PROJECT = "project"
    DERIVE = "derive"
    FILTER = "filter"
    LIMIT = "limit"
    SORT = "sort"
    JOIN = "join"
    AGGREGATE = "aggregate"
    SPLIT = "split"
    ENCODE = "encode"
    ASSEMBLE = "assemble"
    EXAMPLES = "examples"
    TARGETS = "targets"
    FIT = "fit"
    PREDICT = "predict"

    @property
    def keeps_rows(self) -> bool:
        """Whether there is a row in the output for each row of the one input, and no other."""
        return self in (Op.PROJECT, Op.DERIVE, Op.SORT, Op.ENCODE, Op.EXAMPLES, Op.TARGETS, Op.PREDICT)

    @property
    def chooses_rows(self) -> bool:
        """Whether a group's share can change because rows are left out or repeated."""
        return self in (Op.FILTER, Op.LIMIT, Op.JOIN)


@dataclass(frozen=True)
class CodeLocation:
    """Where in the pipeline's source an operator was called."""

    file: str
    line: int
    column: int | None = None
    end_line: int | None = None
    end_column: int | None = None

    def source(self) -> str:
        return linecache.getline(self.file, self.line).strip()


def caller() -> CodeLocation:
    """The innermost place on the stack outside this package."""
    frame = sys._getframe(1)
    while frame and frame.f_code.co_filename.startswith(PACKAGE):
        frame = frame.f_back
    if frame is None:
        return CodeLocation("<unknown>", 0)
    at = list(frame.f_code.co_positions())[frame.f_lasti // 2]
    return CodeLocation(frame.f_code.co_filename, frame.f_lineno, at[2], at[1], at[3])


@dataclass(frozen=True)
class DagNode:
    """One call of an operator: what it does, by which function, and what comes out. Two nodes are the same if their ids are."""

    node_id: int
    op: Op = field(compare=False)
    function: str = field(compare=False)
    description: str = field(compare=False)
    columns: tuple[str, ...] = field(compare=False)
    location: CodeLocation | None = field(compare=False, default=None)
