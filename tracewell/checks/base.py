"""The extension point for checks."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from enum import Enum

from tracewell.inspections.base import Inspection
from tracewell.plans.dag import Dag


class CheckStatus(Enum):
    SUCCESS = "Success"
    FAILURE = "Failure"
    ERROR = "Error"


@dataclass
class CheckResult:
    check: Check
    status: CheckStatus
    description: str = ""
    details: dict = field(default_factory=dict)


class Check(ABC):
    """Names the inspections that it needs and judges their results. Equal checks run once."""

    @property
    def key(self) -> object:
        return None

    @property
    def required_inspections(self) -> list[Inspection]:
        return []

    @abstractmethod
    def evaluate(self, dag: Dag, results: dict) -> CheckResult:
        """``results``: {node: {inspection: result}}."""

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and self.key == other.key

    def __hash__(self) -> int:
        return hash((type(self), self.key))
