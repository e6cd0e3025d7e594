"""Whether an operator changes the share of a group too much."""

from __future__ import annotations

from dataclasses import dataclass

from tracewell.checks.base import Check, CheckResult, CheckStatus
from tracewell.inspections.histogram import HistogramForColumns


@dataclass
class DistributionChange:
    """One operator and one column: (value, count before, after, ratio before, after, relative change), by value, null last."""

    node: object
    column: str
    rows: list[tuple]
    least: float | None
    acceptable: bool


def distribution_change(node, column: str, before: dict, after: dict, threshold: float) -> DistributionChange:
    """Shares are of all rows, nulls among them, but the share of nulls itself is not judged. A value that was not there before
    has no relative change. With nothing to judge the change is acceptable."""
    b, a = sum(before.values()), sum(after.values())
    rows, changes = [], []
    for value in sorted({*before, *after}, key=lambda v: (v is None, str(v))):
        x, y = before.get(value, 0), after.get(value, 0)
        rx, ry = x / b if b else 0.0, y / a if a else 0.0
        change = (ry - rx) / rx if rx else None
        rows.append((value, x, y, rx, ry, change))
        if value is not None and change is not None:
            changes.append(change)
    least = min(changes) if changes else None
    return DistributionChange(node, column, rows, least, least is None or least >= threshold)


class NoBiasIntroducedFor(Check):
    """No join, selection or imputation of a sensitive column lowers a group's share by more than ``-threshold`` of it.

    With several parents the histogram of a later one replaces an earlier one's entries, value by value.
    """

    def __init__(self, sensitive_columns, min_allowed_relative_ratio_change: float = -0.3):
        self.columns, self.threshold = tuple(sensitive_columns), min_allowed_relative_ratio_change

    @property
    def key(self):
        return self.columns, self.threshold

    @property
    def required_inspections(self):
        return [HistogramForColumns(self.columns)]

    def changes(self, dag, results) -> list[DistributionChange]:
        inspection = HistogramForColumns(self.columns)
        out = []
        for node in dag.topological():
            imputed = node.function == "Imputer" and set(self.columns) & set(node.columns)
            if node.op.chooses_rows or imputed:
                for column in self.columns:
                    before: dict = {}
                    for parent in dag.parents(node):
                        before = before | results[parent][inspection][column]
                    out.append(distribution_change(node, column, before, results[node][inspection][column], self.threshold))
        return out

    def evaluate(self, dag, results):
        changes = self.changes(dag, results)
        bad = [c for c in changes if not c.acceptable]
        said = "; ".join(f"{c.node.op.value} ({c.node.description}) changes {c.column} by {c.least:.4g}" for c in bad)
        return CheckResult(self, CheckStatus.FAILURE if bad else CheckStatus.SUCCESS, said, {"changes": changes})

    @staticmethod
    def overview(spark, result: CheckResult):
        """(operator, description, column, acceptable, least change) of every operator looked at, as a DataFrame."""
        rows = [(c.node.op.value, c.node.description, c.column, c.acceptable, c.least) for c in result.details["changes"]]
        return spark.createDataFrame(rows, "operator string, description string, column string, acceptable boolean, least double")
