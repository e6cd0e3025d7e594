"""Checks on what models see."""

from __future__ import annotations

from tracewell.checks.base import Check, CheckResult, CheckStatus
from tracewell.inspections.rows import MissingEmbeddings
from tracewell.plans.nodes import Op

#: Features that no model should use.
ILLEGAL_FEATURES = ("race", "gender", "age")


class NoIllegalFeatures(Check):
    """No forbidden column goes into the data that an estimator is trained on.

    The graph is walked up from training data; a concatenation's inputs are judged by the columns that its projections name.
    """

    def __init__(self, additional=()):
        self.names = tuple(dict.fromkeys([*ILLEGAL_FEATURES, *additional]))

    @property
    def key(self):
        return self.names

    def evaluate(self, dag, results):
        found: set[str] = set()

        # Nodes whose features are put together by a concatenation, there or above.
        joined = dag.walk(lambda node, parents: node.op is Op.ASSEMBLE or any(parents))

        def walk(node) -> None:
            parents = dag.parents(node)
            if node.op is Op.ASSEMBLE:
                found.update(c for p in parents for c in p.columns if c in self.names)
            elif joined[node]:
                for parent in parents:
                    if joined[parent]:
                        walk(parent)
            else:
                found.update(c for c in node.columns if c in self.names)

        for node in dag.topological():
            if node.op is Op.EXAMPLES:
                walk(node)
        said = f"trained on {', '.join(sorted(found))}" if found else ""
        return CheckResult(self, CheckStatus.FAILURE if found else CheckStatus.SUCCESS, said, {"illegal": sorted(found)})


class NoMissingEmbeddings(Check):
    """No word is without a vector."""

    def __init__(self, example_count: int = 10):
        self.example_count = example_count

    @property
    def key(self):
        return self.example_count

    @property
    def required_inspections(self):
        return [MissingEmbeddings(self.example_count)]

    def evaluate(self, dag, results):
        inspection = MissingEmbeddings(self.example_count)
        found = {n: r[inspection] for n, r in results.items() if r.get(inspection) and r[inspection]["missing"]}
        said = "; ".join(f"{n.description}: {r['missing']} of {r['rows']}, such as {r['examples']}" for n, r in found.items())
        return CheckResult(self, CheckStatus.FAILURE if found else CheckStatus.SUCCESS, said, {"missing": found})
