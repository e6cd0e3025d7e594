"""How often each value of sensitive columns occurs after each operator, even once the column has been projected away."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.inspections.base import Inspection
from tracewell.operators.frame import quoted
from tracewell.plans.nodes import Op
from tracewell.plans.session import sensitive_column


#: Counts that go to the driver at most, of all operators and columns together.
MAX_VALUES = 200_000


class HistogramForColumns(Inspection):
    """Result: {column: {value: count}}, null counted as a value; a column that the rows never had gives {}.

    Where an operator keeps every row of its one input and does not touch a sensitive column, its parent's result is reused.
    All other operators are counted in one query: their rows' sensitive values, marked with the operator, are aggregated
    together, so that Spark runs one job and computes an exchange that several of them need once.
    """

    def __init__(self, sensitive_columns):
        self.sensitive = tuple(sensitive_columns)

    @property
    def key(self):
        return self.sensitive

    def _stands_for(self, node, frame, parents: list):
        """The node whose histogram ``node`` has, given those of its parents: itself if it has to be counted; None without rows."""
        if frame is None:
            return None
        touched = node.function in ("with_column", "replace", "label_binarize", "Imputer") and set(self.sensitive) & set(node.columns)
        if node.op.keeps_rows and len(parents) == 1 and parents[0] is not None and not touched:
            return parents[0]
        if node.op is Op.ASSEMBLE and parents and parents[0] is not None and len(set(parents)) == 1:
            return parents[0]
        return node

    def _count(self, frames: dict) -> dict:
        """Histograms of frames that are counted together, by node."""
        out = {n: {c: {} for c in self.sensitive} for n in frames}
        by_types: dict[tuple, list] = {}
        for node, frame in frames.items():
            types = dict(frame.df.dtypes)
            have = tuple((c, types[sensitive_column(c)]) for c in self.sensitive if sensitive_column(c) in types)
            if have:
                by_types.setdefault(have, []).append(node)
        for have, nodes in by_types.items():
            names = [f"v{k}" for k in range(len(have))]
            cell = lambda i, k: (F.col(quoted(sensitive_column(have[k][0]))) if i == k else F.lit(None).cast(have[k][1])).alias(names[k])
            pairs = F.array(*[F.struct(F.lit(i).alias("i"), *[cell(i, k) for k in range(len(have))]) for i in range(len(have))])
            parts = [frames[n].df.select(F.lit(j).alias("node"), F.inline(pairs)) for j, n in enumerate(nodes)]
            together = parts[0]
            for part in parts[1:]:
                together = together.unionByName(part)
            counted = together.groupBy("node", "i", *names).count().limit(MAX_VALUES + 1).collect()
            if len(counted) > MAX_VALUES:
                raise ValueError(f"the sensitive columns have more than {MAX_VALUES} values in all operators together; histograms are for columns of few values")
            for r in counted:
                out[nodes[r["node"]]][have[r["i"]][0]][r[names[r["i"]]]] = r["count"]
        return out

    def visit(self, node, frame, parents):
        return self._count({node: frame})[node] if frame is not None else {c: {} for c in self.sensitive}

    def visit_all(self, dag, frames):
        shown = dag.walk(lambda node, parents: self._stands_for(node, frames.get(node), parents))
        found = self._count({n: frames[n] for n in dict.fromkeys(shown.values()) if n is not None})
        return {node: found[n] if n is not None else {c: {} for c in self.sensitive} for node, n in shown.items()}
