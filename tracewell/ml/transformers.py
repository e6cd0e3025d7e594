"""Fit and transform as aggregates and expressions.

Fitting asks for a few aggregates of each column; all columns that are fitted at the same depth share one aggregate query, and
the one row that comes back is bound into expressions as constants. Transforming is then a projection, which Catalyst fuses
with its neighbours; nothing runs in Python and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.expressions import Expr, col, lit
from tracewell.operators.frame import TracedFrame, quoted
from tracewell.plans.nodes import Op

#: Categories that a one-hot encoding may have; more is an error, as they become constants of a plan.
MAX_CATEGORIES = 10_000


class Transformer:
    """``statistics`` of an expression that fitting needs, and ``bound``: what those statistics make of an expression."""

    vector = False
    keeps_names = False

    def statistics(self, e: Expr) -> dict[str, Column]:
        """Aggregates of the column, each of bounded size."""
        return {}

    #: What fitting needs of how often each value occurs: "values" (all that there are), "mode" or nothing.
    counted: str | None = None

    def bound(self, e: Expr, found: dict) -> Expr:
        raise NotImplementedError

    def fit(self, frame: TracedFrame, *columns: str) -> Fitted:
        return Fitted(self, list(columns), fit_level(frame, [(self, {c: col(c) for c in columns})])[0])

    def fit_transform(self, frame: TracedFrame, *columns: str) -> TracedFrame:
        return self.fit(frame, *columns).transform(frame)


def fit_level(frame: TracedFrame, parts: list[tuple[Transformer, dict[str, Expr]]]) -> list[dict[str, dict]]:
    """The statistics of every column of every part, from one aggregate over the frame, and one more (for each type of column) that counts values."""
    wanted = {f"{i}|{c}|{k}": a for i, (t, es) in enumerate(parts) for c, e in es.items() for k, a in t.statistics(e).items()}
    row = frame.df.agg(*[a.alias(n) for n, a in wanted.items()]).first().asDict() if wanted else {}
    out: list[dict[str, dict]] = [{c: {} for c in es} for _, es in parts]
    for name, value in row.items():
        i, c, k = name.split("|", 1)[0], name.split("|", 1)[1].rsplit("|", 1)[0], name.rsplit("|", 1)[1]
        out[int(i)][c][k] = value
    counted = [(i, c, e, t.counted) for i, (t, es) in enumerate(parts) for c, e in es.items() if t.counted]
    types = frame.df.select(*[e.column().alias(str(j)) for j, (_, _, e, _) in enumerate(counted)]).dtypes if counted else []
    for kind in dict.fromkeys(t for _, t in types):
        of_kind = [x for x, (_, t) in zip(counted, types, strict=True) if t == kind]
        pairs = F.array(*[F.struct(F.lit(j).alias("j"), e.column().alias("value")) for j, (_, _, e, _) in enumerate(of_kind)])
        counts = frame.df.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("j", "value").agg(F.count("*").alias("n"))
        modes = [j for j, x in enumerate(of_kind) if x[3] == "mode"]
        if modes:
            for i, c, _, _ in (of_kind[j] for j in modes):
                out[i][c]["mode"] = None
            for r in counts.where(F.col("j").isin(modes)).groupBy("j").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top")).collect():
                out[of_kind[r["j"]][0]][of_kind[r["j"]][1]]["mode"] = r["top"]["value"]
        sets = [j for j, x in enumerate(of_kind) if x[3] == "values"]
        if sets:
            for i, c, _, _ in (of_kind[j] for j in sets):
                out[i][c]["values"] = []
            rows = counts.where(F.col("j").isin(sets)).select("j", "value").limit(len(sets) * (MAX_CATEGORIES + 1)).collect()
            for r in rows:
                out[of_kind[r["j"]][0]][of_kind[r["j"]][1]]["values"].append(r["value"])
            for i, c, _, _ in (of_kind[j] for j in sets):
                found = out[i][c]["values"]
                if len(found) > MAX_CATEGORIES:
                    raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories")
                found.sort()
    return out


@dataclass
class Fitted:
    """A transformer with the statistics of its columns; applying it to other data uses the same ones."""

    transformer: Transformer
    columns: list[str]
    found: dict[str, dict]

    def expressions(self, given: dict[str, Expr] | None = None) -> dict[str, Expr]:
        return {c: self.transformer.bound((given or {}).get(c, col(c)), self.found[c]) for c in self.columns}

    def transform(self, frame: TracedFrame) -> TracedFrame:
        """The columns replaced by what they become; the other columns stay."""
        frame._known(self.columns)
        made = self.expressions()
        items = [f"{made[c].sql()} AS {quoted(c)}" if c in made else quoted(c) for c in frame.columns]
        name = type(self.transformer).__name__
        return frame.transformed(name, f"{name} of {', '.join(self.columns)}", {c: e.column() for c, e in made.items()}, frame.columns, f"SELECT {', '.join(items)} FROM {frame._name()}", track=self.columns if self.transformer.keeps_names else ())


@dataclass
class Imputer(Transformer):
    """Fills nulls with the mean or the most frequent value (the smallest of equally frequent ones, nulls not counted). A column
    of nulls alone stays null."""

    strategy: str = "mean"
    keeps_names = True

    def __post_init__(self):
        if self.strategy not in ("mean", "most_frequent"):
            raise ValueError(f"unknown strategy {self.strategy!r}")

    def statistics(self, e):
        return {"fill": F.avg(e.column())} if self.strategy == "mean" else {}

    @property
    def counted(self):
        return "mode" if self.strategy == "most_frequent" else None

    def bound(self, e, found):
        return Expr("coalesce({}, {})", e, lit(found[self.counted or "fill"]))


@dataclass
class OneHot(Transformer):
    """A vector with a place for every non-null value seen in fitting, in sorted order. Null and unseen values give zeros, or an
    error if ``handle_unknown="error"``."""

    handle_unknown: str = "ignore"
    vector = True
    counted = "values"

    def bound(self, e, found):
        values = [lit(v) for v in found["values"]]
        if not values:
            return Expr("CAST(array() AS array<double>)", columns=e.columns)
        every = "array(" + ", ".join(["{}"] * len(values)) + ")"
        hot = Expr(f"transform({every}, c -> CAST(c <=> {{}} AS DOUBLE))", *values, e)
        return hot if self.handle_unknown == "ignore" else Expr("CASE WHEN {} THEN {} ELSE raise_error('unknown category') END", e.isin(found["values"]), hot)


@dataclass
class Scaler(Transformer):
    """Zero mean and unit (population) variance; a constant column becomes zeros."""

    def statistics(self, e):
        return {"mean": F.avg(e.column()), "std": F.stddev_pop(e.column())}

    def bound(self, e, found):
        return Expr("(({} - {}) / {})", e, lit(found["mean"]), lit(float(found["std"] or 1.0)))


@dataclass
class KBins(Transformer):
    """The number of the bin, of ``n_bins`` equally wide ones between the least and the largest value; values outside go to the outer bins."""

    n_bins: int = 5
    encode: str = "ordinal"
    strategy: str = "uniform"

    def __post_init__(self):
        if (self.encode, self.strategy) != ("ordinal", "uniform"):
            raise ValueError("only ordinal bins of uniform width")

    def statistics(self, e):
        return {"min": F.min(e.column()).cast("double"), "max": F.max(e.column()).cast("double")}

    def bound(self, e, found):
        if found["min"] is None:
            return Expr("CAST(NULL AS DOUBLE)", columns=e.columns)
        step = (found["max"] - found["min"]) / self.n_bins
        if not step:
            return Expr("CASE WHEN {} IS NOT NULL THEN CAST(0 AS DOUBLE) END", e)
        return Expr("CASE WHEN {} IS NOT NULL THEN CAST(least({}, greatest(0, floor(({} - {}) / {}))) AS DOUBLE) END", e, lit(self.n_bins - 1), e, lit(found["min"]), lit(step))


def label_binarize(frame: TracedFrame, column: str, classes: list) -> TracedFrame:
    """0 for the first class, 1 for the second, null for anything else."""
    if len(classes) != 2:
        raise ValueError("two classes are needed")
    frame._known([column])
    made = Expr("CASE WHEN {} = {} THEN 0 WHEN {} = {} THEN 1 END", col(column), lit(classes[0]), col(column), lit(classes[1]))
    items = [f"{made.sql()} AS {quoted(c)}" if c == column else quoted(c) for c in frame.columns]
    return frame.transformed("label_binarize", f"{column}: {classes[0]!r} is 0, {classes[1]!r} is 1", {column: made.column()}, frame.columns, f"SELECT {', '.join(items)} FROM {frame._name()}",
                             Op.DERIVE, [column])


@dataclass
class ColumnTransformer:
    """Several chains of transformers, each on columns of its own, put side by side in one array of doubles.

    ``parts``: (name, transformer or list of transformers, columns). Chains are fitted depth by depth, all parts together, so a
    fit takes as many aggregates as the longest chain has steps.
    """

    parts: list[tuple[str, Transformer | list[Transformer], list[str]]]
    output: str = "features"
    fitted: list[list[Fitted]] = field(default_factory=list)

    def fit(self, frame: TracedFrame) -> ColumnTransformer:
        chains = [(steps if isinstance(steps, list) else [steps], list(columns)) for _, steps, columns in self.parts]
        now = [{c: col(c) for c in columns} for _, columns in chains]
        done: list[list[Fitted]] = [[] for _ in chains]
        for depth in range(max((len(s) for s, _ in chains), default=0)):
            at = [i for i, (steps, _) in enumerate(chains) if depth < len(steps)]
            for i, found in zip(at, fit_level(frame, [(chains[i][0][depth], now[i]) for i in at]), strict=True):
                one = Fitted(chains[i][0][depth], chains[i][1], found)
                done[i].append(one)
                now[i] = one.expressions(now[i])
        return ColumnTransformer(self.parts, self.output, done)

    def expression(self) -> Expr:
        """All parts as one array."""
        arrays = []
        for chain in self.fitted:
            now: dict[str, Expr] = {}
            for one in chain:
                now = one.expressions(now or None)
            arrays += [e if chain[-1].transformer.vector else Expr("array(CAST({} AS DOUBLE))", e) for e in now.values()]
        return Expr("concat(" + ", ".join(["{}"] * len(arrays)) + ")", *arrays)

    def transform(self, frame: TracedFrame) -> TracedFrame:
        """``frame`` with the array added. Recorded as a projection and its transformers for each part, and their concatenation."""
        ends = []
        for chain in self.fitted:
            part = frame.select(*chain[0].columns)
            for one in chain:
                part = one.transform(part)
            ends.append(part)
        made = self.expression()
        visible = [*[c for c in frame.columns if c != self.output], self.output]
        node = frame.session.record(Op.ASSEMBLE, "ColumnTransformer", f"{self.output} from {len(self.parts)} parts", visible, tuple(e.node for e in ends))
        sql = f"SELECT {', '.join(map(quoted, visible[:-1]))}, {made.sql()} AS {quoted(self.output)} FROM {frame._name()}"
        return TracedFrame(frame.session, frame.df.withColumn(self.output, made.column()), node, visible, frame.order, sql)

    def fit_transform(self, frame: TracedFrame) -> TracedFrame:
        return self.fit(frame).transform(frame)
