"""Traced frames: lazy DataFrames whose operators are recorded, with hidden columns for inspections.

Hidden columns are ordinary columns, so selections, projections and joins carry them through Catalyst, which also drops them
again wherever nothing asks for them. Every operator adds one node and returns a new frame.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.expressions import Expr, col, lit
from tracewell.plans.nodes import DagNode, Op
from tracewell.plans.session import HIDDEN, Session, row_column, sensitive_column

AGGREGATES = {
    "mean": F.avg, "avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp, "std_pop": F.stddev_pop, "var": F.var_samp, "var_pop": F.var_pop,
    "first": F.first, "median": F.median, "nunique": F.count_distinct, "mode": lambda c: F.mode(c, True),
}
SQL_AGGREGATES = {"mean": "avg", "std": "stddev_samp", "std_pop": "stddev_pop", "var": "var_samp", "nunique": "count(DISTINCT"}
HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "cross": "cross"}


def directed(column: Column, ascending: bool) -> Column:
    """Nulls come first in ascending order and last in descending order, in SQL too."""
    return column.asc_nulls_first() if ascending else column.desc_nulls_last()


def order_sql(order: Iterable[tuple[str, bool]]) -> str:
    return ", ".join(f"{quoted(c)} {'ASC NULLS FIRST' if up else 'DESC NULLS LAST'}" for c, up in order)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class TracedFrame:
    """A DataFrame, the node that made it, and which columns a user sees."""

    def __init__(self, session: Session, df: DataFrame, node: DagNode, visible: Iterable[str], order: Iterable[tuple[str, bool]] = (), sql: str | None = ""):
        """``order``: (column, whether ascending) pairs, as far as the frame has those columns. ``sql`` is None if SQL cannot express the operator."""
        self.session, self.df, self.node = session, df, node
        self.columns, self.sql = list(visible), sql
        have = set(df.columns)
        self.order = list(takewhile(lambda x: x[0] in have, order))
        session.frames[node] = self

    # What a user gets out.

    def to_df(self) -> DataFrame:
        """The visible columns as a DataFrame."""
        return self.df.select(*[F.col(quoted(c)) for c in self.columns])

    def to_pandas(self):
        return self.ordered().select(*[F.col(quoted(c)) for c in self.columns]).toPandas()

    def ordered(self) -> DataFrame:
        """All columns, hidden ones too, with rows in the frame's own order where it has one."""
        return self.df.orderBy(*[directed(F.col(quoted(c)), up) for c, up in self.order]) if self.order else self.df

    def __getitem__(self, key):
        """``frame["c"]`` is an expression; a list of names projects; an expression filters."""
        if isinstance(key, str):
            self._known([key])
            return col(key, self.node)
        return self.where(key) if isinstance(key, Expr) else self.select(*key)

    # One relation in, one out.

    def _known(self, names: Iterable[str]) -> None:
        if missing := [n for n in names if n not in self.columns]:
            raise KeyError(f"no such columns: {missing}; there are {self.columns}")

    def _usable(self, value: Expr) -> None:
        """Columns must be there, and be this frame's or those of a frame it was made from: rows of other frames are in no known relation to its rows."""
        self._known(value.columns)
        mine, todo = set(), [self.node]
        while todo and not value.origins <= mine:
            node = todo.pop()
            if node not in mine:
                mine.add(node)
                todo += self.session.dag.parents(node)
        if others := value.origins - mine:
            raise ValueError(f"{value.sql()} has columns of another frame ({', '.join(sorted(o.function for o in others))}); merge the two on a key first")

    def _name(self) -> str:
        return f"op_{self.node.node_id}".replace("-", "x")

    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def _next(self, operator: Op, function: str, description: str, df: DataFrame, visible: Iterable[str], sql: str | None, order=None, changed: Iterable[str] = ()) -> TracedFrame:
        """The frame after one operator. Its order is this one's up to the first column that is ``changed`` or gone, unless given."""
        visible = list(visible)
        node = self.session.record(operator, function, description, visible, (self.node,))
        kept = takewhile(lambda x: x[0] not in set(changed), self.order) if order is None else order
        return TracedFrame(self.session, df, node, visible, kept, sql)

    def select(self, *names: str) -> TracedFrame:
        """Keeps the named columns, in that order."""
        self._known(names)
        keep = [F.col(quoted(c)) for c in [*names, *self.hidden()]]
        return self._next(Op.PROJECT, "select", f"keep {', '.join(names)}", self.df.select(*keep), names, f"SELECT {', '.join(map(quoted, names))} FROM {self._name()}")

    def where(self, condition: Expr) -> TracedFrame:
        """Keeps rows for which the condition is true; columns that were projected away in this frame cannot be named."""
        self._usable(condition)
        return self._next(Op.FILTER, "where", f"rows where {condition.sql()}", self.df.where(condition.column()), self.columns, f"SELECT * FROM {self._name()} WHERE {condition.sql()}")

    def where_select(self, condition: Expr, *names: str) -> TracedFrame:
        """Filters by a condition that may use columns which the following projection drops: ``df[cols][df['c'] ...]``."""
        return self.where(condition).select(*names)

    def dropna(self, how: str = "any", thresh: int | None = None, subset: Iterable[str] | None = None) -> TracedFrame:
        """Drops rows with missing visible values (null, and NaN in floating-point columns)."""
        subset = list(self.columns if subset is None else subset)
        self._known(subset)
        double = {c for c, t in self.df.dtypes if t in ("double", "float")}
        missing = [f"({quoted(c)} IS NULL{f' OR isnan({quoted(c)})' if c in double else ''})" for c in subset]
        glue = " OR " if how == "any" else " AND "
        sql = f"SELECT * FROM {self._name()} WHERE NOT ({glue.join(missing)})" if thresh is None else f"SELECT * FROM {self._name()} WHERE {' + '.join(f'CAST(NOT {m} AS INT)' for m in missing)} >= {thresh}"
        return self._next(Op.FILTER, "dropna", f"rows without missing values in {', '.join(subset)}", self.df.dropna(how, thresh, subset), self.columns, sql)

    def with_column(self, name: str, value) -> TracedFrame:
        """Adds a column, or replaces the one of that name; ``value`` is an expression or a constant."""
        value = lit(value)
        self._usable(value)
        df = self._sensitive(self.df.withColumn(name, value.column()), [name])
        new = name not in self.columns
        star = f"SELECT *, {value.sql()} AS {quoted(name)} FROM {self._name()}" if new else "SELECT " + ", ".join(f"{value.sql()} AS {quoted(c)}" if c == name else quoted(c) for c in self.columns) + f" FROM {self._name()}"
        return self._next(Op.DERIVE, "with_column", f"{name} := {value.sql()}", df, [*self.columns, name] if new else self.columns, star, changed=[name])

    def replace(self, old, new, subset: Iterable[str] | None = None) -> TracedFrame:
        """Replaces values equal to ``old`` as a whole, in string columns (of ``subset``) for strings and in all others for numbers."""
        if isinstance(old, dict):
            raise TypeError("replace takes one value and its replacement")
        text = {c for c, t in self.df.dtypes if t == "string"}
        names = [c for c in (self.columns if subset is None else subset) if (c in text) == isinstance(old, str)]
        df = self._sensitive(self.df.withColumns({c: F.when(F.col(quoted(c)) == F.lit(old), F.lit(new)).otherwise(F.col(quoted(c))) for c in names}), names)
        items = [f"CASE WHEN {quoted(c)} = {lit(old).sql()} THEN {lit(new).sql()} ELSE {quoted(c)} END AS {quoted(c)}" if c in names else quoted(c) for c in self.columns]
        return self._next(Op.DERIVE, "replace", f"{old!r} becomes {new!r}", df, self.columns, f"SELECT {', '.join(items)} FROM {self._name()}", changed=names)

    def _sensitive(self, df: DataFrame, changed: Iterable[str]) -> DataFrame:
        """Hidden copies follow the changed columns."""
        return df.withColumns({sensitive_column(c): F.col(quoted(c)) for c in changed if c in self.session.sensitive})

    def transformed(self, function: str, description: str, values: dict[str, Column], visible: Iterable[str], sql: str, operator=Op.ENCODE, track: Iterable[str] = ()) -> TracedFrame:
        """A frame with ``values`` set; hidden copies of the ``track`` columns follow them."""
        return self._next(operator, function, description, self._sensitive(self.df.withColumns(values), track), visible, sql, changed=values)

    def order_by(self, *names: str, ascending: bool | list[bool] = True) -> TracedFrame:
        """Sorts; nulls come first in ascending order and last in descending order."""
        self._known(names)
        ups = list(ascending) if isinstance(ascending, (list, tuple)) else [ascending] * len(names)
        order = list(zip(names, map(bool, ups), strict=True))
        df = self.df.orderBy(*[directed(F.col(quoted(n)), up) for n, up in order])
        return self._next(Op.SORT, "order_by", f"by {', '.join(n if up else f'{n} descending' for n, up in order)}", df, self.columns, f"SELECT * FROM {self._name()} ORDER BY {order_sql(order)}", order)

    def limit(self, n: int) -> TracedFrame:
        """The first ``n`` rows in the frame's order (any ``n`` if it has none)."""
        seen = list(takewhile(lambda x: x[0] in self.columns, self.order))
        by = f" ORDER BY {order_sql(seen)}" if seen else ""
        return self._next(Op.LIMIT, "limit", f"first {n} rows", self.ordered().limit(n), self.columns, f"SELECT * FROM {self._name()}{by} LIMIT {n}")

    def group_by(self, *keys: str, dropna: bool = False) -> GroupedFrame:
        """Nothing is recorded until ``agg``. Null keys form a group unless ``dropna``."""
        self._known(keys)
        return GroupedFrame(self, keys, dropna)

    def agg(self, **new: tuple[str, str]) -> TracedFrame:
        return GroupedFrame(self, (), False).agg(**new)

    def distinct_values(self, name: str) -> TracedFrame:
        """The different non-null values of a column, one row each."""
        return self.where(~col(name).is_null()).group_by(name).agg(n=(name, "count")).select(name)

    def merge(self, other: TracedFrame, on: str | list[str] | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), null_safe: bool = False, sort: bool = False) -> TracedFrame:
        """Joins on equal keys, which appear once in the result (from whichever side has them).

        Other columns found on both sides get the suffixes. Null keys match nothing unless ``null_safe``. A cross join must be
        asked for with ``how="cross"`` and takes no keys. How the join runs is left to Spark, which broadcasts a side only
        where it is small and splits skewed partitions.
        """
        keys = [on] if isinstance(on, str) else list(on or [])
        if how not in HOW or (how == "cross") == bool(keys):
            raise ValueError("how must be one of " + ", ".join(HOW) + "; keys are needed for all but cross")
        self._known(keys)
        other._known(keys)
        both = [c for c in self.columns if c in other.columns and c not in keys]
        names = ({c: c + suffixes[0] for c in both}, {c: c + suffixes[1] for c in both})
        taken = set(self.hidden())
        fresh = {c: f"{c}_{other.node.node_id}" if c in taken else c for c in other.hidden()}
        left = self.df.select(*[F.col(quoted(c)).alias(names[0].get(c, c)) for c in self.columns], *map(quoted, self.hidden()))
        right = other.df.select(*[F.col(quoted(c)).alias(f"{HIDDEN}key_{c}" if c in keys else names[1].get(c, c)) for c in other.columns], *[F.col(quoted(c)).alias(fresh[c]) for c in other.hidden()])
        same = [(F.col(quoted(k)).eqNullSafe(F.col(quoted(f"{HIDDEN}key_{k}"))) if null_safe else F.col(quoted(k)) == F.col(quoted(f"{HIDDEN}key_{k}"))) for k in keys]
        condition = None
        for s in same:
            condition = s if condition is None else condition & s
        df = left.crossJoin(right) if how == "cross" else left.join(right, condition, HOW[how])
        key = lambda k: F.coalesce(F.col(quoted(k)), F.col(quoted(f"{HIDDEN}key_{k}")))
        df = df.withColumns({k: key(k) for k in keys if HOW[how] in ("right", "full")}).drop(*[f"{HIDDEN}key_{k}" for k in keys])
        # A sensitive value that both sides carry: the left one's, else the right one's.
        clash = [c for c in taken if c in fresh and c.startswith(f"{HIDDEN}value_")]
        df = df.withColumns({c: F.coalesce(F.col(quoted(c)), F.col(quoted(fresh[c]))) for c in clash}).drop(*[fresh[c] for c in clash])
        visible = [names[0].get(c, c) for c in self.columns] + [names[1].get(c, c) for c in other.columns if c not in keys]
        order = [(names[0].get(c, c), up) for c, up in self.order] + [(fresh.get(c, names[1].get(c, c)), up) for c, up in other.order]
        node = self.session.record(Op.JOIN, "merge", f"on {keys} ({how})" if keys else "cross", visible, (self.node, other.node))
        test = " AND ".join(f"tb1.{quoted(k)} {'<=>' if null_safe else '='} tb2.{quoted(k)}" for k in keys)
        items = [f"coalesce(tb1.{quoted(c)}, tb2.{quoted(c)}) AS {quoted(c)}" if c in keys else f"tb1.{quoted(c)} AS {quoted(names[0].get(c, c))}" for c in self.columns]
        items += [f"tb2.{quoted(c)} AS {quoted(names[1].get(c, c))}" for c in other.columns if c not in keys]
        sql = f"SELECT {', '.join(items)} FROM {self._name()} tb1 {HOW[how].upper()} JOIN {other._name()} tb2{' ON ' + test if keys else ''}"
        if sort:
            order = [*[(k, True) for k in keys], *[x for x in order if x[0] not in keys]]
            df, sql = df.orderBy(*map(quoted, keys)), f"{sql} ORDER BY {order_sql(order[: len(keys)])}"
        return TracedFrame(self.session, df, node, visible, [x for x in order if x[0] in df.columns], sql)


class GroupedFrame:
    def __init__(self, frame: TracedFrame, keys: tuple[str, ...], dropna: bool):
        self.frame, self.keys, self.dropna = frame, keys, dropna

    def agg(self, **new: tuple[str, str]) -> TracedFrame:
        """``agg(new=("column", "function"))``. Functions are those of ``AGGREGATES``; ``std`` and ``var`` are the sample's. The
        result is a source of its own as far as row lineage goes."""
        f = self.frame
        for column, function in new.values():
            f._known([column])
            if function not in AGGREGATES:
                raise ValueError(f"unknown aggregate {function!r}; there are {sorted(AGGREGATES)}")
        rows = f.df.dropna("any", None, list(self.keys)) if self.dropna and self.keys else f.df
        df = rows.groupBy(*map(quoted, self.keys)).agg(*[AGGREGATES[fn](F.col(quoted(c))).alias(n) for n, (c, fn) in new.items()])
        df = f._sensitive(df, self.keys)
        node = f.session.record(Op.AGGREGATE, "group_by.agg", f"{', '.join(f'{fn}({c})' for c, fn in new.values())} by {', '.join(self.keys) or 'nothing'}", [*self.keys, *new], (f.node,))
        order = [(k, True) for k in self.keys]
        if f.session.rows:
            df = df.withColumn(row_column(node.node_id), F.xxhash64(*map(quoted, self.keys)) if self.keys else F.lit(0).cast("long"))
        call = lambda c, fn: f"{SQL_AGGREGATES.get(fn, fn)}{' ' if fn == 'nunique' else '('}{quoted(c)})"
        items = [*map(quoted, self.keys), *[f"{call(c, fn)} AS {quoted(n)}" for n, (c, fn) in new.items()]]
        kept = f" WHERE {' AND '.join(f'{quoted(k)} IS NOT NULL' for k in self.keys)}" if self.dropna and self.keys else ""
        sql = f"SELECT {', '.join(items)} FROM {f._name()}{kept}{' GROUP BY ' + ', '.join(map(quoted, self.keys)) if self.keys else ''}"
        return TracedFrame(f.session, df, node, [*self.keys, *new], order, sql)


def value_ratio(frame: TracedFrame, name: str) -> DataFrame:
    """(value, n, ratio) of a column's values, null as a value of its own."""
    counted = frame.df.groupBy(F.col(quoted(name)).alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))
