"""Queries by operator. Each reads whole tables; SQL that gives the same rows stands next to it where SQL can express it.

The tables hold no nulls, so queries about nulls make them with a condition. Results that are floating-point are rounded the same
way on both sides; counts are longs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.checks import NoBiasIntroducedFor, NoIllegalFeatures, NoMissingEmbeddings
from tracewell.checks.bias import distribution_change
from tracewell.functions import Expr, col, lit
from tracewell.inspections import FirstRows, HistogramForColumns, RowLineage
from tracewell.inspections.rows import lineage_of
from tracewell.inspector import PipelineInspector
from tracewell.ml import ColumnTransformer, DecisionTree, Imputer, KBins, LogisticRegression, NeuralNetwork, OneHot, Scaler, WordVectors, label_binarize, train_test_split
from tracewell.operators.frame import TracedFrame, value_ratio
from tracewell.plans.session import Session, row_column, sensitive_column
from tracewell.plans.sqltext import to_sql
from tracewell.sources import read_csv, read_parquet
from tracewell.sources.readers import numbered
from tracewell.sources.scratch import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables under a folder as traced frames of one session."""

    def __init__(self, spark: SparkSession, sf_dir: str, **options):
        self.session, self._dir = Session(spark, **options), sf_dir

    def __getattr__(self, name: str) -> TracedFrame:
        with self.session.active():
            return read_parquet(f"{self._dir}/{name}.parquet")


def query(name: str, sql: str | None = None, **options):
    """Registers a query: a function of the tables that returns a frame or a DataFrame."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir, **options))
            return out.to_df() if isinstance(out, TracedFrame) else out

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(f: TracedFrame, *names: str, digits: int = 6) -> TracedFrame:
    for n in names:
        f = f.with_column(n, Expr(f"round(CAST({{}} AS DOUBLE), {digits})", col(n)))
    return f


def nulled(f: TracedFrame, name: str, value) -> TracedFrame:
    return f.with_column(name, Expr("nullif({}, {})", col(name), lit(value)))


# Scans, projections, filters.

query("scan_project", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_quantity", "l_shipdate"))


@query("filter_compare", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_quantity > 10 AND l_quantity >= 11 AND l_quantity < 40 AND l_quantity <= 39 AND l_quantity <> 20 AND l_returnflag = 'N'""")
def filter_compare(t):
    f = t.lineitem
    for condition in (f["l_quantity"] > 10, f["l_quantity"] >= 11, f["l_quantity"] < 40, f["l_quantity"] <= 39, f["l_quantity"] != 20, f["l_returnflag"] == "N"):
        f = f.where(condition)
    return f.select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_bool", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE ((l_quantity <= 30 AND l_quantity >= 10) OR NOT (l_returnflag = 'R'))")
def filter_bool(t):
    f = t.lineitem
    return f[((f["l_quantity"] <= 30) & (f["l_quantity"] >= 10)) | ~(f["l_returnflag"] == "R")].select("l_orderkey", "l_linenumber")


@query("filter_isin", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_isin(t):
    f = t.orders
    return f.where(f["o_orderpriority"].isin(["1-URGENT", "2-HIGH"])).select("o_orderkey", "o_orderpriority")


@query("filter_null_not_equal", "SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE s <> 'P'")
def filter_null_not_equal(t):
    f = nulled(t.orders, "o_orderstatus", "F")
    return f.where(f["o_orderstatus"] != "P").select("o_orderkey")


@query("filter_null_differs", "SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders) WHERE s IS DISTINCT FROM 'P'")
def filter_null_differs(t):
    f = nulled(t.orders, "o_orderstatus", "F")
    return f.where(~f["o_orderstatus"].same_as("P")).select("o_orderkey")


@query("arith_columns", """SELECT l_orderkey, l_linenumber, round(CAST(l_extendedprice * (1 - l_discount) AS DOUBLE), 6) AS net, round(CAST(1.2 * l_quantity AS DOUBLE), 6) AS more,
    round(CAST(l_quantity - 1 AS DOUBLE), 6) AS less, round(100.0 / CAST(l_quantity AS DOUBLE), 6) AS part, round(CAST(l_quantity + l_tax AS DOUBLE), 6) AS added FROM lineitem""")
def arith_columns(t):
    f = t.lineitem
    f = f.with_column("net", f["l_extendedprice"] * (1 - f["l_discount"])).with_column("more", 1.2 * f["l_quantity"]).with_column("less", f["l_quantity"] - 1)
    f = f.with_column("part", 100.0 / f["l_quantity"]).with_column("added", f["l_quantity"] + f["l_tax"])
    return rounded(f.select("l_orderkey", "l_linenumber", "net", "more", "less", "part", "added"), "net", "more", "less", "part", "added")


@query("precedence", "SELECT l_orderkey, l_linenumber, round(CAST((l_quantity + l_tax) * l_discount AS DOUBLE), 6) AS x FROM lineitem")
def precedence(t):
    f = t.lineitem
    return rounded(f.with_column("x", (f["l_quantity"] + f["l_tax"]) * f["l_discount"]).select("l_orderkey", "l_linenumber", "x"), "x")


@query("division_by_zero", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount <> 0 THEN CAST(l_tax AS DOUBLE) / CAST(l_discount AS DOUBLE) END, 6) AS x FROM lineitem")
def division_by_zero(t):
    f = t.lineitem
    return rounded(f.with_column("x", f["l_tax"] / f["l_discount"]).select("l_orderkey", "l_linenumber", "x"), "x")


@query("with_column", "SELECT *, o_totalprice > 100000 AS big FROM orders")
def with_column(t):
    f = t.orders
    return f.with_column("big", f["o_totalprice"] > 100000)


query("with_constant", "SELECT r_regionkey, 'it''s' AS note, 7 AS n FROM region")(lambda t: t.region.with_column("note", "it's").with_column("n", 7).select("r_regionkey", "note", "n"))
query("overwrite_column", "SELECT r_regionkey + 1 AS r_regionkey, r_name FROM region")(lambda t: t.region.with_column("r_regionkey", col("r_regionkey") + 1).select("r_regionkey", "r_name"))
query("dropna_any", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '3-MEDIUM'")(
    lambda t: nulled(nulled(t.orders, "o_orderstatus", "F"), "o_orderpriority", "3-MEDIUM").select("o_orderkey", "o_orderstatus", "o_orderpriority").dropna())
query("dropna_subset", "SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '3-MEDIUM') AS o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")(
    lambda t: nulled(nulled(t.orders, "o_orderstatus", "F"), "o_orderpriority", "3-MEDIUM").select("o_orderkey", "o_orderstatus", "o_orderpriority").dropna(subset=["o_orderstatus"]))
query("replace_value", "SELECT o_orderkey, CASE WHEN o_orderpriority = '3-MEDIUM' THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority FROM orders")(
    lambda t: t.orders.replace("3-MEDIUM", "5-LOW").select("o_orderkey", "o_orderpriority"))


@query("filter_by_projected_away", "SELECT c_name FROM customer WHERE c_mktsegment IN ('BUILDING')")
def filter_by_projected_away(t):
    f = t.customer
    return f.where_select(f["c_mktsegment"].isin(["BUILDING"]), "c_name")


# Joins.

def renamed(f: TracedFrame, old: str, new: str) -> TracedFrame:
    return f.with_column(new, col(old)).select(*[new if c == old else c for c in f.columns])


def customers_orders(t, how: str, **options) -> TracedFrame:
    orders = renamed(t.orders.where(col("o_totalprice") > 200000).select("o_orderkey", "o_custkey"), "o_custkey", "c_custkey")
    customers = t.customer.where(col("c_acctbal") > 0).select("c_custkey", "c_mktsegment")
    return customers.merge(orders, "c_custkey", how, **options)


SIDES = "(SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) c {} JOIN (SELECT o_orderkey, o_custkey AS c_custkey FROM orders WHERE o_totalprice > 200000) o USING (c_custkey)"
for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    query(f"join_{'full' if _how == 'outer' else _how}", f"SELECT c_custkey, c_mktsegment, o_orderkey FROM {SIDES.format(_sql)}")(lambda t, how=_how: customers_orders(t, how))
query("join_cross", "SELECT a.r_name AS r_name_x, b.r_name AS r_name_y FROM region a CROSS JOIN region b")(lambda t: t.region.select("r_name").merge(t.region.select("r_name"), how="cross"))
query("join_sorted", f"SELECT c_custkey, c_mktsegment, o_orderkey FROM {SIDES.format('INNER')} ORDER BY c_custkey")(lambda t: customers_orders(t, "inner", sort=True))
query("join_suffix", "SELECT a.n_nationkey, a.n_name AS n_name_x, b.n_name AS n_name_y FROM nation a JOIN nation b USING (n_nationkey)")(
    lambda t: t.nation.select("n_nationkey", "n_name").merge(t.nation.select("n_nationkey", "n_name"), "n_nationkey"))
query("join_multikey", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem) USING (l_orderkey, l_linenumber) GROUP BY ALL""")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber").merge(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), ["l_orderkey", "l_linenumber"])
    .group_by("l_orderkey", "l_linenumber").agg(n=("l_suppkey", "count")))


@query("join_null_safe", "SELECT a.k, a.n_nationkey AS n_nationkey_x, b.n_nationkey AS n_nationkey_y FROM (SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation) a JOIN (SELECT nullif(n_regionkey, 2) AS k, n_nationkey FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(t):
    f = renamed(nulled(t.nation, "n_regionkey", 2).select("n_regionkey", "n_nationkey"), "n_regionkey", "k")
    return f.merge(f, "k", null_safe=True)


# Aggregates.

for _fn, _sql in (("mean", "avg"), ("std", "stddev_samp"), ("std_pop", "stddev_pop"), ("var", "var_samp"), ("sum", "sum"), ("min", "min"), ("max", "max")):
    query(f"group_{_fn}", f"SELECT o_orderpriority, round(CAST({_sql}(CAST(o_totalprice AS DOUBLE)) AS DOUBLE), 2) AS value FROM orders GROUP BY o_orderpriority")(
        lambda t, fn=_fn: rounded(t.orders.with_column("o_totalprice", Expr("CAST({} AS DOUBLE)", col("o_totalprice"))).group_by("o_orderpriority").agg(value=("o_totalprice", fn)), "value", digits=2))
query("group_count", "SELECT o_orderpriority, count(o_orderkey) AS n FROM orders GROUP BY o_orderpriority")(lambda t: t.orders.group_by("o_orderpriority").agg(n=("o_orderkey", "count")))
query("group_multi", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")(
    lambda t: t.orders.group_by("o_orderpriority", "o_orderstatus").agg(n=("o_orderkey", "count"), customers=("o_custkey", "nunique")))
query("group_null_key", "SELECT nullif(o_orderstatus, 'F') AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1")(lambda t: nulled(t.orders, "o_orderstatus", "F").group_by("o_orderstatus").agg(n=("o_orderkey", "count")))
query("group_dropna", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")(lambda t: nulled(t.orders, "o_orderstatus", "F").group_by("o_orderstatus", dropna=True).agg(n=("o_orderkey", "count")))
query("scalar_agg", "SELECT round(avg(CAST(l_quantity AS DOUBLE)), 6) AS a, round(stddev_pop(CAST(l_quantity AS DOUBLE)), 6) AS s, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high FROM lineitem")(
    lambda t: rounded(t.lineitem.with_column("q", Expr("CAST({} AS DOUBLE)", col("l_quantity"))).agg(a=("q", "mean"), s=("q", "std_pop"), low=("q", "min"), high=("q", "max")), "a", "s"))
query("distinct_values", "SELECT DISTINCT c_mktsegment FROM customer")(lambda t: t.customer.distinct_values("c_mktsegment"))
query("mode_value", "SELECT o_orderpriority AS value FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")(lambda t: t.orders.agg(value=("o_orderpriority", "mode")))
query("value_ratio", "SELECT c_mktsegment AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS ratio FROM customer GROUP BY 1")(
    lambda t: value_ratio(t.customer, "c_mktsegment").withColumn("ratio", F.round("ratio", 9)))


# Row numbers, order, splits.

query("rownum_index", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer")(
    lambda t: numbered(t.customer.to_df().select("c_custkey").orderBy("c_custkey").persist(), "rn").withColumn("rn", F.col("rn") + 1))
query("row_identity", "SELECT c_custkey AS row, c_custkey FROM customer", rows=True)(lambda t: t.customer.df.select(F.col("__tw_row_0").alias("row"), "c_custkey"))
query("top_k_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(
    lambda t: t.orders.order_by("o_totalprice", "o_orderkey", ascending=[False, True]).limit(10).select("o_orderkey", "o_totalprice"))
query("order_by_index", "SELECT * FROM nation ORDER BY n_nationkey")(lambda t: t.nation.order_by("n_nationkey"))


def split_counts(t):
    train, test = train_test_split(t.orders.select("o_orderkey"), key=["o_orderkey"])
    both = train.to_df().join(test.to_df(), "o_orderkey", "left_semi").agg(F.count("*").alias("shared"))
    return train.to_df().agg(F.count("*").alias("train")).crossJoin(test.to_df().agg(F.count("*").alias("test"))).crossJoin(both)


query("split_sizes", "SELECT count(*) - CAST(ceil(0.25 * count(*)) AS BIGINT) AS train, CAST(ceil(0.25 * count(*)) AS BIGINT) AS test, CAST(0 AS BIGINT) AS shared FROM orders")(split_counts)
SPLIT = "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY ('0x' || substr(md5(o_orderkey::VARCHAR || '|0'), 1, 15))::BIGINT, o_orderkey) AS place, count(*) OVER () AS n FROM orders) WHERE place {} ceil(0.25 * n)"
query("split_train", SPLIT.format(">"))(lambda t: train_test_split(t.orders, key=["o_orderkey"])[0].select("o_orderkey"))
query("split_test", SPLIT.format("<="))(lambda t: train_test_split(t.orders, key=["o_orderkey"])[1].select("o_orderkey"))
query("split_by_sql", SPLIT.format("<="))(lambda t: t.session.spark.sql(to_sql(train_test_split(t.orders, key=["o_orderkey"])[1].select("o_orderkey"))))


# Text files.

def written(t, f: TracedFrame, **options) -> str:
    """The frame as one CSV file in the shared folder, whose rows are in the frame's order."""
    path = scratch_folder(t.session.spark, "csv")
    f.ordered().select(*f.columns).coalesce(1).write.options(header=True, **options).csv(path)
    return path


@query("csv_scan", "SELECT n_nationkey, n_name, nullif(n_regionkey, 2) AS n_regionkey FROM nation")
def csv_scan(t):
    path = written(t, nulled(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey", 2), nullValue="?")
    with t.session.active():
        return read_csv(path, schema="n_nationkey long, n_name string, n_regionkey long")


@query("csv_inferred", "SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer WHERE c_acctbal > 0")
def csv_inferred(t):
    path = written(t, t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), sep="|")
    with t.session.active():
        f = read_csv(path, sep="|")
        f = f.where(f["c_acctbal"] > 0)
        return f.with_column("c_acctbal", Expr("CAST({} AS DOUBLE)", col("c_acctbal"))).with_column("c_custkey", Expr("CAST({} AS BIGINT)", col("c_custkey")))


@query("csv_lineage", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row, n_nationkey FROM nation", rows=True)
def csv_lineage(t):
    path = written(t, t.nation.select("n_nationkey", "n_name").order_by("n_nationkey"))
    with t.session.active():
        f = read_csv(path, schema="n_nationkey long, n_name string")
    return f.df.select(F.col(row_column(f.node.node_id)).alias("row"), "n_nationkey")


@query("csv_index", "SELECT n_nationkey AS row, n_name FROM nation")
def csv_index(t):
    path = written(t, t.nation.select("n_nationkey", "n_name"))
    with t.session.active():
        f = read_csv(path, schema="n_nationkey long, n_name string", index_col=0)
    return f.df.select(F.col(row_column(f.node.node_id)).alias("row"), "n_name")


# Preprocessing.

query("impute_mode", """SELECT o_orderkey, coalesce(nullif(o_orderpriority, '3-MEDIUM'), (SELECT o_orderpriority FROM orders WHERE o_orderpriority <> '3-MEDIUM' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM orders""")(
    lambda t: Imputer("most_frequent").fit_transform(nulled(t.orders, "o_orderpriority", "3-MEDIUM"), "o_orderpriority").select("o_orderkey", "o_orderpriority"))


def quantity(t) -> TracedFrame:
    return t.lineitem.with_column("q", Expr("CAST({} AS DOUBLE)", col("l_quantity"))).select("l_orderkey", "l_linenumber", "q")


Q = "(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)"
query("impute_mean", f"SELECT l_orderkey, l_linenumber, round(coalesce(nullif(q, 1), (SELECT avg(nullif(q, 1)) FROM {Q})), 6) AS q FROM {Q}")(
    lambda t: rounded(Imputer().fit_transform(nulled(quantity(t), "q", 1.0), "q"), "q"))
query("standard_scale", f"SELECT l_orderkey, l_linenumber, round((q - (SELECT avg(q) FROM {Q})) / (SELECT stddev_pop(q) FROM {Q}), 6) AS q FROM {Q}")(lambda t: rounded(Scaler().fit_transform(quantity(t), "q"), "q"))
query("kbins_uniform", f"SELECT l_orderkey, l_linenumber, least(3, greatest(0, floor((q - (SELECT min(q) FROM {Q})) / (SELECT (max(q) - min(q)) / 4 FROM {Q}))))::DOUBLE AS q FROM {Q}")(
    lambda t: KBins(4).fit_transform(quantity(t), "q"))
query("label_binarize", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS o_orderstatus FROM orders")(
    lambda t: label_binarize(t.orders, "o_orderstatus", ["F", "O"]).select("o_orderkey", "o_orderstatus"))


def places(f: TracedFrame, key: str, name: str, *kept: str) -> DataFrame:
    return f.to_df().select(key, *kept, F.posexplode(name).alias("position", "value")).withColumn("position", F.col("position").cast("long"))


query("one_hot", """WITH s AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS position FROM (SELECT DISTINCT c_mktsegment FROM customer))
    SELECT c_custkey, position, (c_mktsegment = v)::INT::DOUBLE AS value FROM customer, s""")(lambda t: places(OneHot().fit_transform(t.customer, "c_mktsegment"), "c_custkey", "c_mktsegment"))


@query("one_hot_unseen", """WITH s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS position FROM (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment <> 'BUILDING'))
    SELECT c_custkey, position, (c_mktsegment = v)::INT::DOUBLE AS value FROM customer, s""")
def one_hot_unseen(t):
    f = t.customer
    return places(OneHot().fit(f.where(f["c_mktsegment"] != "BUILDING"), "c_mktsegment").transform(f), "c_custkey", "c_mktsegment")


def encoded(t) -> TracedFrame:
    f = nulled(t.orders.with_column("price", Expr("CAST({} AS DOUBLE)", col("o_totalprice"))), "o_orderstatus", "P").select("o_orderkey", "o_orderstatus", "price")
    return ColumnTransformer([("status", [Imputer("most_frequent"), OneHot()], ["o_orderstatus"]), ("bins", [Imputer(), KBins(4)], ["price"]), ("scaled", Scaler(), ["price"])]).fit_transform(f)


@query("column_transformer", """WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p, coalesce(nullif(o_orderstatus, 'P'), (SELECT o_orderstatus FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS s FROM orders),
    c AS (SELECT s AS v, row_number() OVER (ORDER BY s) - 1 AS position FROM (SELECT DISTINCT s FROM o)), n AS (SELECT count(*) AS n FROM c), m AS (SELECT min(p) AS low, max(p) AS high, avg(p) AS mean, stddev_pop(p) AS sd FROM o)
    SELECT o_orderkey, position, (s = v)::INT::DOUBLE AS value FROM o, c
    UNION ALL SELECT o_orderkey, n, least(3, greatest(0, floor((p - low) / ((high - low) / 4))))::DOUBLE FROM o, n, m
    UNION ALL SELECT o_orderkey, n + 1, round((p - mean) / sd, 6) FROM o, n, m""")
def column_transformer(t):
    return places(encoded(t), "o_orderkey", "features").withColumn("value", F.round("value", 6))


# Inspections and checks.

def histogram(f: TracedFrame, name: str) -> DataFrame:
    return f.df.groupBy(F.col(sensitive_column(name)).alias("value")).agg(F.count("*").alias("n"))


SEG = {"sensitive": ("c_mktsegment",)}
query("histogram_scan", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1", **SEG)(lambda t: histogram(t.customer, "c_mktsegment"))
query("histogram_filter", "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1", **SEG)(lambda t: histogram(t.customer.where(col("c_acctbal") > 0), "c_mktsegment"))
query("histogram_projected_away", "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1", **SEG)(
    lambda t: histogram(t.customer.select("c_custkey", "c_acctbal").where(col("c_acctbal") > 0).select("c_custkey"), "c_mktsegment"))
query("histogram_join", "SELECT c_mktsegment AS value, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1", **SEG)(
    lambda t: histogram(t.customer.select("c_custkey").merge(renamed(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "c_custkey"), "c_custkey"), "c_mktsegment"))
query("histogram_imputed", """SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), (SELECT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS value, count(*) AS n
    FROM customer GROUP BY 1""", **SEG)(lambda t: histogram(Imputer("most_frequent").fit_transform(nulled(t.customer, "c_mktsegment", "BUILDING"), "c_mktsegment"), "c_mktsegment"))


def change(spark, before: DataFrame, after: DataFrame) -> DataFrame:
    """Before and after of a histogram with shares and their relative change, as one full join on the value."""
    b, a = before.withColumnRenamed("n", "before"), after.withColumnRenamed("n", "after").withColumnRenamed("value", "v")
    both = b.join(a, F.col("value").eqNullSafe(F.col("v")), "full").select(F.coalesce("value", "v").alias("value"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    every = Window.partitionBy()
    shares = both.withColumn("rb", F.try_divide("before", F.sum("before").over(every))).withColumn("ra", F.try_divide("after", F.sum("after").over(every)))
    return shares.select("value", "before", "after", F.round(F.try_divide(F.col("ra") - F.col("rb"), F.col("rb")), 9).alias("change"))


CHANGE = """WITH b AS ({}), a AS ({}), j AS (SELECT coalesce(b.value, a.value) AS value, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM b FULL JOIN a ON b.value IS NOT DISTINCT FROM a.value),
    s AS (SELECT *, before / sum(before) OVER () AS rb, after / sum(after) OVER () AS ra FROM j) SELECT value, before, after, round(CASE WHEN rb <> 0 THEN (ra - rb) / rb END, 9) AS change FROM s"""


@query("bias_selection", CHANGE.format("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1", "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_nationkey < 5 GROUP BY 1"), **SEG)
def bias_selection(t):
    f = t.customer
    return change(t.session.spark, histogram(f, "c_mktsegment"), histogram(f.where(f["c_nationkey"] < 5), "c_mktsegment"))


@query("bias_join", CHANGE.format("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1", "SELECT c_mktsegment AS value, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1"), **SEG)
def bias_join(t):
    f = t.customer
    return change(t.session.spark, histogram(f, "c_mktsegment"), histogram(f.select("c_custkey").merge(renamed(t.orders.select("o_custkey"), "o_custkey", "c_custkey"), "c_custkey"), "c_mktsegment"))


@query("bias_impute", CHANGE.format("SELECT nullif(c_mktsegment, 'BUILDING') AS value, count(*) AS n FROM customer GROUP BY 1",
       "SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), (SELECT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS value, count(*) AS n FROM customer GROUP BY 1"), **SEG)
def bias_impute(t):
    f = nulled(t.customer, "c_mktsegment", "BUILDING")
    return change(t.session.spark, histogram(f, "c_mktsegment"), histogram(Imputer("most_frequent").fit_transform(f, "c_mktsegment"), "c_mktsegment"))


@query("lineage_join", "SELECT o_orderkey, c_custkey AS left_row, o_orderkey AS right_row FROM customer JOIN orders ON c_custkey = o_custkey", rows=True)
def lineage_join(t):
    f = t.customer.select("c_custkey").merge(renamed(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "c_custkey"), "c_custkey")
    pair = f.df.select("o_orderkey", lineage_of(f).alias("lineage"))
    return pair.select("o_orderkey", F.get("lineage", F.lit(0))["row"].alias("left_row"), F.get("lineage", F.lit(1))["row"].alias("right_row"))


# Pipelines.

def healthcare(t) -> tuple[TracedFrame, TracedFrame]:
    """Customers with their orders, those of two priorities, labelled by whether a price is well above its segment's mean."""
    orders = renamed(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "o_custkey", "c_custkey")
    data = t.customer.merge(orders.with_column("o_totalprice", Expr("CAST({} AS DOUBLE)", col("o_totalprice"))), "c_custkey")
    means = data.group_by("c_mktsegment").agg(mean_price=("o_totalprice", "mean"))
    data = data.merge(means, "c_mktsegment")
    data = data.with_column("label", data["o_totalprice"] > 1.2 * data["mean_price"])
    kept = ["o_orderkey", "c_nationkey", "c_acctbal", "c_mktsegment", "o_totalprice", "o_orderpriority", "label"]
    return data, data.where_select(data["o_orderpriority"].isin(["1-URGENT", "2-HIGH"]), *kept)


HEALTH = """FROM customer JOIN orders ON c_custkey = o_custkey JOIN (SELECT c_mktsegment AS s, avg(CAST(o_totalprice AS DOUBLE)) AS m FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) ON s = c_mktsegment
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"""
query("healthcare_like", f"SELECT o_orderkey, c_nationkey, c_acctbal, c_mktsegment, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority, CAST(o_totalprice AS DOUBLE) > 1.2 * m AS label {HEALTH}")(lambda t: healthcare(t)[1])


def healthcare_features(t, cast: bool = True) -> tuple[ColumnTransformer, TracedFrame]:
    f = healthcare(t)[1]
    f = f.with_column("label", Expr("CAST({} AS INT)", col("label"))).with_column("c_acctbal", Expr("CAST({} AS DOUBLE)", col("c_acctbal")))
    return ColumnTransformer([("hot", [Imputer("most_frequent"), OneHot()], ["c_mktsegment", "o_orderpriority"]), ("scaled", Scaler(), ["c_acctbal", "o_totalprice"])]), f


query("healthcare_features", f"""WITH o AS (SELECT o_orderkey, c_mktsegment AS s, o_orderpriority AS p, CAST(c_acctbal AS DOUBLE) AS a, CAST(o_totalprice AS DOUBLE) AS t, (CAST(o_totalprice AS DOUBLE) > 1.2 * m)::INT AS label {HEALTH}),
    v AS (SELECT 0 AS k, s AS v FROM o UNION SELECT 1, p FROM o), c AS (SELECT k, v, row_number() OVER (ORDER BY k, v) - 1 AS position FROM v), n AS (SELECT count(*) AS n FROM v), z AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(t) AS mt, stddev_pop(t) AS st FROM o)
    SELECT o_orderkey, label, position, (CASE k WHEN 0 THEN s ELSE p END = v)::INT::DOUBLE AS value FROM o, c
    UNION ALL SELECT o_orderkey, label, n, round((a - ma) / sa, 6) FROM o, n, z UNION ALL SELECT o_orderkey, label, n + 1, round((t - mt) / st, 6) FROM o, n, z""")(
    lambda t: places((lambda c, f: c.fit_transform(f))(*healthcare_features(t)), "o_orderkey", "features", "label").withColumn("value", F.round("value", 6)))


@query("compas_like", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'N' ELSE l_returnflag END AS l_returnflag, CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS l_linestatus,
    least(3, greatest(0, floor((CAST(l_quantity AS DOUBLE) - m) / ((x - m) / 4))))::DOUBLE AS q
    FROM lineitem, (SELECT CAST(min(l_quantity) AS DOUBLE) AS m, CAST(max(l_quantity) AS DOUBLE) AS x FROM lineitem WHERE l_quantity <= 30 AND l_quantity >= 5 AND l_returnflag <> 'A' AND l_tax <> 0.01)
    WHERE l_quantity <= 30 AND l_quantity >= 5 AND l_returnflag <> 'A' AND l_tax <> 0.01""")
def compas_like(t):
    f = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_tax", "l_linestatus")
    for condition in (f["l_quantity"] <= 30, f["l_quantity"] >= 5, f["l_returnflag"] != "A", f["l_tax"] != Expr("0.01")):
        f = f.where(condition)
    f = label_binarize(f.replace("R", "N", ["l_returnflag"]), "l_linestatus", ["O", "F"]).with_column("q", Expr("CAST({} AS DOUBLE)", col("l_quantity")))
    return KBins(4).fit_transform(f, "q").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "q")


@query("adult_like", """WITH d AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY'), c AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS position FROM (SELECT DISTINCT c_mktsegment FROM d)), n AS (SELECT count(*) AS n FROM c)
    SELECT c_custkey, position, (c_mktsegment = v)::INT::DOUBLE AS value FROM d, c
    UNION ALL SELECT c_custkey, n, round((CAST(c_acctbal AS DOUBLE) - m) / s, 6) FROM d, n, (SELECT avg(CAST(c_acctbal AS DOUBLE)) AS m, stddev_pop(CAST(c_acctbal AS DOUBLE)) AS s FROM d)""")
def adult_like(t):
    f = nulled(t.customer, "c_mktsegment", "MACHINERY").dropna().with_column("c_acctbal", Expr("CAST({} AS DOUBLE)", col("c_acctbal")))
    return places(ColumnTransformer([("hot", OneHot(), ["c_mktsegment"]), ("scaled", Scaler(), ["c_acctbal"])]).fit_transform(f), "c_custkey", "features").withColumn("value", F.round("value", 6))


def model_query(name: str, model) -> None:
    def run(t):
        transformer, f = healthcare_features(t)
        train, test = train_test_split(f, key=["o_orderkey"], freeze=True)
        fitted = transformer.fit(train)
        made = model()
        made.fit(fitted.transform(train), "label")
        return made.predict(fitted.transform(test)).select("o_orderkey", "label", "prediction")

    query(name)(run)


model_query("model_tree", DecisionTree)
model_query("model_logreg", LogisticRegression)
model_query("model_mlp", lambda: NeuralNetwork((9, 9), max_iter=30))


@query("word2vec")
def word2vec(t):
    f = t.customer.select("c_custkey", "c_mktsegment")
    return WordVectors(8, 1).fit(f, "c_mktsegment").transform(f)


def inspected(run, *checks, inspections=()):
    """A query that runs a pipeline under the inspector and returns what ``rows`` makes of the result."""
    return lambda spark, sf_dir, rows: rows(PipelineInspector.on_pipeline(lambda session: run(session, sf_dir)).add_checks(checks).add_required_inspections(inspections).execute(spark))


def _bound(session: Session, sf_dir: str) -> Tables:
    t = Tables.__new__(Tables)
    t.session, t._dir = session, sf_dir
    return t


def _fit_healthcare(session, sf_dir):
    transformer, f = healthcare_features(_bound(session, sf_dir))
    DecisionTree().fit(transformer.fit_transform(f), "label")


def add_inspected(name, run, rows, *checks, inspections=(), sql=None):
    def q(spark, sf_dir):
        return inspected(run, *checks, inspections=inspections)(spark, sf_dir, lambda r: rows(spark, r))

    QUERIES[name] = q
    if sql:
        ORACLE_SQL[name] = sql


#: Histograms of customers (c), of their orders (j), of one row a segment (u) and of the orders of two priorities (f), and the nodes that they are found at.
COUNTS = """WITH o AS (SELECT c_mktsegment AS v, o_orderpriority AS p FROM customer JOIN orders ON c_custkey = o_custkey), c AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1),
    j AS (SELECT v, count(*) AS n FROM o GROUP BY 1), u AS (SELECT v, 1 AS n FROM j), f AS (SELECT v, count(*) AS n FROM o WHERE p IN ('1-URGENT', '2-HIGH') GROUP BY 1)"""
HISTOGRAMS = f"""{COUNTS} SELECT 4 AS node, v AS value, n FROM c UNION ALL SELECT node, v, n FROM j, (VALUES (6), (8), (9)) t(node) UNION ALL SELECT 7, v, n FROM u
    UNION ALL SELECT node, v, n FROM f, range(10, 22) t(node)"""
CHANGES = f"""{COUNTS}, b AS (SELECT 0 AS k, v, c.n AS b, j.n AS a FROM c LEFT JOIN j USING (v) UNION ALL SELECT 1, v, u.n, j.n FROM u JOIN j USING (v) UNION ALL SELECT 2, v, j.n, f.n FROM j LEFT JOIN f USING (v) UNION ALL SELECT 3, v, n, n FROM f),
    s AS (SELECT k, b / sum(b) OVER (PARTITION BY k) AS rb, coalesce(a, 0) / sum(a) OVER (PARTITION BY k) AS ra FROM b), l AS (SELECT k, min((ra - rb) / rb) AS least FROM s GROUP BY k)
    SELECT operator, description, 'c_mktsegment' AS "column", least >= -0.3 AS acceptable, round(least, 9) AS least FROM l JOIN (VALUES (0, 'join', 'on [''c_custkey''] (inner)'), (1, 'join', 'on [''c_mktsegment''] (inner)'),
    (2, 'filter', 'rows where (`o_orderpriority` IN (''1-URGENT'', ''2-HIGH''))'), (3, 'encode', 'Imputer of c_mktsegment, o_orderpriority')) d(k, operator, description) USING (k)"""
EDGES = """SELECT * FROM (VALUES (0, 1, 'project'), (1, 2, 'derive'), (2, 3, 'project'), (3, 5, 'derive'), (4, 6, 'join'), (5, 6, 'join'), (6, 7, 'aggregate'), (6, 8, 'join'), (7, 8, 'join'), (8, 9, 'derive'), (9, 10, 'filter'),
    (10, 11, 'project'), (11, 12, 'derive'), (12, 13, 'derive'), (13, 14, 'project'), (14, 15, 'encode'), (15, 16, 'encode'), (13, 17, 'project'), (17, 18, 'encode'), (16, 19, 'assemble'), (18, 19, 'assemble'), (19, 20, 'examples'),
    (19, 21, 'targets'), (20, 22, 'fit'), (21, 22, 'fit')) e(parent, child, operator)"""
#: The first three orders, orders of customers, and orders of two priorities, in the order of the tables' rows, and the nodes that they are found at.
FIRST = """WITH a AS (SELECT o_orderkey AS o, NULL AS c, count(*) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - 1 AS i FROM orders), j AS (SELECT o_orderkey AS o, c_custkey AS c, o_orderpriority AS p FROM customer JOIN orders ON c_custkey = o_custkey),
    b AS (SELECT o, c, count(*) OVER (ORDER BY c, o ROWS UNBOUNDED PRECEDING) - 1 AS i FROM j), d AS (SELECT o, c, count(*) OVER (ORDER BY c, o ROWS UNBOUNDED PRECEDING) - 1 AS i FROM j WHERE p IN ('1-URGENT', '2-HIGH')),
    r AS (SELECT node, i, o, c FROM a, (VALUES (0), (1), (2), (3), (5)) t(node) UNION ALL SELECT node, i, o, c FROM b, (VALUES (6), (8), (9)) t(node) UNION ALL SELECT node, i, o, c FROM d, (VALUES (10), (11)) t(node))"""

add_inspected("check_table", _fit_healthcare, lambda spark, r: PipelineInspector.check_results_as_data_frame(spark, r.check_to_check_results),
              NoBiasIntroducedFor(["c_mktsegment"]), NoIllegalFeatures(["c_acctbal"]), NoMissingEmbeddings(),
              sql=f"""SELECT 'NoBiasIntroducedFor' AS "check", CASE WHEN bool_and(acceptable) THEN 'Success' ELSE 'Failure' END AS status, CASE WHEN bool_and(acceptable) THEN '' END AS description FROM ({CHANGES})
              UNION ALL VALUES ('NoIllegalFeatures', 'Failure', 'trained on c_acctbal'), ('NoMissingEmbeddings', 'Success', '')""")
add_inspected("illegal_features", _fit_healthcare, lambda spark, r: spark.createDataFrame([(x,) for c in r.check_to_check_results.values() for x in c.details["illegal"]], "feature string"), NoIllegalFeatures(["c_acctbal"]),
              sql="SELECT 'c_acctbal' AS feature")
add_inspected("dag_edges", _fit_healthcare, lambda spark, r: spark.createDataFrame([(a.node_id, b.node_id, b.op.value) for a, b in r.dag.edges], "parent int, child int, operator string"), sql=EDGES)
add_inspected("bias_overview", _fit_healthcare, lambda spark, r: NoBiasIntroducedFor.overview(spark, next(iter(r.check_to_check_results.values()))).withColumn("least", F.round("least", 9)), NoBiasIntroducedFor(["c_mktsegment"]), sql=CHANGES)
add_inspected("histograms_everywhere", _fit_healthcare, lambda spark, r: spark.createDataFrame(
    [(n.node_id, v, c) for n, x in r.dag_node_to_inspection_results.items() for v, c in x[HistogramForColumns(["c_mktsegment"])]["c_mktsegment"].items()], "node long, value string, n long"), inspections=[HistogramForColumns(["c_mktsegment"])], sql=HISTOGRAMS)


def _healthcare(session, sf_dir):
    return {"x": healthcare(_bound(session, sf_dir))[1]}


add_inspected("first_rows", _healthcare, lambda spark, r: spark.createDataFrame(
    [(n.node_id, i, row["o_orderkey"]) for n, x in r.dag_node_to_inspection_results.items() if "o_orderkey" in n.columns for i, row in enumerate(x[FirstRows(3)])], "node long, i long, o_orderkey long"),
    inspections=[FirstRows(3)], sql=f"{FIRST} SELECT node, i, o AS o_orderkey FROM r WHERE i < 3")
# Rows of aggregates are numbered by a hash that SQL does not have; the rows of the two tables are compared.
add_inspected("row_lineage", _healthcare, lambda spark, r: spark.createDataFrame(
    [(n.node_id, i, x["op"], x["row"]) for n, y in r.dag_node_to_inspection_results.items() for i, row in enumerate(y[RowLineage(3)] or []) for x in row["lineage"] if x["op"] in (0, 4)], "node long, i long, source long, row long"),
    inspections=[RowLineage(3)], sql=f"""{FIRST}, s AS (SELECT node, i, 0 AS source, o AS row FROM r UNION ALL SELECT node, i, 4, c FROM r WHERE c IS NOT NULL UNION ALL SELECT 4, c_custkey, 4, c_custkey FROM customer)
    SELECT node, i, source, row FROM s WHERE i < 3""")
QUERIES["sql_text"] = lambda spark, sf_dir: spark.sql(PipelineInspector.on_pipeline(lambda s: {"x": healthcare(_bound(s, sf_dir))[1]}).translate(spark)[0])
ORACLE_SQL["sql_text"] = ORACLE_SQL["healthcare_like"]

__all__ = ["ORACLE_SQL", "QUERIES", "distribution_change"]
