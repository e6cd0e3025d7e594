"""Sources: CSV and Parquet files, literal data, and DataFrames made elsewhere.

Rows are numbered only if the session's inspections need it: Parquet rows by file and place (metadata, no shuffle), CSV rows by
file, block and place (one pass that counts blocks), literal rows as they are given, and others by one pass that counts
partitions. No row goes through Python or to the driver.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.expressions import literal
from tracewell.operators.frame import TracedFrame, quoted
from tracewell.plans.nodes import Op
from tracewell.plans.session import HIDDEN, Session, row_column, sensitive_column

#: Room for the rows of one file in a row number.
FILE_ROWS = 1 << 40


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its rows counted up from 0 in the order of its partitions, without a row leaving the JVM: one pass counts partitions, and
    each row's place in its own is added to the rows before it. ``df`` has to be dealt out alike each time, as persisted frames are."""
    return _counted_up(df, name, {"part": F.spark_partition_id()})


def _by_block(df: DataFrame, name: str) -> DataFrame:
    """Rows of text files numbered in the order of files, blocks within them and places within those, however blocks are dealt out to tasks."""
    return _counted_up(df, name, {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start")})


def _counted_up(df: DataFrame, name: str, parts: dict[str, Column]) -> DataFrame:
    """Numbers rows by the parts they belong to, in the order of these; the rows of a part lie together in one partition."""
    at = {f"{HIDDEN}{k}": v for k, v in parts.items()}
    placed = df.select("*", *[v.alias(k) for k, v in at.items()]).withColumn(name, F.monotonically_increasing_id())
    before, starts = 0, []
    for r in sorted(placed.groupBy(*at).agg(F.min(name), F.count("*")).collect()):
        starts.append((*r[: len(at)], before - r[-2]))
        before += r[-1]
    types = [placed.schema[k] for k in at]
    table = df.sparkSession.createDataFrame(starts, T.StructType([*types, T.StructField(f"{HIDDEN}start", T.LongType())]))
    return placed.join(F.broadcast(table), list(at)).withColumn(name, F.col(name) + F.col(f"{HIDDEN}start")).select(*df.columns, name)


def _held(df: DataFrame, name: str) -> DataFrame:
    """A frame of any origin is persisted before it is numbered, since its partitions may be others when it is computed again."""
    return numbered(df.persist(StorageLevel.MEMORY_AND_DISK), name)


def _by_place(df: DataFrame, name: str) -> DataFrame:
    """Parquet rows numbered by the rank of their file and their place in it."""
    files = sorted(df.inputFiles())
    place = df.select("*", F.col("_metadata.row_index").alias(name), F.col("_metadata.file_path").alias("__tw_file"))
    if len(files) <= 1:
        return place.drop("__tw_file")
    ranks = df.sparkSession.createDataFrame([(f, i * FILE_ROWS) for i, f in enumerate(files)], "f string, base long")
    clean = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return place.join(ranks, clean(F.col("__tw_file")) == clean(F.col("f"))).withColumn(name, F.col(name) + F.col("base")).drop("__tw_file", "f", "base")


def _source(session: Session, df: DataFrame, function: str, description: str, sql: str, number, operator=Op.SCAN, index: str | None = None) -> TracedFrame:
    visible = [c for c in df.columns if c != index]
    node = session.record(operator, function, description, visible)
    order = []
    if session.rows or index:
        name = row_column(node.node_id)
        df = df.withColumn(name, F.col(quoted(index)).cast("long")).drop(index) if index else number(df, name)
        order = [(name, True)]
    df = df.withColumns({sensitive_column(c): F.col(quoted(c)) for c in session.sensitive if c in visible} | {f"{HIDDEN}note_{k}": v for k, v in session.notes.items()})
    return TracedFrame(session, df, node, visible, order, sql)


def read_csv(path: str, spark: SparkSession | None = None, schema=None, header: bool = True, sep: str = ",", na_values: str = "?", index_col: str | int | None = None, sampling: float = 1.0) -> TracedFrame:
    """A CSV file or folder. ``na_values`` is the one symbol read as null (empty fields are null too); types are inferred from a
    ``sampling`` share of the rows unless a schema is given. ``index_col`` names (or counts) a column that numbers the rows and is not one of
    the data."""
    session = Session.current(spark)
    reader = session.spark.read.options(header=header, sep=sep, nullValue=na_values)
    df = reader.schema(schema).csv(path) if schema is not None else reader.options(inferSchema=True, samplingRatio=sampling).csv(path)
    if na_values != "":
        df = df.withColumns({c: F.when(F.col(quoted(c)) != "", F.col(quoted(c))) for c, t in df.dtypes if t == "string"})
    index = df.columns[index_col] if isinstance(index_col, int) else index_col
    options = {"header": header, "sep": sep, "nullValue": na_values, "inferSchema": schema is None}
    typed = {c: f"CAST({quoted(c)} AS {t})" if schema is not None else quoted(c) for c, t in df.dtypes}
    items = [f"CASE WHEN {typed[c]} <> '' THEN {typed[c]} END AS {quoted(c)}" if na_values != "" and t == "string" else f"{typed[c]} AS {quoted(c)}" for c, t in df.dtypes if c != index]
    sql = f"SELECT {', '.join(items)} FROM csv.`{path}` WITH ({', '.join(f'{k} = {literal(str(v).lower() if isinstance(v, bool) else v)}' for k, v in options.items())})"
    return _source(session, df, "read_csv", os.path.basename(path.rstrip("/")), sql, _by_block, index=index)


def read_parquet(path: str, spark: SparkSession | None = None) -> TracedFrame:
    """A Parquet file or folder; filters and column choices made later reach the scan."""
    session = Session.current(spark)
    return _source(session, session.spark.read.parquet(path), "read_parquet", os.path.basename(path.rstrip("/")), f"SELECT * FROM parquet.`{path}`", _by_place)


def data_frame(rows: list | dict, columns: list[str] | str | None = None, spark: SparkSession | None = None) -> TracedFrame:
    """Literal rows (tuples, with names or a schema string) or columns (a dict of lists)."""
    session = Session.current(spark)
    if isinstance(rows, dict):
        columns, rows = list(rows) if columns is None else columns, list(zip(*rows.values(), strict=True))
    rows = [tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows]

    def number(df: DataFrame, name: str) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
        return session.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)

    df = session.spark.createDataFrame(rows, columns)
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return _source(session, df, "data_frame", "literal rows", f"SELECT * FROM VALUES {values} AS t({', '.join(map(quoted, df.columns))})", number)


def series(values: list, name: str = "_1", spark: SparkSession | None = None) -> TracedFrame:
    """One literal column."""
    return data_frame([(v,) for v in values], [name], spark)


def untracked(df: DataFrame, spark: SparkSession | None = None) -> TracedFrame:
    """A DataFrame that was made without being recorded enters as a source of its own."""
    session = Session.current(spark or df.sparkSession)
    view = f"untracked_{len(session.dag)}"
    df.createOrReplaceTempView(view)
    return _source(session, df, "untracked", "made by operators that were not recorded", f"SELECT * FROM {view}", _held, Op.FOREIGN)
