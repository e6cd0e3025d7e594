"""Splitting a frame into training and test rows."""

from __future__ import annotations

from math import ceil

from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions.expressions import literal
from tracewell.operators.frame import TracedFrame, quoted
from tracewell.plans.nodes import Op
from tracewell.plans.session import HIDDEN

RANGES = 4096


def hash_sql(names: list[str], seed: int) -> str:
    """60 bits of the MD5 of the columns' text and the seed, as SQL that any engine can follow."""
    text = ", ".join([*(f"CAST({quoted(n)} AS STRING)" for n in names), literal(str(seed))])
    return f"CAST(conv(substring(md5(concat_ws('|', {text})), 1, 15), 16, 10) AS BIGINT)"


def train_test_split(frame: TracedFrame, test_size: float = 0.25, seed: int = 0, key: list[str] | None = None, freeze: bool = False) -> tuple[TracedFrame, TracedFrame]:
    """(training rows, test rows): the test part is the ``ceil(test_size * n)`` rows whose hash of ``key`` (all visible columns unless given)
    and seed is smallest, rows of one hash in the order of the key. The SQL of both parts chooses the same rows.

    The hash decides, so both parts can be computed again and never overlap. The exact size does not take a global sort: rows
    are counted in ranges of the hash, and only the range in which the cut falls is ranked. With ``freeze`` the rows are
    persisted (in memory, else on disk) before they are counted, so that what comes before the split is computed once.
    """
    names = key or frame.columns
    h, at = f"{HIDDEN}h", f"{HIDDEN}range"
    rows = frame.df.withColumn(h, F.expr(hash_sql(names, seed))).withColumn(at, F.shiftright(F.col(h), 48))
    if freeze:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(at).count().collect())
    left = ceil(test_size * sum(n for _, n in counts))
    cut, within = RANGES, 0
    for place, n in counts:
        if left <= n:
            cut, within = place, left
            break
        left -= n
    rank = F.row_number().over(Window.partitionBy(at).orderBy(h, *map(quoted, names)))
    edge = rows.where(F.col(at) == cut).withColumn(f"{HIDDEN}rank", rank)
    extra = [h, at, f"{HIDDEN}rank"]
    test = rows.where(F.col(at) < cut).drop(*extra).unionByName(edge.where(F.col(f"{HIDDEN}rank") <= within).drop(*extra))
    train = rows.where(F.col(at) > cut).drop(*extra).unionByName(edge.where(F.col(f"{HIDDEN}rank") > within).drop(*extra))
    ranked = f"SELECT *, row_number() OVER (ORDER BY {', '.join([hash_sql(names, seed), *map(quoted, names)])}) AS {h}, count(*) OVER () AS {HIDDEN}n FROM {frame._name()}"
    out = []
    for df, part, test_of in ((train, "training rows", ">"), (test, "test rows", "<=")):
        node = frame.session.record(Op.SPLIT, "train_test_split", part, frame.columns, (frame.node,))
        sql = f"SELECT {', '.join(map(quoted, frame.columns))} FROM ({ranked}) WHERE {h} {test_of} ceil({test_size} * {HIDDEN}n)"
        out.append(TracedFrame(frame.session, df, node, frame.columns, frame.order, sql))
    return out[0], out[1]
