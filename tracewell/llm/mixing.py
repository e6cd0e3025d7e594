"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled but fixed order (a hash of id and text), up to ``EPOCHS`` times
over. A document's virtual finish time is the number of its source's words up to and including it, divided by the
source's target. Served in that order, the queues advance in proportion to their targets; the stream is cut where the total
budget (all words) is used up, and what is served of each queue is a prefix of it. Documents stay whole, so each source
has one document across the line, the first that the cut leaves out. It is treated by itself: it is served if that brings the source
nearer to its target, so that a source with few long documents does not stay short by most of one.

Running sums never go through one task: each source is dealt into buckets by the shuffling hash, sums of whole buckets
are added up over a table with one row per bucket, and only within a bucket are rows added up one by one. The cut is
found the same way over ranges of finish time; the range that holds it is divided again until it has at most
``EDGE_ROWS`` rows, and only those are sorted. One number per source describes the whole mix. (Rows that repeat id and text are
interchangeable; they have one hash and so one bucket.)
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut, n_words

EPOCHS, WEIGHTS, SEED = 3, (1, 2, 3), 20
#: Rows in a bucket of a source, about, and buckets of a source at most; ranges that finish times are counted in, and rows that are sorted at once.
BUCKET_ROWS, BUCKETS, RANGES, EDGE_ROWS = 500, 1 << 20, 4096, 10_000
#: Order of a source's queue. Rows equal in all of these are repeated rows and interchangeable.
QUEUE = ("h", "t", "doc_id", "size")


def _keyed(docs: DataFrame, buckets: int) -> DataFrame:
    """``docs`` with size, source key (null last, otherwise by code point), the queue's order and the bucket."""
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    return docs.withColumns({"size": n_words(F.col("text")), "key": key, "h": F.xxhash64("doc_id", "text", F.lit(SEED)), "t": F.xxhash64("text", "doc_id")}).withColumn(
        "bucket", F.shiftrightunsigned("h", 64 - buckets.bit_length() + 1) if buckets > 1 else F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target) of every source from (key, source_size): shares by weight of all words, at most
    ``EPOCHS`` times a source's own size, what is above being reshared by weight.

    With sources in order of size / weight, those that reach their limit come first, and the level that the
    others rise to is the largest of (words not yet given out) / (weights not yet served) along that order.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(Window.orderBy("key")) - 1) % len(WEIGHTS) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("level", level).select(
        "key", "source_size", F.least(F.col("source_size") * F.lit(float(EPOCHS)), F.col("weight") * F.max("level").over(everything)).alias("target"))


def _ranked(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    """``upto``: words of the source up to and including the row, once through."""
    within = Window.partitionBy("key", "bucket").orderBy(*QUEUE).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(buckets, ["key", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(within))


def _line(entries: DataFrame, budget: int) -> float:
    """The largest finish time up to which ``entries`` (size, finish) stay within the budget; entries that finish at one time stay together."""
    sized = entries.where("size > 0").select("size", "finish")
    low, high, before, rows = 0.0, sized.agg(F.max("finish")).first()[0] or 0.0, 0, None
    inside = (F.col("finish") > F.lit(low)) & (F.col("finish") <= F.lit(high))
    while rows is None or rows > EDGE_ROWS:
        # Ranges begin after their lower end; the last one ends at the upper end exactly.
        width = (high - low) / RANGES
        if low + width <= low:
            break
        at = F.least(F.greatest(F.ceil((F.col("finish") - F.lit(low)) / F.lit(width)).cast("long") - 1, F.lit(0)), F.lit(RANGES - 1))
        counted = sorted(tuple(r) for r in sized.where(inside).groupBy(at.alias("range")).agg(F.sum("size"), F.count("*"), F.min("finish"), F.max("finish")).collect())
        for _, words, n, least, most in counted:
            if before + words > budget:
                break
            before += words
        else:  # all that there is lies within the budget
            return high
        if rows == n and (least, most) == (low, high):
            break
        low, high, rows = float(np.nextafter(least, -np.inf)), most, n
        inside = (F.col("finish") > F.lit(low)) & (F.col("finish") <= F.lit(high))
    line = Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = sized.where(inside).groupBy("finish").agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(line) + before)
    return edge.where(F.col("upto") <= budget).agg(F.max("finish")).first()[0] or low


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The keyed slim rows, the buckets with each source's size, target and number of words served, and how many buckets a source has."""
    rows = cut(_keyed(docs.select("doc_id", "source", "text"), 1).select("doc_id", "key", "h", "t", "size"))
    n = min(BUCKETS, 1 << ceil(log2(max(1, rows.count() / BUCKET_ROWS))))
    slim = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - n.bit_length() + 1) if n > 1 else F.lit(0).cast("long"))
    sums = slim.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    goals = targets(sums.groupBy("key").agg(F.sum("words").alias("source_size")))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = cut(sums.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(goals, "key"))

    budget = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    at = F.col("epoch") * F.col("source_size") + F.col("upto")
    entries = cut(_ranked(slim, buckets).where("target > 0").select("key", "size", "source_size", "target", "upto", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch"))
                  .select("key", "size", "target", at.alias("position"), (at / F.col("target")).alias("finish")))
    served = F.col("finish") <= F.lit(_line(entries, budget))
    ends = entries.groupBy("key").agg(F.first("target").alias("goal"), F.coalesce(F.max(F.when(served, F.col("position"))), F.lit(0)).alias("served"), F.min(F.when(~served, F.col("position"))).alias("next"))
    nearer = F.abs(F.col("next") - F.col("goal")) < F.abs(F.col("served") - F.col("goal"))
    ends = ends.select("key", F.when(nearer, F.col("next")).otherwise(F.col("served")).alias("served"))
    return slim, cut(buckets.join(ends, "key", "left").select("key", "bucket", "before", "source_size", "target", F.coalesce("served", F.lit(0)).alias("served"))), n


def _copies():
    """How often the mix takes a row."""
    once = [F.when((F.col("target") > 0) & (e * F.col("source_size") + F.col("upto") <= F.col("served")), 1).otherwise(0) for e in range(EPOCHS)]
    return sum(once[1:], once[0])


def mix_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``.

    Null texts have size 0 and null sources form one source, the last. Documents are taken whole, so a source's taken
    words differ from its target by about half a document. Repeated rows are queued one by one. If there are no words at
    all, targets and taken words are 0; an empty table gives no rows.
    """
    slim, buckets, _ = plan(docs)
    return _ranked(slim, buckets).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents with all columns of ``docs``: each as often as it is taken, whole, in order of finish time.

    Documents without words cost nothing and are served where they stand in their queue.
    """
    _, buckets, n = plan(docs)
    row = docs.select("doc_id", "source", "text", F.struct("*").alias("row"))
    ranked = _ranked(_keyed(row, n).select("row", "key", "bucket", *QUEUE), buckets).withColumn("copies", _copies()).where("copies > 0")
    epochs = ranked.select("row", "target", "source_size", "upto", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
    finish = (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target")
    return epochs.withColumn("finish", finish).repartitionByRange("finish").sortWithinPartitions("finish").select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken."""
    return mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
