"""What the operators of this folder share: reading tables, cutting lineage, lookups that bear hot keys, and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key that more than this part of all rows share is looked up in a broadcast table, which thus has at most its inverse in rows.
HOT_SHARE = 1 / 1000
#: Characters that a Python worker works on at a time, about; a longer text comes alone.
TEXT_CHARS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, through Spark's own reader (any store that Spark can reach)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on one machine, as in tests, a
    temporary folder is made and set; on a cluster without it this is an error.
    """
    context = spark.sparkContext
    jsc = context._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local") or context.master.startswith("local-cluster") and not named:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that losing an executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate files, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def looked_up(rows: DataFrame, found: DataFrame, key: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found`` (one row a key: ``key``, records, ...) on ``key``, without a task for a frequent key.

    ``records`` is how many of the ``total`` rows have the key. Keys with more than ``HOT_SHARE`` of them are broadcast; the
    others are shuffled. Rows that were found in the broadcast table go along under places of their own, so that they spread out and match
    nothing. ``how`` is inner or left. The columns of ``found`` other than ``records`` are added.
    """
    most = max(1, int(total * HOT_SHARE))
    new = [c for c in found.columns if c not in (*key, "records")]
    side = lambda part, mark: part.select(*key, F.struct(F.lit(True).alias("_there"), *new).alias(mark))
    hot, cool = side(found.where(F.col("records") > most), "_hot"), side(found.where(F.col("records") <= most), "_cool")
    # Not 0 where a row was found in the broadcast table, so it matches nothing more.
    place = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.xxhash64(*rows.columns).bitwiseOR(F.lit(1)))
    seen = rows.join(F.broadcast(hot), key, "left").withColumn("_place", place)
    joined = seen.join(cool.withColumn("_place", F.lit(0).cast("long")), ["_place", *key], "left")
    if how == "inner":
        joined = joined.where(F.col("_hot").isNotNull() | F.col("_cool").isNotNull())
    return joined.select(*rows.columns, *[F.coalesce(F.col("_hot").getField(c), F.col("_cool").getField(c)).alias(c) for c in new])


def groups(rows: Iterable, chars: int = TEXT_CHARS, length=lambda text: len(text or "")) -> Iterator[list]:
    """``rows`` in turn, in lists of about ``chars`` characters (what ``length`` says of each), so that long texts come alone."""
    held, size = [], 0
    for row in rows:
        n = length(row)
        if held and size + n > chars:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as remainder 0 of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus
