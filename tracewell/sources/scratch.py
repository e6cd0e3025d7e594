"""A folder for intermediate files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new name in the session's checkpoint folder. Where that is unset and Spark runs on one machine, a temporary folder is made; on a
    cluster without it this is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (context.master.startswith("local-cluster") or not context.master.startswith("local")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
