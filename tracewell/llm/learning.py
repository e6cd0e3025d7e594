"""Bounded samples of labelled documents for fitting. Only fitting uses them; every model is applied to all documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents that a model is fitted on at most, but for FLOOR of each class, if there are so many.
SAMPLE_ROWS, FLOOR = 4000, 100
#: Characters of all sampled texts at most; texts are never cut: from the first one that would go beyond on, none is taken.
SAMPLE_CHARS = 32_000_000
#: Classes that a model may have.
MAX_CLASSES = 1000


def thinned(rows: DataFrame, of: str, n: int, seed: int) -> DataFrame:
    """At most about ``n`` of ``rows`` (doc_id, class in the column ``of``, one row a document), each class by its share of all rows, but at least
    ``FLOOR`` of it (all if it has fewer).

    The least hashes of the id are taken. How many of a class there are says below which hash they lie, give or take, so
    that only about twice as many ids are looked at on the driver; which are chosen depends on the ids alone.
    """
    classes = {r[0]: r[1] for r in rows.groupBy(of).count().limit(MAX_CLASSES + 1).collect()}
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    total = max(1, sum(classes.values()))
    want = {c: min(k, max(-(-n * k // total), FLOOR)) for c, k in classes.items()}
    if not want:
        return rows.limit(0)
    share = F.create_map(*[x for c, k in want.items() for x in (F.lit(c), F.lit(min(1.0, (2.0 * k + 50) / classes[c]) * float(1 << 63)))])
    hashed = rows.select("doc_id", of, F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1).alias("at"))
    least = {c: [] for c in want}
    for r in hashed.where(F.col("at") <= F.get(F.array(share), F.lit(0))[F.col(of)]).collect():
        least[r[of]].append((r["at"], r["doc_id"]))
    chosen = [(i, c) for c, found in least.items() for _, i in sorted(found)[: want[c]]]
    return rows.sparkSession.createDataFrame(chosen, rows.select("doc_id", of).schema)


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, ...) of the ``chosen`` documents, whole, one row an id (of several texts the one with the least hash), as many in the
    order of a hash of the id as ``SAMPLE_CHARS`` allows. ``chosen`` is bounded, so it is broadcast and documents are read once."""
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", *[c for c in chosen.columns if c != "doc_id"]).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    line = Window.orderBy(F.xxhash64("doc_id", F.lit(0)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("upto", F.sum(F.length("text")).over(line)).where(F.col("upto") <= SAMPLE_CHARS).drop("upto")


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, n: int = SAMPLE_ROWS, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Whole texts and 0/1 labels of about ``n`` labelled documents for which ``usable`` (a condition on doc_id) holds.

    Rows without id, label or text are left out; of conflicting labels the larger counts.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rows = texts_of(docs, thinned(marks, "y", n, seed)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=np.float64)


def folds(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a small logistic regression (last one: intercept) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
