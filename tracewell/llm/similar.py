"""Pairs of sets that are similar enough to be compared: bands of min-hashes, and the comparison itself.

``BANDS`` bands of ``ROWS`` least values are taken over a whole set. Two sets of similarity 0.8 share no band with probability 7 in
100,000. Sets that share a band are compared or known to be in one component, whatever their number. Where at most ``HOT_BAND``
share it, all pairs are made. Where more do, its members are first compared with the one that shares most bands with
others (of a text and its edits, the text), and again within each value of the next band. What that links is one component. If
a band has members of several components then, those are dealt into cells of about ``CELL`` sets, and any two cells that are not of the
same component are compared whole, as one product of matrices in a task, which returns one link for each two components it
finds linked. So a group of sets that are all alike takes linear time; only the ones that the first comparisons do not reach are
compared with the whole band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import cut, looked_up

SIMILARITY, BANDS, ROWS, HOT_BAND, SEED = 0.8, 24, 5, 8, 42
#: Sets in a cell, and members of sets in a cell, about; sets are dealt by a hash. Different members that are columns of a product at a time.
CELL, CELL_GRAMS, COLUMNS = 256, 1 << 20, 1 << 12
#: Members of a set whose min-hashes are computed at a time.
PIECE = 1 << 12
_RANDOM = np.random.default_rng(SEED).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
TIMES, PLUS, MIX = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1], (_RANDOM[2] * np.uint64(2) + np.uint64(1)).reshape(BANDS, ROWS)


def bands(found: np.ndarray) -> np.ndarray:
    """A number for each band of a set's min-hashes; none for an empty set. Numbers of different bands do not meet."""
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), PIECE):
        least = np.minimum(least, (found[at : at + PIECE].astype(np.uint64) * TIMES[:, None] + PLUS[:, None]).min(axis=1))
    return ((least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _within(met: DataFrame, key: list[str], hot_band: int) -> DataFrame:
    """(a, n, b, m): pairs of ``met`` (node, size, key ..., members) that share a key with at most ``hot_band`` members."""
    cool = met.where(F.col("members") <= hot_band)
    left, right = cool.select(*key, F.col("node").alias("a"), F.col("size").alias("n")), cool.select(*key, F.col("node").alias("b"), F.col("size").alias("m"))
    return left.join(right, key).where("a > b").select("a", "n", "b", "m")


def _stars(hot: DataFrame, key: list[str], total: int) -> DataFrame:
    """(a, n, b, m): every member of a key of ``hot`` (node, size, popular, key ...) with the key's most popular one."""
    first = hot.groupBy(*key).agg(F.max(F.struct("popular", "node", "size")).alias("first"), F.count("*").alias("records"))
    return looked_up(hot, first, key, total).select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("first.node").alias("b"), F.col("first.size").alias("m")).where("a <> b")


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(node, size, k, v, members): the bands of ``nodes`` (node, size, bands) that several share, and how many."""
    filed = nodes.select("node", "size", F.posexplode("bands").alias("k", "v")).select("node", "size", F.col("k").cast("byte").alias("k"), "v")
    shared = filed.groupBy("v").agg(F.count("*").alias("records")).where("records > 1").withColumn("members", F.col("records"))
    return cut(looked_up(filed, shared, ["v"], nodes.count() * BANDS))


def candidates(nodes: DataFrame, met: DataFrame, total: int, similarity: float = SIMILARITY, hot_band: int | None = None) -> DataFrame:
    """(a, b): pairs of ``nodes`` that share a band (``met``), some of them twice: all pairs of bands with few members, some of the others.

    Sets too different in size are left out.
    """
    hot_band = hot_band or HOT_BAND
    popular = met.groupBy("node").agg(F.sum("members").alias("popular"))
    hot = met.where(F.col("members") > hot_band).drop("members").join(popular, "node").join(nodes.select("node", "bands"), "node")
    hot = cut(hot.select("node", "size", "popular", "v", F.get("bands", (F.col("k") + 1) % BANDS).alias("w")))
    again = hot.groupBy("v", "w").agg(F.count("*").alias("records")).where("records > 1").withColumn("members", F.col("records"))
    again = cut(looked_up(hot, again, ["v", "w"], total))
    pairs = _within(met, ["v"], hot_band).union(_stars(hot, ["v"], total)).union(_within(again, ["v", "w"], hot_band)).union(_stars(again.where(F.col("members") > hot_band), ["v", "w"], total))
    close = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")
    return pairs.where(close).select("a", "b")


def unsettled(met: DataFrame, roots: DataFrame, total: int, hot_band: int | None = None) -> DataFrame:
    """(v, node, size, root): members of the bands of ``met`` that many share, if they are not all of one component (``roots``: node, root)."""
    hot = met.where(F.col("members") > (hot_band or HOT_BAND)).select("v", "node", "size")
    own = cut(hot.join(roots, "node", "left").select("v", "node", "size", F.coalesce("root", "node").alias("root")))
    several = own.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("records")).where("lo < hi")
    return cut(looked_up(own, several.select("v", "records"), ["v"], total))


def cells_met(members: DataFrame, total: int) -> DataFrame:
    """(v, i, j, node, root, at): each two cells of a band that have to be compared, with the members of both (``at`` is i or j).

    Sets of a component that fills more than one cell are dealt into cells of their own, which are not compared with each other.
    """
    cells = lambda n, grams: F.ceil(F.greatest(F.col(n) / CELL, F.col(grams) / CELL_GRAMS))
    part = members.groupBy("v", "root").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).withColumn("cells", cells("n", "grams"))
    part = cut(part)
    mixed = part.where("cells <= 1").groupBy("v").agg(F.sum("n").alias("x"), F.sum("grams").alias("y"), F.count("*").alias("records")).withColumn("rest", cells("x", "y"))
    few = looked_up(part.where("cells <= 1"), mixed.select("v", "rest", "records"), ["v"], total).select("v", "root", F.lit(False).alias("alone"), F.col("rest").alias("cells"), F.col("n").alias("records"))
    dealt = few.union(part.where("cells > 1").select("v", "root", F.lit(True), "cells", F.col("n")))
    cell = F.struct("alone", F.when(F.col("alone"), F.col("root")).otherwise(0).alias("part"), F.pmod(F.xxhash64("node"), F.col("cells")).alias("k"))
    own = cut(looked_up(members, dealt, ["v", "root"], total).select("v", "node", "root", cell.alias("cell")))
    there = own.select("v", "cell").distinct()
    two = there.select("v", F.col("cell").alias("i")).join(there.select("v", F.col("cell").alias("j")), "v")
    two = two.where("i <= j and not (i.alone and j.alone and i.part = j.part)")
    sides = two.select("v", F.col("i").alias("cell"), "i", "j").union(two.where("i < j").select("v", F.col("j").alias("cell"), "i", "j"))
    return own.join(sides, ["v", "cell"]).select("v", "i", "j", "node", "root", F.col("cell").alias("at"))


def found_links(root: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Places of similar sets, one on the left and one on the right, that connect all components (``root``) with such a pair."""
    n = np.array([len(s) for s in sets])
    row, (_, gram) = np.repeat(np.arange(len(n)), n), np.unique(np.concatenate(sets), return_inverse=True)
    live = np.ones(len(n), dtype=bool)
    while True:  # a set of which too little is in any other is similar to none
        use = live[row]
        several = use & (np.bincount(gram[use], minlength=gram.max() + 1) > 1)[gram]
        now = live & (np.bincount(row[several], minlength=len(n)) >= similarity * n)
        if (now == live).all():
            break
        live = now
    a, b = np.flatnonzero(live & left), np.flatnonzero(live & right)
    if not len(a) or not len(b):
        return []
    column, gram = np.unique(gram[several], return_inverse=True)
    order = np.argsort(gram, kind="stable")
    row, gram, both = row[several][order], gram[order], np.zeros((len(a), len(b)))
    for at in range(0, len(column), COLUMNS):
        lo, hi = np.searchsorted(gram, (at, at + COLUMNS))
        has = np.zeros((len(n), min(COLUMNS, len(column) - at)), dtype=np.float32)
        has[row[lo:hi], gram[lo:hi] - at] = 1
        both += has[a] @ has[b].T
    alike = (both / (n[a][:, None] + n[b] - both) >= similarity) & (root[a][:, None] != root[b])
    x, y = (p[q] for p, q in zip((a, b), np.nonzero(alike), strict=True))
    first = np.unique(np.sort(np.stack((root[x], root[y]), axis=1), axis=1), axis=0, return_index=True)[1]
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while (above := up.get(r, r)) != r:
            up[r] = up.get(above, above)
            r = above
        return r

    links = []
    for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True):
        p, q = top(int(root[i])), top(int(root[j]))
        if p != q:
            up[p] = q
            links.append((i, j))
    return links


def compared(met: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between similar sets (``sets``: node, grams) of each two cells of ``met``."""

    def run(group: pa.Table) -> pa.Table:
        node, root, left, right = (group.column(c).to_numpy() for c in ("node", "root", "left", "right"))
        links = found_links(root, left, right, [np.frombuffer(x.as_py(), dtype="<u4") for x in group.column("grams")], similarity)
        return pa.table({"a": pa.array([node[i] for i, _ in links], pa.int64()), "b": pa.array([node[j] for _, j in links], pa.int64())})

    sides = met.select("v", "i", "j", "node", "root", (F.col("at") == F.col("i")).alias("left"), (F.col("at") == F.col("j")).alias("right"))
    return sides.join(sets, "node").groupBy("v", "i", "j").applyInArrow(run, "a long, b long")
