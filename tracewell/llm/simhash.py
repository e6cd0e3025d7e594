"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, connected components.

A fingerprint of 64 bits is cut into five blocks. Two fingerprints that differ in at most two bits differ in at most
two blocks, so they agree on at least three whole blocks: each fingerprint is filed under its ten combinations of
three blocks (38 or 39 bits each), fingerprints filed together are joined, and the join is verified bit by bit.

Three measures keep this linear for skewed data. Equal fingerprints are folded into one row (with the smallest
document id) by a map-side combined aggregate before anything is joined. A block whose key is shared by more
than ``HOT_BLOCK`` different fingerprints is not joined with itself: its members are filed again under every value
that differs from them in at most one of the bits the key leaves free. Members at distance two or less meet at such a
value, and members that meet there are at distance two or less, so linking each to the smallest one there gives
the same components without any pairs. And wherever rows look up what belongs to a key that many of them have (a block, a
fingerprint, the centre of a component), the frequent keys are broadcast (``common.looked_up``).

``keep_first`` is the operator as a filter: one document of each group of texts whose sets of word shingles are as
similar as asked for. 64 bits tell that only for texts that are nearly equal (two texts of similarity 0.8 differ in ten bits
on average, for which no choice of blocks is both complete and selective), so pairs that blocks bring together are
joined by pairs that share a band of min-hashes (``similar``), and each pair is verified on the whole sets. Of a band that many
texts share, those that are not yet in one component are compared with each other too.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import similar
from tracewell.llm.common import cut, looked_up

BITS, BLOCKS, MAX_DISTANCE, SHINGLE, SEED = 64, 5, 2, 3, 42
#: Different fingerprints that may share a block key before the key is handled by one-bit neighbours instead.
HOT_BLOCK = 32
#: Shingle of the filter's fingerprints.
TEXT_SHINGLE = 5
#: Shingles whose bits are unpacked at a time.
ROWS = 1 << 15


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """A hash of a text's words, and the hash of each of its word shingles, repeats included; 0 and none without words.

    A-Z are lower-cased; fewer words than ``shingle`` form one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return digest(joined, SEED), np.fromiter((digest(view[a:b], SEED) for a, b in spans), dtype="<u8", count=n)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits of which each is set if it is in over half of ``hashes``; 0 if there are none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), ROWS):
        part = hashes[at : at + ROWS]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles (repeats included); 0 for a text without words."""
    return majority(shingle_hashes(text, shingle)[1])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long. Null and empty texts get 0."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, fp long")


def block_masks(bits: int = BITS, blocks: int = BLOCKS, max_distance: int = MAX_DISTANCE) -> list[int]:
    """Masks of the block combinations of which close fingerprints share at least one."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - max_distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(a, b), a > b: links between different fingerprints; all pairs within two bits are connected through them."""
    masks = block_masks()
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for i, m in enumerate(masks)])
    filed = fps.select("fp", F.inline(keys)).select("fp", "k", "v")
    shared = filed.groupBy("k", "v").agg(F.count("*").alias("records")).where("records > 1").withColumn("members", F.col("records"))
    met = cut(looked_up(filed, shared, ["k", "v"], fps.count() * len(masks)))
    cool, hot = met.where(F.col("members") <= hot_block), met.where(F.col("members") > hot_block)
    left, right = cool.select("k", "v", F.col("fp").alias("a")), cool.select("k", "v", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE
    pairs = left.join(right, ["k", "v"]).where((F.col("a") > F.col("b")) & close).select("a", "b")

    free = [F.array(*[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1], F.lit(0).cast("long")) for m in masks]
    flips = F.element_at(F.array(*free), F.col("k") + 1)
    near = hot.select("k", "fp", F.explode(flips).alias("flip")).select("k", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    least = near.groupBy("k", "at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = near.join(least, ["k", "at"]).where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) edges by alternating large and small stars; root is the least node.

    Each round is two aggregates and two lookups on slim rows; the edges are written to the shared folder after every
    round. The loop ends when a round leaves every edge as it was.
    """

    def star(e: DataFrame, n: int, larger: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if larger:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("records"))
        out = looked_up(both, least, ["u"], 2 * n)
        out = out.where("v > u").select("v", "m") if larger else out.select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
        return out.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    n, same = e.count(), False
    while n and not same:
        now = cut(star(star(e, n, True), n, False))
        m = now.count()
        same = m == n and now.join(e, ["a", "b"], "left_anti").isEmpty()  # edges are distinct: as many and none new are the same
        e, n = now, m
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row; component_id is the least id reachable over links.

    Texts without words (null, empty, white space) share fingerprint 0 and so one component. Rows with a null id are
    fingerprinted and take part in links, but never name a component unless nothing else is in it (then null).
    Repeated rows are returned as often as they occur. An empty table gives an empty result.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("records")))
    linked = cut(components(links(reps)))
    nodes = linked.select(F.col("node").alias("fp"), "root").union(linked.select(F.col("root").alias("fp"), "root").distinct())
    own = reps.join(nodes, "fp", "left").select("fp", "rep", "records", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    # Only folded or linked fingerprints need a lookup: the others are their own component.
    folded = own.where((F.col("records") > 1) | F.col("linked"))
    total = fps.count()
    least = folded.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("records"))
    named = cut(looked_up(folded, least, ["root"], total).select("fp", "records", "component_id", F.lit(True).alias("found")))
    out = looked_up(fps, named, ["fp"], total, "left")
    return out.select("doc_id", "fp", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def described(docs: DataFrame, shingle: int, grams: bool = False) -> DataFrame:
    """(doc_id, t, node, ...) of every row of ``docs`` (doc_id, t, text): ``node`` is the same for equal words.

    Either with fp (of the set of shingles, so that repeats do not weigh), size and bands of the set, or with the set's 32-bit ``grams``.
    """

    def run(batches):
        for b in batches:
            node, fp, size, filed, kept = [], [], [], [], []
            for text in b.column(2):
                words, hashes = shingle_hashes(text.as_py(), shingle)
                whole = np.unique(hashes)
                found = np.unique((whole >> np.uint64(32)).astype("<u4"))
                node.append(words)
                if grams:
                    kept.append(found.tobytes())
                else:
                    fp.append(majority(whole))
                    size.append(len(found))
                    filed.append(similar.bands(found))
            own = pa.array(np.array(node, dtype=np.uint64).view(np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([own, pa.array(kept, pa.binary())], names=["node", "grams"])
            else:
                made = [own, pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(filed, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["doc_id", "t", "node", "fp", "size", "bands"])

    kind = "node long, grams binary" if grams else "doc_id long, t long, node long, fp long, size int, bands array<long>"
    return docs.select("doc_id", "t", "text").mapInArrow(run, kind)


def similar_texts(texts: DataFrame, rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): links between nodes of ``rows`` (what ``described`` says of ``texts``) that connect all pairs whose sets are as similar as ``similarity``.

    Nodes meet by bands of min-hashes, which alone tell what is found, and besides by equal fingerprints and by blocks of
    fingerprints (``links``). Pairs are verified. Then the members of bands that many share are compared, unless they are in one
    component by now. Sets are made again of the texts of those nodes only, one text a node.
    """
    # The texts of a node are equal in words, so any of them will do.
    nodes = cut(rows.where("size > 0").groupBy("node").agg(F.min_by(F.struct("doc_id", "t", "fp", "size", "bands"), "t").alias("x")).select("node", "x.*"))
    total = nodes.count()
    reps = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("records")))
    folded = looked_up(nodes.select("node", "fp"), reps, ["fp"], total).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    at = lambda old, new: reps.select(F.col("fp").alias(old), F.col("rep").alias(new))
    near = links(reps.select("fp")).join(at("a", "x"), "a").join(at("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    shared, total = similar.shared_bands(nodes), total * similar.BANDS
    met = folded.union(near).union(similar.candidates(nodes, shared, total, similarity)).where("a <> b")
    pairs = cut(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(shared.where(F.col("members") > similar.HOT_BAND).select("node")).distinct()
    wanted = nodes.join(ends, "node").select(F.col("doc_id").alias("d"), F.col("t").alias("k"))
    own = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("k")), "left_semi")
    kept = cut(described(own, shingle, grams=True).dropDuplicates(["node"]))
    a, b = kept.select(F.col("node").alias("a"), F.col("grams").alias("x")), kept.select(F.col("node").alias("b"), F.col("grams").alias("y"))

    def run(batches):
        for batch in batches:
            alike = [similar.jaccard(np.frombuffer(x.as_py(), dtype="<u4"), np.frombuffer(y.as_py(), dtype="<u4")) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    alike = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
    linked = cut(components(alike))
    roots = linked.union(linked.select("root", "root").distinct())
    rest = similar.unsettled(shared, roots, total)
    if rest.isEmpty():
        return linked.select(F.col("node").alias("a"), F.col("root").alias("b"))
    more = similar.compared(similar.cells_met(rest, total), kept, similarity)
    return linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)


def keep_first(docs: DataFrame, shingle: int = TEXT_SHINGLE, similarity: float = similar.SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates (sets of word shingles of Jaccard similarity ``similarity`` or more), all columns kept.

    It is the row with the least id, of such the one whose text has the least hash; rows without id come after the others. Rows that
    repeat an id are told apart by their texts, so that only near-duplicates go. Texts without words are one group.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    rows = cut(described(texts, shingle))
    linked = cut(components(similar_texts(texts, rows, similarity, shingle)))
    roots = linked.union(linked.select("root", "root").distinct())
    # One row a node before components are joined, however many copies it has.
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    firsts = rows.groupBy("node").agg(F.min(order).alias("first")).join(roots, "node", "left")
    kept = firsts.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select(
        F.coalesce("first.doc_id", F.lit(0)).alias("own"), F.col("first.last").alias("none"), F.col("first.t").alias("k")).distinct()
    key = ["own", "none", "k"]
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("own"), F.col("doc_id").isNull().alias("none"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"))
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
