"""Document fingerprints by winnowing, in column expressions.

A text is read as tokens: runs without white space of at most ``RUN`` characters, and the single characters of longer runs (as in
a script without spaces), so that where a run begins does not matter to what follows. The hash of ``K`` tokens is a polynomial in
the hashes of the tokens, made by doubling: neighbouring places share the hashes of two and of four tokens, of which those of
``K`` are put together, so that each place costs a few multiplications whatever ``K``. In every window of ``W`` neighbouring hashes
the least one is chosen, the rightmost of equal ones (minima are doubled in the same way), and a fingerprint keeps each chosen
hash with its position once. Two texts that share ``W + K - 1`` tokens in a row share a chosen hash.

A hash (31 bits) and its position are held in one long, the hash above and the position counted down below it, so that the
least long of a window is the rightmost least hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 5, 8
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
#: The polynomial is taken modulo the prime 2**31 - 1; products stay below 2**62.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
LOW = (1 << 32) - 1
#: Documents in a stretch of the id order, about, and stretches at most (their first documents are broadcast by key: 24 bytes each).
STRETCH_ROWS, STRETCHES, COARSE = 500, 1 << 20, 1024


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chosen(text: Column) -> Column:
    """The fingerprint of a text as longs in order of position. Fewer than ``K`` tokens are hashed as one; none give no hash."""

    def joined(a: Column, b: Column, at: int, times: int) -> Column:
        """At every place the hash in ``a`` followed by the one in ``b`` that begins ``at`` tokens later and is of as many tokens as ``times`` says."""
        factor = pow(BASE, times, PRIME)
        return F.transform(a, lambda v, i: (v * F.lit(factor) + F.coalesce(F.get(b, i + at), F.lit(0))) % F.lit(PRIME))

    def hashes(tokens: Column) -> Column:
        n = F.size(tokens)
        keyed = lambda h, i: F.shiftleft(h, 32).bitwiseOR(F.lit(LOW) - i)
        one = F.transform(tokens, lambda x: F.shiftrightunsigned(F.xxhash64(x), 33) % F.lit(PRIME))
        five = let(one, lambda a: joined(let(joined(a, a, 1, 1), lambda b: joined(b, b, 2, 2)), a, 4, 1))
        many = F.transform(F.slice(five, 1, F.greatest(n - (K - 1), F.lit(1))), keyed)
        few = F.array(keyed(F.shiftrightunsigned(F.xxhash64(tokens), 33) % F.lit(PRIME), F.lit(0)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < K, few).otherwise(many)

    def minima(v: Column) -> Column:
        """Beyond the end nothing is less, so that fewer hashes than ``W`` have one window."""
        doubled = lambda x, at: F.transform(x, lambda m, i: F.least(m, F.get(x, i + at)))
        eight = let(let(doubled(v, 1), lambda x: doubled(x, 2)), lambda x: doubled(x, 4))
        return F.when(F.size(v) == 0, v).otherwise(F.array_distinct(F.slice(eight, 1, F.greatest(F.size(v) - (W - 1), F.lit(1)))))

    return let(let(F.regexp_extract_all(text, F.lit(TOKEN), 0), hashes), minima)


def spelled(fingerprint: Column) -> Column:
    """position:hash (hexadecimal), joined by commas."""
    return F.array_join(F.transform(fingerprint, lambda v: F.concat_ws(":", F.lit(LOW) - v.bitwiseAND(F.lit(LOW)), F.lower(F.hex(F.shiftright(v, 32))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Chosen hashes in common as a share of all that either has; 1 for two empty fingerprints."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda v: F.shiftright(v, 32)))

    def share(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["a"], pair["b"]))
        return let(both, lambda n: F.when(F.size(pair["a"]) + F.size(pair["b"]) == 0, F.lit(1.0)).otherwise(n / F.greatest(F.size(pair["a"]) + F.size(pair["b"]) - n, F.lit(1))))

    return let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), share)


def _stretch(bounds: list[int], fine: int) -> Column:
    """The stretch of an id: the range between quantiles it falls in, by a balanced search, and its part of that range.
    Rows without id come first, dealt out by the next key of the order."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            low, wide = bounds[lo], bounds[lo + 1] - bounds[lo]
            part = F.floor((F.col("doc_id") - low).cast("double") * fine / max(1, wide)) if fine > 1 else F.lit(0)
            return F.lit(lo * fine) + F.greatest(F.lit(0), F.least(part, F.lit(fine - 1)))
        mid = (lo + hi + 1) // 2
        return F.when(F.col("doc_id") < bounds[mid], search(lo, mid - 1)).otherwise(search(mid, hi))

    return F.when(F.col("doc_id").isNull(), F.shiftright("t", 58) - 64).otherwise(search(0, len(bounds) - 2)).cast("long")


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``docs`` (doc_id, text) with ``columns`` computed, and for each of text and columns a next_* of the following document.

    The order is by doc_id (null first), rows with the same id by a hash of the text; after the last comes the first.
    Documents are dealt into stretches of that order and sorted within each; what follows a stretch's last document is the
    first of the next stretch, which is added to the stretch for this. Texts are shuffled once, without the columns, which are
    computed where the texts arrive.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    n, low, high = docs.select(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    rows = max(STRETCH_ROWS, n // STRETCHES)
    coarse = min(COARSE, max(1, n // rows))
    inner = docs.stat.approxQuantile("doc_id", [i / coarse for i in range(1, coarse)], 0.1 / coarse) if coarse > 1 else []
    bounds = [low, *sorted({int(x) for x in inner if low < int(x) <= high}), high + 1] if low is not None else [0, 1]
    dealt = keyed.withColumn("stretch", _stretch(bounds, max(1, n // rows // coarse)))

    firsts = dealt.groupBy("stretch").agg(F.min(F.struct("doc_id", "t")).alias("key"))
    order = Window.orderBy("stretch")
    before = F.coalesce(F.lag("stretch").over(order), F.max("stretch").over(Window.partitionBy()))
    firsts = firsts.select(F.col("key.doc_id").alias("k"), F.col("key.t").alias("kt"), before.alias("before"))
    wanted = dealt.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("t") == F.col("kt")))
    added = wanted.dropDuplicates(["before"]).select("doc_id", "text", "t", F.col("before").alias("stretch"), F.lit(True).alias("added"))

    whole = dealt.withColumn("added", F.lit(False)).unionByName(added).repartition("stretch").withColumns(columns)
    line = Window.partitionBy("stretch").orderBy("added", "doc_id", "t")
    names = ["text", *columns]
    return whole.withColumns({f"next_{c}": F.lead(c).over(line) for c in names}).where(~F.col("added")).select("doc_id", *names, *[f"next_{c}" for c in names])


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (in the place of a column of that name); null texts count as empty, empty texts have an empty fingerprint."""
    return docs.withColumn("fingerprint", spelled(chosen(F.coalesce(F.col(text_col), F.lit("")))))


def op7_winnowing(spark, sf_dir: str) -> DataFrame:
    """All documents and their edited texts: doc_id, n_chars, edited_sha256, both fingerprints, and two likenesses."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    paired = with_next(docs, {"prints": chosen(F.col("text"))}).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    found = edited.withColumn("edited_prints", chosen(F.col("edited")))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spelled(F.col("prints")).alias("fingerprint"),
        spelled(F.col("edited_prints")).alias("edited_fingerprint"), likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"))
