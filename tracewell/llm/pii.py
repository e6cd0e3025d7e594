"""Personal data: base patterns with positions, and contextual extraction bootstrapped from what they find.

Finding positions with built-in functions: a text split at a pattern gives the gaps between its matches, so gaps and matches
become rows (one per match, only of texts that have any) and a running sum over them gives each match's start.

Bootstrapping: every mention, i.e. a word (the cue), what stands between, and what follows it that has a digit or an at sign (the
instance), makes two lexical patterns: cue and separator with the shape of the instance, and cue and separator alone, so that an
identifier of another shape is found in a context that is sure enough. Seeds are the instances that are base spans and long
hexadecimal numbers (keys and tokens, ``SECRET``), which become spans only through their context. A pattern is scored by the trust
of its different instances, an instance by the best trusted pattern it is seen with; joins and aggregates over the graph
of patterns and instances carry trust from seeds to patterns, to instances that no base pattern matches, and on to further
patterns, until no more edges become trusted. Mentions that are trusted become spans of kind ``id``.

All tables after the first are proportional to the mentions, not the texts, and all steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import cut, looked_up

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "id")
#: The base patterns, written so that Java's engine neither recurses nor looks again at what it has seen: a run is
#: entered at its first character only (or where the last match ended), and repetitions do not give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may stand between a cue and an instance, and a mention: a word of any script, that, and six or more characters of which
#: one is a digit or an at sign. All repetitions are possessive, so a text is read once.
BETWEEN = r"[\x20:=#|(\[\x22']{1,6}+"
MENTION = r"(?<!\p{L})\p{L}++" + BETWEEN + r"(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9@._%+/-]{6,}+"
SPLIT_MENTION = r"^(\p{L}++)(" + BETWEEN + r")(.*)$"
#: The same before a base span, read backwards from it.
BACKWARDS = "^(" + BETWEEN + r")(\p{L}++)"
#: Seeds beside the base spans: 32 hexadecimal digits or more, with letters and digits among them.
SECRET = r"^(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+$"

#: Seeds that a pattern must have and trust that it must reach on average, with the shape and without.
MIN_SEEDS, TRUST, ANY_SHAPE_SEEDS, ANY_SHAPE_TRUST = 5, 0.8, 20, 0.9


def _finds(texts: DataFrame) -> DataFrame:
    """(doc_id, t, kind, i, gap, match, before) of every match in ``texts`` (doc_id, t, text); ``before`` is what stands before a base span, backwards."""
    kinds = PATTERNS | {"mention": MENTION}
    each = [F.struct(F.lit(kind).alias("kind"), F.split("text", p, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(p), 0).alias("matches")) for kind, p in kinds.items()]
    rows = texts.where(F.col("text").rlike("[0-9@]")).select("doc_id", "t", F.inline(F.array(*each))).where(F.size("matches") > 0)
    before = F.when(F.col("kind") != "mention", F.regexp_extract(F.reverse("col.gap"), BACKWARDS, 0))
    return rows.select("doc_id", "t", "kind", F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("matches")).alias("gap"), F.col("matches").alias("match")))).select(
        "doc_id", "t", "kind", F.col("pos").alias("i"), F.length("col.gap").alias("gap"), F.col("col.match").alias("match"), before.alias("before"))


def _luhn(digits: Column) -> Column:
    def at(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + at(i)) % 10 == 0


def _valid() -> Column:
    """Whether a match keeps to its kind's numbers."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    parts = F.forall(F.split("match", r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).isin(0, 1, 2) | ((F.length(F.regexp_replace(p, "^0+", "")) == 3) & (F.regexp_replace(p, "^0+", "") <= "255")))
    return F.when(F.col("kind") == "ip", parts).when(F.col("kind") == "card", F.length(digits).between(13, 19) & _luhn(F.when(F.length(digits).between(13, 19), digits).otherwise("0"))).when(
        F.col("kind") == "phone", F.length(digits).between(9, 15)).otherwise(True)


def found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base spans, mentions) of ``docs`` (doc_id, text): doc_id, t (a hash of the text), kind, start, end, match, before. Rows that
    repeat id and text are looked at once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    line = Window.partitionBy("doc_id", "t", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = _finds(texts).dropDuplicates(["doc_id", "t", "kind", "i"]).withColumn("end", F.sum(F.col("gap") + F.length("match")).over(line))
    rows = cut(rows.select("doc_id", "t", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before").where(_valid()))
    return rows.where("kind <> 'mention'"), rows.where("kind = 'mention'")


def _patterns(cue: Column, between: Column, instance: Column) -> Column:
    """The two patterns of a mention (pattern, with shape or not). Of a shape, runs of letters count whatever their length, and runs of digits by five sizes."""
    shape = F.regexp_replace(instance, r"(?<![a-z0-9])(?:[a-z]++[0-9]|[0-9]++[a-z])[a-z0-9]*+", "Q")
    shape = F.regexp_replace(shape, "[a-z]++", "A")
    for name, size in (("V", "{20,}"), ("L", "{13,19}"), ("M", "{8,12}"), ("S", "{4,7}"), ("T", "{1,3}")):
        shape = F.regexp_replace(shape, f"[0-9]{size}+", name)
    context = F.concat(F.lower(cue), F.regexp_replace(between, r"\x20+", " "))
    return F.array(F.struct(F.concat(context, shape).alias("pattern"), F.lit(True).alias("shaped")), F.struct(context.alias("pattern"), F.lit(False).alias("shaped")))


def mentions(base: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions that no base span overlaps: doc_id, t, start, end, instance, patterns; the graph of all mentions: pattern, shaped, instance, seed, records).

    ``start`` and ``end`` are those of the instance.
    """
    word, between, value = (F.regexp_extract("match", SPLIT_MENTION, i) for i in (1, 2, 3))
    value = F.regexp_replace(value, r"(?<![._%+/-])[._%+/-]++$", "")
    rows = raw.withColumn("from", F.col("start") + F.length(word) + F.length(between)).select(
        "doc_id", "t", F.col("from").alias("start"), (F.col("from") + F.length(value)).alias("end"), F.lower(value).alias("instance"), _patterns(word, between, F.lower(value)).alias("patterns"))
    rows = rows.where((F.length("instance") >= 6) & F.col("instance").rlike("[0-9@]"))
    spans = base.select("doc_id", "t", F.col("start").alias("s"), F.col("end").alias("e"))
    # Within a document only mentions and spans that touch the same thousand characters are compared.
    place = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 1000), F.floor((F.col(b) - 1) / 1000)))
    left, right = rows.withColumn("p", place("start", "end")), spans.select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), "s", "e", place("s", "e").alias("p2"))
    touched = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")) & (F.col("p") == F.col("p2")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e"))
    hit = left.join(right, touched, "left").groupBy("doc_id", "t", "start", "end", "instance", "patterns").agg(F.max(F.col("s").isNotNull()).alias("seed"))
    own = cut(hit.where(~F.col("seed")).drop("seed"))
    back = F.col("before")
    cue = base.where(back != "").select(F.lower("match").alias("instance"), F.reverse(F.regexp_extract(back, BACKWARDS, 2)).alias("w"), F.reverse(F.regexp_extract(back, BACKWARDS, 1)).alias("b"))
    seeds = cue.select("instance", F.lit(True).alias("seed"), F.inline(_patterns(F.col("w"), F.col("b"), F.col("instance"))))
    every = seeds.unionByName(own.select("instance", F.col("instance").rlike(SECRET).alias("seed"), F.inline("patterns")))
    return own, cut(every.groupBy("pattern", "shaped", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("records")))


def trusted(graph: DataFrame) -> DataFrame:
    """(pattern, instance, records) edges of ``graph`` (pattern, shaped, instance, seed, records) whose pattern is trusted, and so the instance in it.

    Trust never falls from one round to the next, so the rounds end when as many edges are trusted as before.
    """
    edges, n, was = graph, graph.count(), -1
    trust = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("trust"), F.count("*").alias("records"))
    enough = F.when(F.col("shaped"), (F.col("seeds") >= MIN_SEEDS) & (F.col("conf") >= TRUST)).otherwise((F.col("seeds") >= ANY_SHAPE_SEEDS) & (F.col("conf") >= ANY_SHAPE_TRUST))
    while True:
        known = looked_up(edges.drop("records"), trust, ["instance"], n)
        scored = known.groupBy("pattern", "shaped").agg(F.count("*").alias("records"), F.sum(F.col("seed").cast("long")).alias("seeds"), F.avg("trust").alias("conf"))
        good = cut(scored.where(enough).select("pattern", "conf", "records"))
        inside = cut(looked_up(edges.withColumnRenamed("records", "mentions"), good, ["pattern"], n))
        now = inside.count()
        if now == was or not now:
            return inside.select("pattern", "instance", F.col("mentions").alias("records"))
        was = now
        best = inside.groupBy("instance").agg(F.max("conf").alias("best"))
        trust = cut(trust.join(best, "instance", "left").select("instance", F.greatest("trust", F.coalesce("best", F.lit(0.0))).alias("trust"), "records"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, t, kind, start, end) of all spans of ``docs`` (doc_id, text), base ones and discovered ones.

    Offsets are in code points, ends exclusive. Null and empty texts have none.
    """
    base, raw = found(docs)
    own, graph = mentions(base, raw)
    edges = trusted(graph)
    rows = own.select("doc_id", "t", "start", "end", "instance", F.inline("patterns")).drop("shaped")
    new = looked_up(rows, edges, ["pattern", "instance"], rows.count())
    return base.select("doc_id", "t", "kind", "start", "end").unionByName(new.select("doc_id", "t", F.lit("id").alias("kind"), "start", "end").distinct())


def by_document(all_spans: DataFrame) -> DataFrame:
    """(doc_id, t, spans): each document's spans in the order of kinds and starts."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return all_spans.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind"))).alias("spans"))


def with_spans(docs: DataFrame, *carried: str) -> DataFrame:
    """(row, spans) for every row of ``docs``: its ``carried`` columns (all unless named) as a struct, so that none of them can
    clash with others, and its spans, an empty array where there are none."""
    per = by_document(spans(docs.select("doc_id", "text"))).select(F.col("doc_id").alias("d"), "t", F.col("spans").alias("found"))
    keyed = docs.select(F.struct(*(carried or "*")).alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"))
    joined = keyed.join(per, F.col("own").eqNullSafe(F.col("d")) & (F.col("k") == F.col("t")), "left")
    return joined.select("row", F.coalesce("found", F.array().cast("array<struct<rank:bigint,start:bigint,end:bigint,kind:string>>")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and ``n_chars`` (if there is such a column) counted
    anew. Null texts stay null; all other columns and repeated rows stay.

    Where spans of different kinds overlap, the first one's kind is written and all of them go.
    """
    text = F.col("row.text")
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))))
    first = lambda s, so_far: F.when(s["start"] >= so_far, F.concat(F.substring(text, so_far + 1, s["start"] - so_far), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
    step = lambda a, s: F.struct(F.concat(a["out"], first(s, a["at"])).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))
    whole = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text) - a["at"])))
    made = with_spans(docs).select(F.col("row").withField("text", F.when(F.size("spans") == 0, text).otherwise(whole)).alias("row"))
    if "n_chars" in docs.columns:
        made = made.select(F.col("row").withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)).alias("row"))
    return made.select("row.*")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """All documents: counts by kind, a digest of the base spans, all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    listed = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    count = [of_kind(kind).alias(f"n_{kind}") for kind in KINDS]
    base = listed(F.filter("spans", lambda s: s["kind"] != "id"))
    return with_spans(docs, "doc_id").select("row.doc_id", *count, F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
