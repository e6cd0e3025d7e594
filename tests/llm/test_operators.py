"""The ten operators against plain Python on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.llm import language, learning, mixing, packing, pii, quality_model, quality_rules, simhash, toxicity, warc, winnowing
from tracewell.llm.common import fresh_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pra", "sti", "vo") for b in ("n", "ra", "tel", "shu", "kig", "d")]


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, prose(i, 20 + 7 * (i % 9)), "ab"[i % 2], f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, rows[0][1], "a", "s0", 1), (101, None, None, None, None), (102, "", "a", None, 0), (102, "", "a", None, 0), (103, " \n\t", "a", "s1", 3), (None, "lone row", "b", "s2", 8)]
    rows += [(104, "é漢🙂 " * 50 + prose(7, 40), "b", "s0", 5), (105, "x" * 20000, "a", "s1", 20000), (106, prose(3, 30) + "\n" + prose(3, 30), "a", "s1", 7), (107, "word", "a", "s2", 4)]
    return spark.createDataFrame(rows, SCHEMA)


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Columns with the names that operators use themselves."""
    return docs.withColumns({c: F.lit(9) for c in ("score", "size", "key", "h", "t", "bucket", "row", "spans", "fp", "component_id", "finish", "epoch", "copies", "target", "y", "found", "_words", "made")})


# 1


def brute_targets(sizes: list[int], weights: list[int]) -> list[float]:
    total, capped = sum(sizes), set()
    while True:
        left, w = total - sum(3 * sizes[i] for i in capped), sum(x for i, x in enumerate(weights) if i not in capped)
        out = [3.0 * s if i in capped else left * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(out) if i not in capped and t > 3 * sizes[i]}
        if not over:
            return out
        capped |= over


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame([(f"0s{i}", s) for i, s in enumerate(sizes)], "key string, source_size long")).collect()
    want = brute_targets(sizes, [i % 3 + 1 for i in range(len(sizes))])
    assert [r["target"] for r in sorted(rows, key=lambda r: r["key"])] == pytest.approx(want)


def test_mixing(spark, docs):
    rows = mixing.mix_sizes(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((i or -1, count(t)) for i, t in texts(docs))
    assert rows == mixing.mix_sizes(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix_sizes(docs).collect()))
    assert all(r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (_, target), own in by.items():
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    mixed = mixing.mix(clashing(docs))
    assert mixed.columns == clashing(docs).columns
    taken = {}
    for r in mixed.collect():
        taken[(r["doc_id"], r["text"])] = taken.get((r["doc_id"], r["text"]), 0) + count(r["text"])
    want = {}
    for r, (i, t) in zip(sorted(rows, key=lambda r: (str(r["doc_id"]), r["size"])), sorted(texts(docs), key=lambda x: (str(x[0]), count(x[1]))), strict=True):
        want[(i, t)] = want.get((i, t), 0) + r["taken"]
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in want.items() if v}
    assert mixing.mix(docs.withColumn("a`b", F.lit(1))).columns[-1] == "a`b"
    assert mixing.mix_sizes(empty(spark)).count() == mixing.mix(empty(spark)).count() == 0
    assert [r["taken"] for r in mixing.mix_sizes(empty(spark).unionByName(docs.where("text is null"))).collect()] == [0]


@pytest.mark.parametrize("edge", [2, 10_000])
def test_mix_against_a_sorted_stream(spark, monkeypatch, edge):
    """The whole stream of finish times, sorted and cut in plain Python, and the document across each source's line."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    monkeypatch.setattr(mixing, "RANGES", 7)
    r = np.random.default_rng(edge)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60) if i % 40 else 900)), f"s{int(r.integers(4))}") for i in range(300)] + [(None, "a b", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    queue = {}
    for x in df.withColumn("h", F.xxhash64("doc_id", "text", F.lit(mixing.SEED))).collect():
        queue.setdefault((x["source"] is None, x["source"] or ""), []).append((x["h"], len(x["text"].split())))
    keys = sorted(queue)
    goals = dict(zip(keys, brute_targets([sum(n for _, n in queue[k]) for k in keys], [i % 3 + 1 for i in range(len(keys))]), strict=True))
    stream, at = [], {}
    for k in keys:
        at[k] = np.cumsum([n for _, n in sorted(queue[k])] * 3)
        stream += [(a / goals[k], n) for a, n in zip(at[k].tolist(), [n for _, n in sorted(queue[k])] * 3, strict=True)]
    budget, total, line = sum(n for q in queue.values() for _, n in q), 0, 0.0
    for finish in sorted({f for f, _ in stream}):
        total += sum(n for f, n in stream if f == finish)
        if total > budget:
            break
        line = finish
    want = {}
    for k in keys:
        served = max([a for a in at[k].tolist() if a / goals[k] <= line], default=0)
        following = min([a for a in at[k].tolist() if a / goals[k] > line], default=None)
        want[k] = following if following is not None and abs(following - goals[k]) < abs(served - goals[k]) else served
    got = {}
    for x in mixing.mix(df).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect():
        got[(x["source"] is None, x["source"] or "")] = x["n"]
    assert got == {k: n for k, n in want.items() if n}


# 2


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(seen)


def test_quality_rules(spark, docs):
    more = spark.createDataFrame([(200, "a b c d e f a b c d e x", "a", "s", 1), (201, "l one\n\nl one\n \nl one\nx #|", "a", "s", 1), (202, "a a a a a a a", "a", "s", 1)], SCHEMA)
    both = docs.unionByName(more)
    rows = quality_rules.apply_policy(quality_rules.ledger(both)).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(r["text"])
        base = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert bool(r["failures"] & quality_rules.bits(quality_rules.BASE)) == base and not (base and r["kept"])
    ledger = quality_rules.ledger(both)
    for a in quality_rules.ablation(ledger).collect():
        bit = quality_rules.bits((a["rule"],))
        assert a["failed"] == sum(bool(r["failures"] & bit) for r in rows) and a["only_failure"] == sum(r["failures"] == bit for r in rows)
        assert a["kept"] == sum(r["kept"] for r in rows) <= a["kept_without"]
    assert quality_rules.ledger(empty(spark)).count() == 0
    kept = quality_rules.ledger(clashing(both).withColumns({"words": F.lit(9), "n_upper": F.lit("x"), "a`b": F.lit(1)})).where("doc_id = 105").first()
    assert (kept["words"], kept["_words"], kept["row"], kept["a`b"], kept["n_upper"], kept["word_chars"]) == (9, 9, 9, 1, 0, 20000)


# 3


def test_warc(spark, tmp_path):
    pages = [(5, "http://x/5", "same"), (2, "http://x/2 y", "same"), (9, None, None), (3, "http://x", ""), (4, "http://é", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n漢"), (7, "u", "x" * 3_000_000), (2, "again", "same"), (None, "n", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = fresh_folder(spark, "warc-test")
    warc.write(df, f"{folder}/s")
    archives = warc.normalise(spark, f"{folder}/s", f"{folder}/m")
    got = sorted(map(tuple, warc.read(archives).collect()), key=str)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = min(j for j, _, g in pages if (g or "") == (h or "") and j is not None)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    # Every member is a gzip stream of its own where the sidecar says.
    for a in archives.collect():
        data = open(a["archive"].removeprefix("file:"), "rb").read()
        at = 0
        for line in open(a["sidecar"].removeprefix("file:")):
            x = __import__("json").loads(line)
            assert x["offset"] == at and zlib.decompress(data[at : at + x["length"]], 31).startswith(b"WARC/1.1\r\n")
            at += x["length"]
        assert at == len(data)
    sizes = warc.with_roles(df, min_payload=10).where("refers_to is not null").count()
    assert sizes == 0
    warc.write(df.where("false"), f"{folder}/e")
    assert warc.read(warc.normalise(spark, f"{folder}/e", f"{folder}/em")).count() == 0


def test_gzip_stream_of_many_members():
    import io

    data = b"".join(zlib_gzip(x) for x in (b"abc", b"", b"defg" * 1000))
    assert b"".join(warc.inflated(io.BytesIO(data))) == b"abc" + b"defg" * 1000


def test_inflation_is_bounded():
    import io

    data = b"WARC/1.1\r\nContent-Length: 60000000\r\n\r\n" + b"x" * 60_000_000 + b"\r\n\r\n"
    stream = zlib_gzip(data) + zlib_gzip(b"WARC/1.1\r\nContent-Length: 1\r\n\r\ny\r\n\r\n" * 1000)
    assert max(map(len, warc.inflated(io.BytesIO(stream)))) <= warc.BUFFER
    assert [len(b) for _, _, b in warc.records(warc.inflated(io.BytesIO(stream)))] == [60_000_000] + [1] * 1000
    with pytest.raises(ValueError):
        list(warc.records([data[:-100]]))


def zlib_gzip(x: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(x) + z.flush()


# 4

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PIECES = ["a@b.c", "_", "@", ".", "1", "22", "255", "256", "0001", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "4111111111111112", "10.0.0.1", "+1 (375) 555-4393", "x", "é", "🙂", "\n", "mail x.y+z@q-r.st.uv"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=40, max_size=40))
def test_base_spans(spark, many):
    df = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["kind"] != "id"] for r in pii.with_spans(df).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(many)}


def test_bootstrapping_and_redaction(spark):
    def card(i: int, valid: bool) -> str:
        body = f"4{i:014d}"
        check = next(d for d in "0123456789" if luhn(body + d) == valid)
        return body + check

    rows = [(i, f"some words account: {card(i, True)} end {prose(i, 5)}") for i in range(30)]
    rows += [(50, f"here account: {card(99, False)} too"), (51, f"number {card(98, False)} alone"), (52, None), (53, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["row"]["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.with_spans(df).collect()}
    assert found[50] == [("id", 14, 30)], "a number in a trusted context is found though its check digit is wrong"
    assert found[51] == found[52] == found[53] == [] and all(len(found[i]) == 1 for i in range(30))
    out = {r["doc_id"]: r for r in pii.redact(clashing(df.withColumn("n_chars", F.lit(0).cast("long")))).collect()}
    assert out[50]["text"] == "here account: [ID] too" and out[50]["n_chars"] == 22 and out[50]["score"] == 9
    assert out[3]["text"].startswith("some words account: [CARD] end ") and out[52]["text"] is None and out[53]["text"] == ""
    assert pii.with_spans(df.where("false")).count() == 0


def test_contexts_generalise(spark):
    """Identifiers of shapes that no base pattern matches, in contexts that seeds induce; whole, however long; nothing in other contexts."""
    r = np.random.default_rng(8)
    hexa = lambda n: "".join(r.choice(list("0123456789abcdef"), n)) + "a1"
    rows = [(i, f'{prose(i, 4)} Schlüssel = "{hexa(38)}" {prose(i + 1, 3)} the {i % 90}') for i in range(40)]
    rows += [(100 + i, f"{prose(i, 3)} mail: u{i}@ex.org, {prose(i, 2)} rate {i}.5.1.{i}.7") for i in range(10)]
    long = "K9" * 60
    more = [(200, f'x schlüssel = "{long}" y'), (201, "the 12345678 of z"), (202, f'plain "{hexa(40)}" word'), (203, "rate 3.5.1.9.7x of"), (204, 'Schlüssel = "nodigits"')]
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    found = {x["row"]["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["spans"] if s["kind"] == "id"] for x in pii.with_spans(df).collect()}
    text = dict(rows + more)
    for i in range(40):
        [(_, a, b)] = found[i]
        assert text[i][a:b] == re.search('"(.*)"', text[i])[1]
    assert [text[200][a:b] for _, a, b in found[200]] == [long] and not any(found[i] for i in found if i >= 100 and i != 200)
    assert pii.redact(df.where("doc_id < 40 or doc_id = 200")).where("doc_id = 200").first()["text"] == 'x schlüssel = "[ID]" y'


def test_long_runs_do_not_blow_up(spark):
    df = spark.createDataFrame([(1, "1 " * 50_000), (2, "a" * 200_000 + "@"), (3, "9" * 100_000), (4, "1.2.3.4 " * 2_000), (5, "ab" * 100_000 + "1"), (6, "a1" * 100_000), (7, "a/" * 100_000), (8, "word " * 50_000 + "x1")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: len(r["spans"]) for r in pii.with_spans(df).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 2_000, 5: 0, 6: 0, 7: 0, 8: 0}


# 5


def test_forward_backward():
    r = np.random.default_rng(0)
    t = r.normal(size=(2, 2))
    lengths = np.array([5, 1, 0, 9, 300])
    evidence = r.normal(size=lengths.sum()) * 2
    got, _, _ = toxicity.chain(evidence, lengths, t)
    at = 0
    for n in lengths:
        e = np.column_stack([np.zeros(n), evidence[at : at + n]])
        if 0 < n <= 9:
            paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
            p = np.exp([sum(e[i, s] for i, s in enumerate(q)) + sum(t[a, b] for a, b in zip(q, q[1:], strict=False)) for q in paths])
            assert got[at : at + n] == pytest.approx([(p * [q[i] for q in paths]).sum() / p.sum() for i in range(n)])
        at += n


def toxic_rows(n):
    r = np.random.default_rng(4)
    bad = ["vilescum", "vilerat", "grotmug", "grotbag"]
    rows = []
    for i in range(n):
        ws, toxic = list(r.choice(WORDS, 30 + i % 40)), i % 6 == 0
        if toxic:
            for b in r.choice(bad, 3):
                ws.insert(int(r.integers(len(ws))), b)
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(600)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9000, ""), (9000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(clashing(df), model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in held) and got[9000] < 0.7 and got[None] == got[9000]
    text = rows[0][1]
    assert {text[a:b] for a, b, _ in model.spans(text)} & {"vilescum", "vilerat", "grotmug", "grotbag"}
    marked = toxicity.score(df.where("doc_id = 0"), model).first()
    assert [(x["start"], x["end"]) for x in marked["toxic_spans"]] == [(a, b) for a, b, _ in model.spans(text)]
    assert [r["score"] for r in toxicity.score(df.limit(2), toxicity.fit(df, labels.where("false"))).collect()] == [0.0, 0.0]
    assert toxicity.score(df.where("false"), model).count() == 0 and toxicity.score(df.where("false"), 0.0).count() == 0
    blank = spark.createDataFrame([(i, " " * i) for i in range(8)], "doc_id long, text string")
    flat = toxicity.fit(blank, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int"))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(blank, flat).collect())


def test_telling_words_anywhere_in_a_long_text():
    """All of a long text is learned from and scored, not its beginning."""
    r, texts, y = np.random.default_rng(11), [], []
    for i in range(120):
        ws = list(r.choice(WORDS, 2000))
        if i % 4 == 0:
            ws[1990 - i] = "vilerat"
        texts.append(" ".join(ws))
        y.append(float(i % 4 == 0))
    model = toxicity.ToxicField().fit(texts[:80], np.array(y[:80]))
    assert ((np.array(model.score(texts[80:])) >= 0.7) == (np.array(y[80:]) == 1)).all()


def test_samples(spark):
    """Exact sizes, the same rows however the table is dealt out, rare classes kept, whole texts, one row an id."""
    rows = [(i, "rare" if i % 500 == 0 else "ab"[i % 2]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, y string")
    taken = [sorted(map(tuple, learning.thinned(d, "y", 300, 7).collect())) for d in (df, df.repartition(7), df.orderBy(F.desc("doc_id")))]
    assert taken[0] == taken[1] == taken[2]
    n = {c: sum(y == c for _, y in taken[0]) for c in ("a", "b", "rare")}
    assert n["rare"] == 40 and 149 <= n["a"] <= 151 and 149 <= n["b"] <= 151
    assert learning.thinned(df.limit(0), "y", 300, 7).count() == 0
    docs = spark.createDataFrame([(1, "x" * 50_000), (1, "y"), (2, None), (3, "z")], "doc_id long, text string")
    got = learning.texts_of(docs, spark.createDataFrame([(i, 0) for i in range(5)], "doc_id long, y int")).collect()
    assert sorted((r["doc_id"], len(r["text"])) for r in got) in ([(1, 50_000), (3, 1)], [(1, 1), (3, 1)])


# 6


def test_byte_network(spark):
    net = quality_model.ByteNetwork(3)
    text = prose(1, 2000) + "é漢🙂"
    data = quality_model.as_bytes(text)
    e = net.p["embed"][data]
    direct = sum(e[k : len(data) - quality_model.WIDTH + 1 + k] @ net.p["filters"][k] for k in range(quality_model.WIDTH))
    assert net.responses(data) == pytest.approx(direct, abs=1e-4)
    bounds = quality_model.chunk_bounds(len(direct))
    assert bounds[0, 0] == 0 and bounds[-1, 1] == len(direct) and all(b[0] < a[1] for a, b in zip(bounds, bounds[1:], strict=False))
    assert net.pooled(data) == pytest.approx(np.array([direct[a:b].max(axis=0) for a, b in bounds]), abs=1e-4)


def test_gradient():
    net = quality_model.ByteNetwork(5)
    net.t = net.t.astype(np.float64)
    data, y = [quality_model.as_bytes(prose(i, 5 + 80 * i)) for i in range(3)], np.array([1.0, 0, 1])
    loss = lambda: sum(np.logaddexp(0, -(2 * b - 1) * np.log(p / (1 - p))) for p, b in ((net.score(bytes(d).decode()), b) for d, b in zip(data, y, strict=True))) / 3
    g = net._gradient(data, y)
    for k in ("out", "hidden_shift", "shift", "filters"):
        flat, at = net.p[k].reshape(-1), int(np.abs(g[k]).argmax())
        was, h = flat[at], 1e-4
        ends = []
        for s in (h, -h):
            flat[at] = was + s
            net.t = net.p["embed"] @ net.p["filters"]
            ends.append(loss())
        flat[at] = was
        assert (ends[0] - ends[1]) / (2 * h) == pytest.approx(g[k].reshape(-1)[at], rel=0.05)


def test_quality(spark):
    rows = [(i, prose(i, 60) if i % 4 else " ".join(["zap###!!"] * (20 + i % 30)), int(i % 4 > 0)) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality_model.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality_model.score(df, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.97
    assert got[None] == got[9000] and 0 <= got[None] <= 1
    some = [t for _, t, _ in rows[:9]] + ["", prose(2, 9000), "x", prose(3, 500)]
    assert model.scores(some) == pytest.approx([model.score(t) for t in some], abs=1e-6) and model.scores([]) == []
    assert quality_model.score(df.where("false"), model).count() == 0
    kept = quality_model.keep_good(clashing(df), labels)
    assert kept.columns == clashing(df).columns and {r["score"] for r in kept.collect()} == {9}
    assert quality_model.keep_good(df, labels.where("false")).count() == df.count()


# 7


def brute_winnow(text, k=winnowing.K, w=winnowing.W):
    """Positions chosen from given hashes: least in each window, the rightmost of equal ones."""
    chosen = []
    for i in range(max(1, len(text) - w + 1)):
        window = text[i : i + w]
        if window:
            at = max(j for j, h in enumerate(window) if h == min(window)) + i
            if at not in chosen:
                chosen.append(at)
    return chosen


def brute_hashes(hashes: list[int], whole: int) -> list[int]:
    """Hashes of K tokens from the hashes of single ones, by the polynomial itself."""
    of = lambda x: sum(h * pow(winnowing.BASE, len(x) - 1 - j, winnowing.PRIME) for j, h in enumerate(x)) % winnowing.PRIME
    return [of(hashes[i : i + winnowing.K]) for i in range(len(hashes) - winnowing.K + 1)] if len(hashes) >= winnowing.K else [whole] * (len(hashes) > 0)


def brute_prints(spark, texts: list[str]) -> dict[str, list[tuple[int, int]]]:
    tokens = {t: re.findall(winnowing.TOKEN.replace("}+", "}"), t) for t in set(texts)}
    h = lambda c: F.shiftrightunsigned(F.xxhash64(c), 33) % winnowing.PRIME
    rows = spark.createDataFrame(list(tokens.items()), "text string, tokens array<string>").select("text", F.transform("tokens", h).alias("each"), h("tokens").alias("whole")).collect()
    out = {}
    for r in rows:
        hashes = brute_hashes(r["each"], r["whole"])
        out[r["text"]] = [(p, hashes[p]) for p in brute_winnow(hashes)]
    return out


def parsed(fingerprint: str) -> list[tuple[int, int]]:
    return [(int(x.split(":")[0]), int(x.split(":")[1], 16)) for x in fingerprint.split(",")] if fingerprint else []


def test_winnowing(spark, docs):
    both = docs.unionByName(spark.createDataFrame([(300, "a a a a a a a a a a a a a a a", "a", "s", 1), (301, "a b c", "a", "s", 1), (302, "seventeen-letters two " + "漢字仮名" * 9, "a", "s", 1)], SCHEMA))
    got = {(r["doc_id"], r["text"]): r["fingerprint"] for r in winnowing.fingerprints(clashing(both).withColumn("fingerprint", F.lit(1))).collect()}
    want = brute_prints(spark, [t or "" for _, t in got])
    assert all(parsed(f) == want[t or ""] for (_, t), f in got.items())
    assert got[(0, prose(0, 20))] == got[(100, prose(0, 20))]


def test_passages_of_texts_without_spaces(spark):
    """A passage is found wherever it begins in a run of characters."""
    r = np.random.default_rng(5)
    letters = lambda n: "".join(chr(0x4E00 + int(x)) for x in r.integers(0, 3000, n))
    shared, base = letters(400), letters(800)
    rows = [(0, letters(32) + shared), (1, letters(33) + shared + letters(50)), (2, base), (3, "x" + base[:400])]
    prints = {x["doc_id"]: {h for _, h in parsed(x["fingerprint"])} for x in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(prints[0] & prints[1]) > 30 and len(prints[2] & prints[3]) > 30


def test_edited_texts(spark, tmp_path):
    """The query's columns against plain Python."""
    texts = [None, "", "a b", prose(1, 50), prose(1, 50), "é漢🙂 " * 30, prose(2, 400), "x" * 300, prose(3, 12) + "\n" + prose(4, 90)]
    spark.createDataFrame([(7 * i - 9, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in winnowing.op7_winnowing(spark, str(tmp_path)).collect()}
    whole = [t or "" for t in texts]
    after = [whole[(i + 1) % len(whole)] for i in range(len(whole))]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(whole, after, strict=True)]
    prints = {t: {h for _, h in p} for t, p in brute_prints(spark, [*whole, *edited]).items()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (t, n, e) in enumerate(zip(whole, after, edited, strict=True)):
        r = rows[7 * i - 9]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert {h for _, h in parsed(r["fingerprint"])} == prints[t] and {h for _, h in parsed(r["edited_fingerprint"])} == prints[e]
        assert (r["near_edited"], r["near_next"]) == pytest.approx((like(prints[t], prints[e]), like(prints[t], prints[n])))


def test_match_guarantee(spark):
    shared = prose(77, winnowing.W + winnowing.K - 1)
    rows = [(i, prose(i, 30) + " " + shared + " " + prose(100 + i, 30)) for i in range(6)]
    prints = [{x.split(":")[1] for x in r["fingerprint"].split(",")} for r in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert all(a & b for a in prints for b in prints)


def test_next_document(spark, docs, monkeypatch):
    monkeypatch.setattr(winnowing, "STRETCH_ROWS", 3)
    for table in (docs, docs.repartition(5), docs.limit(1), empty(spark)):
        rows = [(r["doc_id"], r["text"] or "") for r in table.collect()]
        got = sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in winnowing.with_next(table, {}).collect())
        hashed = {r["text"]: r["t"] for r in spark.createDataFrame([(t,) for _, t in rows] or [("",)], "text string").select("text", F.xxhash64("text").alias("t")).collect()}
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed.get(r[1], 0)))
        assert got == sorted((str(i), t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows))


# 8


def test_language(spark):
    r = np.random.default_rng(1)
    ends = {"xx": ["ing", "tion", "ed", "the"], "yy": ["ung", "keit", "isch", "der"], "zz": ["aire", "eux", "ée", "les"]}
    rows = [(i, " ".join(a + b for a, b in zip(r.choice(WORDS, 25), r.choice(ends[lang], 25), strict=True)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 130)]
    odd = [(9000, None, "xx"), (9001, "123 !?", "yy"), (9002, "", None), (9003, "½ Ⅷ ² 3_", None), (None, "theing tioned", "xx")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = language.fit(df)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language.predict(clashing(df), model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i][0] == lang for i, lang in held]) > 0.97
    assert got[9000] == got[9001] == got[9002] == got[9003] == ("und", 0.0) and got[None][0] == "xx" and all(0 <= s <= 1 for _, s in got.values())
    assert len(model.weights) - 1 < language.DIM / 4, "most weights are zero"
    assert language.fit(empty(spark)).predict("some text") == ("und", 0.0) and language.predict(empty(spark), model).count() == 0
    usable = [t for i, t, lang in [*rows, *odd] if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5 != 0]
    seen, n = language.document_frequencies(spark.createDataFrame([(t,) for t in usable], "text string").repartition(3))
    assert n == len(usable) and seen.tolist() == sum(np.bincount(language.counts(t)[0], minlength=language.DIM) for t in usable).tolist()
    # The prediction from its definition: softmax of weighted, scaled n-gram counts.
    text = rows[5][1]
    at, c = language.counts(text)
    x = np.log1p(c) * model.idf[at]
    dense = np.zeros((language.DIM, len(model.languages)))
    dense[model.row > 0] = model.weights[model.row[model.row > 0]]
    z = ((x / np.linalg.norm(x)) @ dense[at] + model.intercept) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert model.predict(text) == (model.languages[int(p.argmax())], pytest.approx(float(p.max())))


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=60), st.integers(1, 20))
def test_ngram_counts_do_not_depend_on_pieces(text, piece):
    at, n = language.counts(text)
    was, language.PIECE = language.PIECE, piece
    try:
        at2, n2 = language.counts(text)
    finally:
        language.PIECE = was
    assert at.tolist() == at2.tolist() and n.tolist() == n2.tolist()


# 9


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["it's", "'s", "'ve", "<|endoftext|>", "É", "é", "J̌", "ΣΑΣ", "ﬁ", "²", "x_y", "12", "漢字", "🙂", " ", "\n", "\u0085", "　", "\x1c", "Word", "word,", "a.b"]), max_size=12).map("".join)))
def test_ids(encoder, text):
    assert encoder.ids([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def check_packing(rows, ids, capacity, max_segments, max_loss):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids[i])
    assert set(by_doc) == set(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity and len(pieces) <= max_segments and sum(p["loss_tokens"] for p in pieces) <= max_loss
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing(spark, docs, encoder):
    once = docs.dropDuplicates(["doc_id"])
    ids = {i: [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts(once)}
    assert check_packing(packing.pack(once).collect(), ids, 4096, 64, 4096) == 0
    assert check_packing(packing.pack(once, capacity=64, max_segments=3, max_loss=64).collect(), ids, 64, 3, 64) == 0
    # Every limit is reached by some sequence that the others leave room in.
    lines = docs.where("doc_id < 40").withColumn("text", F.concat(F.regexp_extract("text", r"^(\S+ \S+ \S+) (.*)", 1), F.lit("\n"), F.regexp_extract("text", r"^(\S+ \S+ \S+) (.*)", 2)))
    few = {i: [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts(lines)}
    rows = packing.pack(lines, prompt=packing.first_line(F.col("text")), capacity=256, max_segments=2, max_loss=252).collect()
    check_packing(rows, few, 256, 2, 252)
    assert sum(r["loss_tokens"] for r in rows) == sum(len(x) - 3 for x in few.values())
    sums = {}
    for r in rows:
        n = sums.setdefault(r["sequence_id"], [0, 0, 0])
        sums[r["sequence_id"]] = [n[0] + r["length"], n[1] + 1, n[2] + r["loss_tokens"]]
    assert any(a == 256 for a, _, _ in sums.values()) and any(b == 2 and a < 256 for a, b, _ in sums.values())
    tight = packing.pack(lines, prompt=packing.first_line(F.col("text")), capacity=256, max_segments=50, max_loss=100).groupBy("sequence_id").agg(F.sum("length").alias("a"), F.sum("loss_tokens").alias("c")).collect()
    assert all(r["c"] <= 100 for r in tight) and any(r["c"] == 100 and r["a"] < 256 for r in tight)
    assert packing.pack(docs).groupBy().sum("length").first()[0] == sum(len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts(docs))
    assert packing.pack(empty(spark)).count() == 0


# 10


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbZ é \t\n🙂", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(fps: dict) -> dict:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [1, 32])
def test_links_and_components(spark, hot):
    r = np.random.default_rng(hot)
    fps, at = {}, int(r.integers(1 << 63))
    for i in range(150):  # chains of small steps, restarting now and then
        at = int(r.integers(1 << 63)) if i % 25 == 0 else at ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64)) if i % 3 else 0)
        fps[i] = at
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in set(fps.values())], "fp long")
    found = {row["node"] % (1 << 64): row["root"] % (1 << 64) for row in simhash.components(simhash.links(nodes, hot)).collect()}
    want = brute_components(fps)
    groups = {}
    for i, v in fps.items():
        groups.setdefault(found.get(v, v), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_near_duplicates(spark, docs):
    long = prose(500, 400)
    more = spark.createDataFrame([(400, long, "a", "s", 1), (401, long.replace(" ", "  "), "a", "s", 1), (402, long.upper(), "a", "s", 1), (403, long + " extra", "a", "s", 1)], SCHEMA)
    both = docs.unionByName(more)
    rows = simhash.near_duplicates(both).collect()
    want = brute_components({r["doc_id"]: brute_fingerprint(t) for r, t in ((x, x["text"]) for x in both.collect()) if r["doc_id"] is not None})
    assert len(rows) == both.count()
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == want
    assert simhash.near_duplicates(empty(spark)).count() == simhash.keep_first(empty(spark)).count() == 0
    assert simhash.keep_first(clashing(both)).columns == clashing(both).columns
    same = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "one two three four five six"), (1, "one two three four five six")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_first(same).collect()) == ["alpha beta gamma delta", "one two three four five six"]
