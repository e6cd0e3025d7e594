"""The registered queries over the smallest tables: their columns, one row per row of the table, and their SQL's rows."""

import glob
import hashlib
import os

import duckdb
import pytest

from tests.llm.test_operators import brute_spans
from tracewell.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

COLUMNS = {
    "op1": "doc_id size source_size target taken", "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3": "page_id payload_bytes payload_digest record_type refers_to",
    "op4": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op5": "doc_id held_out score predicted", "op6": "doc_id held_out score predicted",
    "op7": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op8": "doc_id held_out lang_pred score",
    "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10": "doc_id fingerprint component_id",
}


def compare(name, df):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    result = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, result.fetchall()))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    kind = name.split("_")[0]
    if kind == "quality":
        compare(name, df)
        return
    assert set(COLUMNS[kind].split()) <= set(df.columns)
    rows = df.collect()
    key = "page_id" if kind == "op3" else "doc_id"
    table = spark.read.parquet(f"{SF}/{'pages' if kind == 'op3' else 'documents'}.parquet")
    ids = sorted(r[0] for r in table.select(key).collect())
    assert sorted(r[key] for r in rows) == ids if kind != "op9" else {r[key] for r in rows} == set(ids)
    if kind == "op4":
        texts = {r["doc_id"]: r["text"] for r in table.collect()}
        for r in rows:
            base = brute_spans(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")]
            assert [x for x in r["spans"].split(",") if x and not x.startswith("id")] == base
    if kind == "op1":
        by = {}
        for r in rows:
            by.setdefault((r["source_size"], r["target"]), []).append(r)
        for (_, target), own in by.items():
            assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-6 or sum(r["taken"] for r in own) > target
    if "score" in df.columns:
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name in ORACLE_SQL:
        compare(name, df)
