"""The queries of this folder, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.language import op8_language
from tracewell.llm.mixing import op1_mixing
from tracewell.llm.packing import op9_packing
from tracewell.llm.pii import op4_pii
from tracewell.llm.quality_model import op6_quality
from tracewell.llm.quality_rules import ABLATION_SQL, OP2_SQL, op2_quality_rules, quality_ablation
from tracewell.llm.simhash import op10_simhash
from tracewell.llm.toxicity import op5_toxicity
from tracewell.llm.warc import OP3_SQL, op3_warc
from tracewell.llm.winnowing import op7_winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_winnowing": op7_winnowing,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "quality_ablation": quality_ablation,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op3_warc": OP3_SQL,
    "quality_ablation": ABLATION_SQL,
}
