"""tracewell: data-preparation and machine-learning pipelines on Spark that record what they do to the data."""

from tracewell.checks import NoBiasIntroducedFor, NoIllegalFeatures, NoMissingEmbeddings
from tracewell.functions import Expr, col, lit
from tracewell.inspections import FirstRows, HistogramForColumns, MissingEmbeddings, RowLineage
from tracewell.inspector import PipelineInspector
from tracewell.operators import TracedFrame
from tracewell.plans.session import Session
from tracewell.sources import data_frame, read_csv, read_parquet, series, untracked

__all__ = [
    "Expr", "FirstRows", "HistogramForColumns", "MissingEmbeddings", "NoBiasIntroducedFor", "NoIllegalFeatures", "NoMissingEmbeddings", "PipelineInspector", "RowLineage", "Session",
    "TracedFrame", "col", "data_frame", "lit", "read_csv", "read_parquet", "series", "untracked",
]
