"""What can be observed at every operator of a pipeline."""

from tracewell.inspections.base import Inspection
from tracewell.inspections.histogram import HistogramForColumns
from tracewell.inspections.rows import FirstRows, MissingEmbeddings, RandomNote, RowLineage

__all__ = ["FirstRows", "HistogramForColumns", "Inspection", "MissingEmbeddings", "RandomNote", "RowLineage"]
