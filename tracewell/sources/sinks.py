"""Sinks: tables, arrays, SQL files, and timed runs."""

from __future__ import annotations

import statistics
import time

import numpy as np

from tracewell.operators.frame import TracedFrame
from tracewell.plans.sqltext import Mode, table_script, to_sql


def write_parquet(frame: TracedFrame, path: str, mode: str = "error") -> None:
    """The visible columns as Parquet."""
    frame.to_df().write.mode(mode).parquet(path)


def to_numpy(frame: TracedFrame) -> np.ndarray:
    """The visible columns in row order as a matrix, arrays spread over columns; meant for results that fit the driver."""
    rows = frame.to_pandas()
    parts = [np.array(rows[c].tolist()) for c in rows.columns]
    return np.hstack([p if p.ndim == 2 else p.reshape(-1, 1) for p in parts]) if parts else np.zeros((0, 0))


def write_sql(frame: TracedFrame, path: str, mode: Mode = Mode.CTE, materialize: bool = False, tables_path: str | None = None) -> str:
    """The pipeline up to ``frame`` as a SQL file, and beside it (``tables_path``) one that makes tables of its sources; returns the pipeline's text."""
    text = to_sql(frame, mode, materialize)
    for where, what in ((path, text), (tables_path, table_script(frame))):
        if where:
            with open(where, "w", encoding="utf-8") as f:
                f.write(what)
    return text


def run_timed(frame: TracedFrame, repetitions: int = 1) -> dict[str, float]:
    """Milliseconds that computing all visible columns takes: mean, variance and standard deviation. Nothing is kept."""
    took = []
    for _ in range(repetitions):
        began = time.perf_counter()
        frame.to_df().write.format("noop").mode("overwrite").save()
        took.append(1000 * (time.perf_counter() - began))
    return {"mean": statistics.fmean(took), "variance": statistics.pvariance(took), "std": statistics.pstdev(took)}
