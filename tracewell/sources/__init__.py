"""Where frames come from and where they go."""

from tracewell.sources.readers import data_frame, read_csv, read_parquet, series, untracked
from tracewell.sources.sinks import run_timed, to_numpy, write_parquet, write_sql

__all__ = ["data_frame", "read_csv", "read_parquet", "run_timed", "series", "to_numpy", "untracked", "write_parquet", "write_sql"]
