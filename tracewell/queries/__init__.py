"""The query catalogue: every operator as a query over the test tables, with its SQL."""

from tracewell.queries.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
