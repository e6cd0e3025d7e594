"""Running a pipeline with inspections and checks."""

from __future__ import annotations

import json
import linecache
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tracewell.checks.base import Check, CheckResult, CheckStatus
from tracewell.inspections.base import Inspection
from tracewell.operators.frame import TracedFrame
from tracewell.plans.dag import Dag
from tracewell.plans.session import Session
from tracewell.plans.sqltext import Mode, to_sql


@dataclass
class InspectorResult:
    """The graph, {node: {inspection: result}}, {check: result}, the SQL of what the pipeline ends in, and the script's names."""

    dag: Dag
    dag_node_to_inspection_results: dict
    check_to_check_results: dict[Check, CheckResult]
    sql: list[str] = field(default_factory=list)
    names: dict = field(default_factory=dict)


class PipelineInspector:
    """Builds up what to inspect and check, then runs the pipeline: a script against this package's API, or a function of a session."""

    def __init__(self, run: Callable[[Session], dict | None]):
        self._run, self._inspections, self._checks, self._locations = run, [], [], True

    @staticmethod
    def _of_source(source: str, name: str) -> PipelineInspector:
        def run(session: Session) -> dict:
            linecache.cache[name] = (len(source), None, source.splitlines(keepends=True), name)
            names = {"__name__": "__main__", "spark": session.spark}
            exec(compile(source, name, "exec"), names)  # noqa: S102  the user's own pipeline
            return names

        return PipelineInspector(run)

    @staticmethod
    def on_pipeline_from_py_file(path: str) -> PipelineInspector:
        return PipelineInspector._of_source(Path(path).read_text(encoding="utf-8"), str(path))

    @staticmethod
    def on_pipeline_from_ipynb_file(path: str) -> PipelineInspector:
        """A notebook's code cells in order, without lines that are not Python (magics and shell commands)."""
        cells = [c for c in json.loads(Path(path).read_text(encoding="utf-8"))["cells"] if c["cell_type"] == "code"]
        lines = "\n".join("".join(c["source"]) for c in cells).splitlines()
        return PipelineInspector._of_source("\n".join("" if x.lstrip()[:1] in ("%", "!") else x for x in lines), str(path))

    @staticmethod
    def on_pipeline_from_string(source: str) -> PipelineInspector:
        return PipelineInspector._of_source(source, "<pipeline>")

    @staticmethod
    def on_pipeline(run: Callable[[Session], dict | None]) -> PipelineInspector:
        return PipelineInspector(run)

    def add_required_inspection(self, inspection: Inspection) -> PipelineInspector:
        self._inspections.append(inspection)
        return self

    def add_required_inspections(self, inspections) -> PipelineInspector:
        self._inspections += inspections
        return self

    def add_check(self, check: Check) -> PipelineInspector:
        self._checks.append(check)
        return self

    def add_checks(self, checks) -> PipelineInspector:
        self._checks += checks
        return self

    def set_code_reference_tracking(self, on: bool) -> PipelineInspector:
        self._locations = on
        return self

    def _session(self, spark: SparkSession, inspections: list[Inspection]) -> Session:
        sensitive = tuple(dict.fromkeys(c for i in inspections for c in i.sensitive))
        notes = {k: v for i in inspections for k, v in i.notes().items()}
        return Session(spark, sensitive, any(i.rows for i in inspections), self._locations, notes)

    def execute(self, spark: SparkSession, materialize: bool = False) -> InspectorResult:
        """Runs the pipeline, then the inspections operator by operator, then the checks.

        Nothing of the pipeline itself is computed before something asks for it. With ``materialize`` the frames that
        several operators read are persisted while inspections run; results are the same either way.
        """
        checks = list(dict.fromkeys(self._checks))
        inspections = list(dict.fromkeys([*self._inspections, *(i for c in checks for i in c.required_inspections)]))
        session = self._session(spark, inspections)
        with session.active():
            names = self._run(session) or {}
        shared = [session.frames[n].df for n in session.dag.nodes if n in session.frames and len(session.dag.children(n)) > 1] if materialize else []
        for df in shared:
            df.persist()
        try:
            visited = {i: i.visit_all(session.dag, session.frames) for i in inspections}
        finally:
            for df in shared:
                df.unpersist()
        results = {n: {i: visited[i][n] for i in inspections} for n in session.dag.nodes}
        return InspectorResult(session.dag, results, {c: c.evaluate(session.dag, results) for c in checks}, [], names)

    def execute_in_sql(self, spark: SparkSession, mode: Mode | str = Mode.CTE, materialize: bool = False) -> InspectorResult:
        """As ``execute``, and the SQL of every relation that nothing else reads."""
        mode = Mode(mode)
        if mode is Mode.CTE and materialize:
            raise ValueError("common table expressions cannot be materialised")
        result = self.execute(spark, materialize)
        result.sql = self._texts(result.names, mode, materialize)
        return result

    def translate(self, spark: SparkSession, mode: Mode | str = Mode.CTE) -> list[str]:
        """Only the SQL: no inspection, no check, no job."""
        session = self._session(spark, [])
        with session.active():
            names = self._run(session) or {}
        return self._texts(names, Mode(mode), False)

    @staticmethod
    def _texts(names: dict, mode: Mode, materialize: bool) -> list[str]:
        frames = {v.node: v for v in names.values() if isinstance(v, TracedFrame)}
        return [to_sql(f, mode, materialize) for n, f in frames.items() if not any(c in frames for c in f.session.dag.children(n))]

    @staticmethod
    def check_results_as_data_frame(spark: SparkSession, results: dict[Check, CheckResult]) -> DataFrame:
        rows = [(type(c).__name__, r.status.value, r.description) for c, r in results.items()]
        return spark.createDataFrame(rows, "check string, status string, description string")


def failed(result: InspectorResult) -> list[CheckResult]:
    """The checks that did not succeed."""
    return [r for r in result.check_to_check_results.values() if r.status is not CheckStatus.SUCCESS]
