"""Operators, inspections and checks on literal rows, with the results written out."""

import json

import pytest
from pyspark.sql import functions as F

import tracewell as tw
from tracewell.checks import CheckStatus
from tracewell.inspections import RandomNote
from tracewell.ml import ColumnTransformer, DecisionTree, Imputer, KBins, LogisticRegression, NeuralNetwork, OneHot, Scaler, WordVectors, label_binarize, train_test_split
from tracewell.plans.nodes import Op
from tracewell.plans.sqltext import Mode, to_sql
from tracewell.sources import run_timed, to_numpy, write_parquet, write_sql


@pytest.fixture
def session(spark):
    with tw.Session(spark, rows=True).active() as s:
        yield s


def rows(frame):
    return [tuple(r) for r in frame.ordered().select(*[f"`{c}`" for c in frame.columns]).collect()]


def same_by_sql(spark, frame):
    """The frame's SQL gives its rows, in both modes."""
    want = sorted(map(repr, rows(frame)))
    assert sorted(repr(tuple(r)) for r in spark.sql(to_sql(frame)).collect()) == want
    *views, last = to_sql(frame, Mode.VIEW, True).replace(";\n", ";;").split(";;")
    for v in views:
        spark.sql(v)
    assert sorted(repr(tuple(r)) for r in spark.sql(last).collect()) == want


def test_sources(session):
    assert rows(tw.data_frame([0, 1, 2], ["A"])) == [(0,), (1,), (2,)]
    assert rows(tw.series([0, 2, 4, None], "A")) == [(0,), (2,), (4,), (None,)]
    assert [n.op for n in session.dag.nodes] == [Op.SCAN] * 2
    assert tw.untracked(session.spark.range(3).toDF("a")).node.node_id == -1


def test_dropna(session):
    f = tw.data_frame({"A": [0.0, 2.0, float("nan"), 4.0, 5.0, None], "B": ["x"] * 5 + [None]})
    assert rows(f.dropna()) == [(0.0, "x"), (2.0, "x"), (4.0, "x"), (5.0, "x")]
    assert len(rows(f.dropna(how="all"))) == 5
    assert rows(f.dropna(thresh=1, subset=["B"]).select("B")) == [("x",)] * 5
    same_by_sql(session.spark, f.dropna())


def test_project_select_derive(session):
    f = tw.data_frame({"A": [0, 2, 4, 8, 5], "B": [1, 5, 4, 11, None]})
    assert rows(f.where(f["A"] > 3)) == [(4, 4), (8, 11), (5, None)]
    assert rows(f[["B"]]) == [(1,), (5,), (4,), (11,), (None,)]
    assert rows(f.with_column("C", (f["A"] + 1) * 2).select("C")) == [(2,), (6,), (10,), (18,), (12,)]
    assert rows(f.with_column("A", f["A"] - f["B"]).select("A")) == [(-1,), (-3,), (0,), (-3,), (None,)]
    assert rows(f.with_column("k", "it's").limit(1)) == [(0, 1, "it's")]
    assert rows(f.where(f["B"] != 5).select("B")) == [(1,), (4,), (11,)]
    assert rows(f.where(~f["B"].same_as(5)).select("B")) == [(1,), (4,), (11,), (None,)]
    assert rows(f.where(f["A"].isin([8, 5]) & ~(f["B"] > 100)).select("A")) == [(8,)]
    assert rows(f.with_column("q", 10 / (f["A"] - 2)).select("q")) == [(-5.0,), (None,), (5.0,), (pytest.approx(10 / 6),), (pytest.approx(10 / 3),)]
    assert rows(f.where(f["A"].isin([]))) == []
    for g in (f.where((f["A"] > 3) | (f["B"] < 2)), f.with_column("C", (1 - f["A"]) * f["B"]), f.with_column("A", 7)):
        same_by_sql(session.spark, g)
    with pytest.raises(KeyError):
        f.select("A").where(tw.col("B") > 1)


def test_replace(session):
    f = tw.data_frame({"A": ["Low", "Medium", "Low", "High", None, "Medium well"], "n": [1, 2, 3, 4, 5, 6]})
    assert rows(f.replace("Medium", "Low").select("A")) == [("Low",), ("Low",), ("Low",), ("High",), (None,), ("Medium well",)]
    assert rows(f.replace(2, 0).select("n")) == [(1,), (0,), (3,), (4,), (5,), (6,)]
    same_by_sql(session.spark, f.replace("Medium", "Low"))
    with pytest.raises(TypeError):
        f.replace({"a": "b"}, None)


LEFT, RIGHT = {"A": [0, 2, 4, 8, 5], "B": [1, 2, 4, 5, 7]}, {"B": [1, 2, 3, 4, 5], "C": [1, 5, 4, 11, None]}


def test_joins(session):
    a, b = tw.data_frame(LEFT), tw.data_frame(RIGHT)
    assert rows(a.merge(b, "B")) == [(0, 1, 1), (2, 2, 5), (4, 4, 11), (8, 5, None)]
    assert rows(a.merge(b, "B", "left"))[-1] == (5, 7, None)
    assert sorted(rows(a.merge(b, "B", "right")), key=lambda r: r[1])[2] == (None, 3, 4)
    assert {r[1] for r in rows(a.merge(b, "B", "outer"))} == {1, 2, 3, 4, 5, 7}
    assert len(rows(a.merge(b, how="cross"))) == 25
    assert a.merge(b, how="cross").columns == ["A", "B_x", "B_y", "C"]
    assert [r[1] for r in rows(a.merge(b, "B", sort=True))] == [1, 2, 4, 5]
    for how in ("inner", "left", "right", "outer"):
        same_by_sql(session.spark, a.merge(b, "B", how))
    two = tw.data_frame({"k": [1, 1, None], "l": ["a", "b", "c"], "v": [1, 2, 3]})
    assert len(rows(two.merge(two, ["k", "l"]))) == 2
    assert len(rows(two.merge(two, ["k", "l"], null_safe=True))) == 3
    assert two.merge(two, ["k", "l"]).columns == ["k", "l", "v_x", "v_y"]
    with pytest.raises(ValueError):
        a.merge(b)


def test_group(session):
    f = tw.data_frame({"group": ["A", "B", "A", "C", "B", None], "value": [1, 2, 1, 3, 4, 9]})
    assert rows(f.group_by("group", dropna=True).agg(mean_value=("value", "mean"))) == [("A", 1.0), ("B", 3.0), ("C", 3.0)]
    assert len(rows(f.group_by("group").agg(n=("value", "count")))) == 4
    assert rows(f.agg(s=("value", "sum"), m=("value", "max"), sd=("value", "std_pop")))[0][:2] == (20, 9)
    assert rows(f.distinct_values("group")) == [("A",), ("B",), ("C",)]
    same_by_sql(session.spark, f.group_by("group").agg(a=("value", "std"), b=("value", "nunique"), c=("value", "sum")))
    with pytest.raises(ValueError):
        f.group_by("group").agg(x=("value", "nonsense"))


def test_transformers(session):
    n = tw.data_frame({"A": [1, 2, 10, 5]})
    assert [r[0] for r in rows(Scaler().fit_transform(n, "A"))] == pytest.approx([-1, -0.71428571, 1.57142857, 0.14285714])
    assert [r[0] for r in rows(KBins(3).fit_transform(n, "A"))] == [0, 0, 2, 1]
    bins = KBins(3).fit(n, "A")
    assert [r[0] for r in rows(bins.transform(tw.data_frame({"A": [-5, 99, None]})))] == [0, 2, None]
    flat = tw.data_frame({"A": [3, 3]})
    assert [r[0] for r in rows(Scaler().fit_transform(flat, "A"))] == [0, 0]
    assert [r[0] for r in rows(KBins(3).fit_transform(flat, "A"))] == [0, 0]
    s = tw.data_frame({"A": ["cat_a", None, "cat_a", "cat_c"]})
    assert [r[0] for r in rows(Imputer("most_frequent").fit_transform(s, "A"))] == ["cat_a", "cat_a", "cat_a", "cat_c"]
    assert [r[0] for r in rows(Imputer().fit_transform(tw.data_frame({"A": [1.0, None, 3.0]}), "A"))] == [1.0, 2.0, 3.0]
    hot = OneHot().fit(tw.data_frame({"A": ["cat_a", "cat_b", "cat_a", "cat_c"]}), "A")
    assert [r[0] for r in rows(hot.transform(tw.data_frame({"A": ["cat_b", "cat_c", "other", None]})))] == [[0, 1, 0], [0, 0, 1], [0, 0, 0], [0, 0, 0]]
    with pytest.raises(Exception, match="unknown category"):
        rows(OneHot("error").fit(s, "A").transform(tw.data_frame({"A": ["zzz"]})))
    y = tw.data_frame({"A": ["yes", "no", "no", "yes", "?"]})
    assert [r[0] for r in rows(label_binarize(y, "A", ["no", "yes"]))] == [1, 0, 0, 1, None]
    for g in (Scaler().fit_transform(n, "A"), KBins(3).fit_transform(n, "A"), hot.transform(s), label_binarize(y, "A", ["no", "yes"])):
        same_by_sql(session.spark, g)


def test_column_transformer(session):
    f = tw.data_frame({"A": [1, 2, 10, 5], "B": ["cat_a", "cat_b", None, "cat_c"], "y": [0, 0, 1, 1]})
    t = ColumnTransformer([("n", Scaler(), ["A"]), ("c", [Imputer("most_frequent"), OneHot()], ["B"])]).fit(f)
    out = t.transform(f)
    assert [r[0] for r in rows(out.select("features"))] == [pytest.approx(v) for v in ([-1, 1, 0, 0], [-0.71428571, 0, 1, 0], [1.57142857, 1, 0, 0], [0.14285714, 0, 0, 1])]
    assert [n.op for n in session.dag.parents(out.node)] == [Op.ENCODE] * 2
    assert to_numpy(out.select("features", "y")).shape == (4, 5)
    same_by_sql(session.spark, out)


def test_split(session):
    f = tw.data_frame({"A": [1, 2, 10, 5]})
    train, test = train_test_split(f)
    assert (len(rows(train)), len(rows(test))) == (3, 1) and sorted(rows(train) + rows(test)) == [(1,), (2,), (5,), (10,)]
    many = tw.data_frame({"A": list(range(1001))})
    train, test = train_test_split(many, 0.3, seed=4)
    assert len(rows(test)) == 301 and len({*rows(train), *rows(test)}) == 1001
    copies = tw.data_frame({"A": [7] * 10})
    assert [len(rows(x)) for x in train_test_split(copies, 0.5, key=["A"])] == [5, 5]


@pytest.mark.parametrize("model", [DecisionTree(), LogisticRegression(), NeuralNetwork((4,), max_iter=200)])
def test_estimators(session, model):
    f = label_binarize(tw.data_frame({"A": [0, 1, 2, 3], "B": [0, 1, 2, 3], "target": ["no", "no", "yes", "yes"]}), "target", ["no", "yes"])
    t = ColumnTransformer([("n", Scaler(), ["A", "B"])]).fit(f)
    model.fit(t.transform(f), "target")
    assert model.score(t.transform(f)) == 1.0
    new = t.transform(tw.data_frame({"A": [-1.0, 4.0], "B": [-1.0, 4.0]}))
    assert [r[0] for r in rows(model.predict(new).select("prediction"))] == [0.0, 1.0]
    assert [n.op for n in session.dag.nodes].count(Op.FIT) == 1


def test_lineage_of_a_join(spark):
    r = tw.PipelineInspector.on_pipeline(lambda s: {"j": tw.data_frame(LEFT).merge(tw.data_frame(RIGHT), "B")}).add_required_inspection(tw.RowLineage(2)).execute(spark)
    join = r.dag.sinks()[0]
    found = r.dag_node_to_inspection_results[join][tw.RowLineage(2)]
    assert [{tuple(x) for x in row["lineage"]} for row in found] == [{(0, 0), (1, 0)}, {(0, 1), (1, 1)}]


CATS = "import tracewell as tw\na = tw.data_frame({'A': ['cat_a', 'cat_b', 'cat_a', 'cat_c', 'cat_b'], 'B': [1, 2, 4, 5, 7]})\n"


def test_histograms_and_bias_of_a_join(spark):
    source = CATS + "b = tw.data_frame({'B': [1, 2, 3, 4, 5], 'C': [1, 5, 4, 11, None]})\nj = a.merge(b, on='B')\n"
    r = tw.PipelineInspector.on_pipeline_from_string(source).add_check(tw.NoBiasIntroducedFor(["A"])).execute(spark)
    h = [x[tw.HistogramForColumns(["A"])]["A"] for x in r.dag_node_to_inspection_results.values()]
    assert h == [{"cat_a": 2, "cat_b": 2, "cat_c": 1}, {}, {"cat_a": 2, "cat_b": 1, "cat_c": 1}]
    (result,) = r.check_to_check_results.values()
    assert result.status is CheckStatus.FAILURE
    (change,) = result.details["changes"]
    assert change.least == pytest.approx(-0.375)
    assert [c[3:5] for c in change.rows] == [(0.4, 0.5), (0.4, 0.25), (0.2, 0.25)]
    assert r.dag.sinks()[0].location.line == 4 and r.dag.sinks()[0].location.source() == "j = a.merge(b, on='B')"
    assert tw.NoBiasIntroducedFor.overview(spark, result).count() == 1
    assert tw.PipelineInspector.check_results_as_data_frame(spark, r.check_to_check_results).first()["status"] == "Failure"


def test_histogram_of_a_column_projected_away(spark):
    source = CATS + "p = a.select('B')\nq = p.where(p['B'] > 1)\n"
    for materialize in (False, True):
        r = tw.PipelineInspector.on_pipeline_from_string(source).add_required_inspection(tw.HistogramForColumns(["A", "B"])).execute(spark, materialize)
        h = [x[tw.HistogramForColumns(["A", "B"])]["A"] for x in r.dag_node_to_inspection_results.values()]
        assert h == [{"cat_a": 2, "cat_b": 2, "cat_c": 1}] * 2 + [{"cat_a": 1, "cat_b": 2, "cat_c": 1}]


def test_bias_of_an_imputation(spark):
    def run(session):
        return {"x": Imputer("most_frequent").fit_transform(tw.data_frame({"A": ["cat_a", None, "cat_a", "cat_c"]}), "A")}

    r = tw.PipelineInspector.on_pipeline(run).add_check(tw.NoBiasIntroducedFor(["A"])).execute(spark)
    (result,) = r.check_to_check_results.values()
    assert result.status is CheckStatus.SUCCESS
    assert [x[:5] for x in result.details["changes"][0].rows] == [("cat_a", 2, 3, 0.5, 0.75), ("cat_c", 1, 1, 0.25, 0.25), (None, 1, 0, 0.25, 0.0)]


def test_illegal_features(spark):
    def run(session):
        f = tw.data_frame({"age": [1, 2, 10, 5], "B": ["cat_a", "cat_b", "cat_a", "cat_c"], "C": ["cat_a", "cat_b", "cat_a", "cat_c"], "target": [0, 0, 1, 1]})
        t = ColumnTransformer([("n", Scaler(), ["age"]), ("c", OneHot(), ["B", "C"])])
        DecisionTree().fit(t.fit_transform(f), "target")

    r = tw.PipelineInspector.on_pipeline(run).add_checks([tw.NoIllegalFeatures(["C"]), tw.NoIllegalFeatures()]).execute(spark)
    assert [x.details["illegal"] for x in r.check_to_check_results.values()] == [["C", "age"], ["age"]]
    assert "digraph" in r.dag.to_dot()


def test_missing_embeddings(spark):
    def run(session):
        f = tw.data_frame({"w": ["a", "a", "a", "b", "b", "rare", None]})
        WordVectors(4, 2).fit(f, "w").transform(f)

    r = tw.PipelineInspector.on_pipeline(run).add_check(tw.NoMissingEmbeddings()).execute(spark)
    (result,) = r.check_to_check_results.values()
    (found,) = result.details["missing"].values()
    assert found["missing"] == 2 and set(found["examples"]) == {"rare", None}


def test_what_is_carried_along_comes_out(spark):
    def run(session):
        f = tw.data_frame({"A": [0, 2, 4, 8, 5]})
        return {"g": f.where(f["A"] > 3)}

    r = tw.PipelineInspector.on_pipeline(run).add_required_inspection(RandomNote()).execute(spark)
    before, after = (x[RandomNote()] for x in r.dag_node_to_inspection_results.values())
    assert after == before[2:]


def test_files(spark, tmp_path, session):
    (tmp_path / "x.csv").write_text("i,a,b\n3,x,?\n1,,2\n2,y,3\n")
    f = tw.read_csv(str(tmp_path / "x.csv"), index_col=0)
    assert rows(f) == [(None, 2), ("y", 3), ("x", None)]
    write_parquet(f, str(tmp_path / "p"))
    spark.range(5).repartition(3).write.parquet(str(tmp_path / "q"))
    q = tw.read_parquet(str(tmp_path / "q"))
    assert len({r["__tw_row_1"] for r in q.df.collect()}) == 5
    assert write_sql(f.select("a"), str(tmp_path / "x.sql")).startswith("WITH")
    assert run_timed(f)["mean"] > 0


def test_sources_of_code(spark, tmp_path):
    source = "import tracewell as tw\n\nf = tw.data_frame({'A': [1, 2]})\ng = f.where(f['A'] > 1)\n"
    (tmp_path / "p.py").write_text(source)
    cells = [{"cell_type": "markdown", "source": ["no"]}, {"cell_type": "code", "source": ["%matplotlib inline\n", *source.splitlines(keepends=True)]}]
    (tmp_path / "p.ipynb").write_text(json.dumps({"cells": cells}))
    ways = [tw.PipelineInspector.on_pipeline_from_string(source), tw.PipelineInspector.on_pipeline_from_py_file(str(tmp_path / "p.py")), tw.PipelineInspector.on_pipeline_from_ipynb_file(str(tmp_path / "p.ipynb"))]
    found = [w.execute(spark).dag for w in ways]
    assert len({str([(n.description, n.columns) for n in d.nodes]) for d in found}) == 1
    assert [r[0] for r in spark.sql(ways[0].translate(spark)[0]).collect()] == [2]
    result = ways[0].execute_in_sql(spark, "VIEW", True)
    assert result.sql[0].startswith("CREATE OR REPLACE TEMPORARY VIEW")
    with pytest.raises(ValueError):
        ways[0].execute_in_sql(spark, "CTE", True)


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.col("id").alias("x"), F.lit("s").alias("y")).write.parquet(str(tmp_path / "t"))
    with tw.Session(spark).active():
        f = tw.read_parquet(str(tmp_path / "t"))
        plan = f.where(f["id"] > 3).select("id").to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "ReadSchema: struct<id:bigint>" in plan
