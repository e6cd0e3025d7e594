"""Order in both directions, the split in frame and SQL, statistics that are bounded, and how rows of files are numbered."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import tracewell as tw
from tracewell.inspections import FirstRows, HistogramForColumns
from tracewell.inspections import histogram as histogram_module
from tracewell.ml import Imputer, LogisticRegression, OneHot, WordVectors, train_test_split, transformers
from tracewell.plans.sqltext import table_script, to_sql
from tracewell.sources import write_sql


@pytest.fixture
def session(spark):
    with tw.Session(spark, rows=True).active() as s:
        yield s


def shown(frame):
    return [tuple(r) for r in frame.ordered().select(*frame.columns).collect()]


def by_sql(spark, frame):
    return [tuple(r) for r in spark.sql(to_sql(frame)).collect()]


def test_descending_order_and_limit(spark, session):
    f = tw.data_frame({"x": [3, 1, None, 9, 9, 4], "y": list("abcdef")})
    down = f.order_by("x", "y", ascending=[False, True])
    assert shown(down) == by_sql(spark, down) == [(9, "d"), (9, "e"), (4, "f"), (3, "a"), (1, "b"), (None, "c")]
    assert shown(down.limit(3)) == by_sql(spark, down.limit(3)) == [(9, "d"), (9, "e"), (4, "f")]
    assert [tuple(r) for r in down.limit(2).to_pandas().values.tolist()] == [(9, "d"), (9, "e")]
    up = f.order_by("x").limit(2)
    assert shown(up) == by_sql(spark, up) == [(None, "c"), (1, "b")]
    assert shown(down.select("y").limit(2)) == [("d",), ("e",)], "the order outlives its column"
    assert down.with_column("x", 0).order == [] and down.where(down["x"] > 1).order == down.order
    assert sorted(shown(down.merge(tw.data_frame({"y": ["a", "d"], "z": [1, 2]}), "y"))) == [(3, "a", 1), (9, "d", 2)]


def test_first_rows_of_a_descending_frame(spark):
    def run(session):
        return {"x": tw.data_frame({"x": list(range(10))}).order_by("x", ascending=False)}

    result = tw.PipelineInspector.on_pipeline(run).add_required_inspection(FirstRows(3)).execute(spark)
    assert [r["x"] for r in result.dag_node_to_inspection_results[result.dag.nodes[-1]][FirstRows(3)]] == [9, 8, 7]


@pytest.mark.parametrize("size", [0.25, 0.5, 0.99])
def test_split_is_the_same_by_sql(spark, session, size):
    f = tw.data_frame({"k": list(range(400)), "s": [f"v{i % 7}" if i % 5 else None for i in range(400)]})
    for key in (None, ["k"], ["s"]):
        train, test = train_test_split(f, size, seed=3, key=key)
        a, b = sorted(shown(train), key=repr), sorted(shown(test), key=repr)
        assert len(b) == -(-400 * size // 1) and sorted(a + b, key=repr) == sorted(shown(f), key=repr)
        if key != ["s"]:  # rows of one key are interchangeable
            assert sorted(by_sql(spark, train), key=repr) == a and sorted(by_sql(spark, test), key=repr) == b
    frozen = train_test_split(f, size, seed=3, key=["k"], freeze=True)
    assert sorted(shown(frozen[1]), key=repr) == sorted(shown(train_test_split(f, size, seed=3, key=["k"])[1]), key=repr)


def test_models_have_no_sql(session):
    f = tw.data_frame({"label": [0, 1] * 20, "a": [float(i) for i in range(40)], "w": ["x", "y"] * 20})
    f = f.with_column("features", tw.functions.Expr("array({})", f["a"]))
    made = LogisticRegression(max_iter=2).fit(f, "label").predict(f)
    with pytest.raises(ValueError, match="predict"):
        to_sql(made.select("prediction"))
    with pytest.raises(ValueError, match="WordVectors"):
        to_sql(WordVectors(2, 1).fit(f, "w").transform(f))


def test_decimal_statistics(spark, session):
    f = tw.untracked(spark.createDataFrame([(Decimal("1.50"),), (Decimal("2.25"),), (None,)], "d decimal(10,2)"))
    made = Imputer("mean").fit_transform(f, "d")
    assert dict(made.df.dtypes)["d"].startswith("decimal") and sorted(shown(made)) == [(Decimal("1.500000"),), (Decimal("1.875000"),), (Decimal("2.250000"),)]
    assert sorted(by_sql(spark, made)) == sorted(shown(made))


def test_bounded_statistics(spark, session, monkeypatch):
    monkeypatch.setattr(transformers, "MAX_CATEGORIES", 3)
    f = tw.data_frame({"a": list("aabbc"), "b": list("vwxyz"), "n": [1, 1, 2, 2, 3]})
    assert [r[0] for r in shown(OneHot().fit_transform(f, "a").select("a"))][0] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError, match="b has more than 3"):
        OneHot().fit(f, "a", "b")
    # Of equally frequent values the smallest; nulls do not count, whatever the type.
    g = tw.data_frame({"a": ["b", "a", "a", "b", None], "n": [None, 7, 7, 9, None]})
    assert shown(Imputer("most_frequent").fit_transform(g, "a", "n"))[4] == ("a", 7)
    empty = tw.untracked(spark.createDataFrame([], "a string"))
    assert shown(OneHot().fit_transform(empty, "a")) == [] and shown(Imputer("most_frequent").fit_transform(empty, "a")) == []


def test_histograms_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(histogram_module, "MAX_VALUES", 5)
    run = lambda session: {"x": tw.data_frame({"x": list(range(10))})}
    with pytest.raises(ValueError, match="more than 5 values"):
        tw.PipelineInspector.on_pipeline(run).add_required_inspection(HistogramForColumns(["x"])).execute(spark)


def test_rows_of_several_csv_files(spark, session, tmp_path):
    """Numbers follow files and places in them, however files are packed into tasks; no row goes through Python."""
    for name, rows in (("b.csv", range(100, 103)), ("a.csv", range(0, 50)), ("c.csv", range(200, 201))):
        (tmp_path / name).write_text("v\n" + "".join(f"{i}\n" for i in rows))
    f = tw.read_csv(str(tmp_path), schema="v long")
    assert shown(f) == [(i,) for i in [*range(50), *range(100, 103), 200]]
    hidden = f.hidden()[0]
    assert sorted(r[0] for r in f.df.select(hidden).collect()) == list(range(54))
    plan = f.df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Scan ExistingRDD" not in plan.replace("Scan ExistingRDD[__tw_file", "")
    g = tw.untracked(spark.range(1000).repartition(5).where(F.col("id") % 2 == 0))
    assert sorted(r[0] for r in g.df.select(g.hidden()[0]).collect()) == list(range(500))


def test_table_script(spark, session, tmp_path):
    (tmp_path / "a.csv").write_text("v,w\n1,x\n2,?\n")
    f = tw.read_csv(str(tmp_path / "a.csv"))
    g = f.where(f["v"] > 0).merge(tw.data_frame({"v": [2, 1]}), "v")
    text = write_sql(g, str(tmp_path / "p.sql"), tables_path=str(tmp_path / "t.sql"))
    script = (tmp_path / "t.sql").read_text()
    assert text == to_sql(g) and script == table_script(g) and script.count("CREATE TABLE") == 2
    for statement in script.rstrip(";").split(";\n"):
        spark.sql(statement.replace("CREATE TABLE IF NOT EXISTS", "CREATE OR REPLACE TEMPORARY VIEW"))
    assert spark.table(f._name()).count() == 2


def test_columns_of_another_frame(session):
    f, g = tw.data_frame({"a": [1, 2]}), tw.data_frame({"a": [3, 4]})
    for wrong in (lambda: f.with_column("b", g["a"] + 1), lambda: f.where((f["a"] > 0) & (g["a"] > 3))):
        with pytest.raises(ValueError, match="another frame"):
            wrong()
    kept = f.where(f["a"] > 0)
    assert shown(kept.with_column("b", f["a"] * kept["a"])) == [(1, 1), (2, 4)], "columns of what a frame was made from are its own"
    both = f.merge(g.with_column("k", g["a"] - 2).select("k"), how="cross")
    assert len(shown(both.where(f["a"] == both["k"]))) == 2
