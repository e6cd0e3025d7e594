"""The whole pipelines on made-up CSV files of the published schemas, plain and under inspection."""

import random

import pytest

import tracewell as tw
from tracewell.checks import CheckStatus
from tracewell.pipelines import incomes, incomes_with_imputation, recidivism, risks


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    r, d = random.Random(1), tmp_path_factory.mktemp("csv")

    def write(name, header, rows):
        (d / name).write_text("\n".join([header, *(",".join("" if v is None else str(v) for v in row) for row in rows)]) + "\n")
        return str(d / name)

    some = lambda v: v if r.random() > 0.1 else None
    people = [(i, f"f{i}", f"l{i % 9}", some(f"race{r.randint(1, 3)}"), some(f"county{r.randint(1, 3)}"), r.randint(1, 5), r.randint(10_000, 300_000), f"group{r.randint(1, 3)}", some(f"{i:03d}-00-0000")) for i in range(300)]
    out = {"patients": write("patients.csv", "id,first_name,last_name,race,county,num_children,income,age_group,ssn", people)}
    out["histories"] = write("histories.csv", "smoker,complications,ssn", [(some(r.choice(["True", "False"])), r.randint(0, 10), f"{i:03d}-00-0000") for i in range(40, 320)])
    case = lambda i: (i, r.choice(["Male", "Female"]), "1980-01-01", some(r.randint(18, 70)), r.choice("FMO"), r.choice(["A", "B"]), r.choice(["Low", "Medium", "High", "N/A"]), r.randint(0, 5), some(float(r.randint(-40, 40))), r.randint(1, 10), r.choice([-1, 0, 1]), r.randint(0, 1), "x", "y")
    header = ",sex,dob,age,c_charge_degree,race,score_text,priors_count,days_b_screening_arrest,decile_score,is_recid,two_year_recid,c_jail_in,c_jail_out"
    out |= {f"compas_{k}": write(f"compas_{k}.csv", header, map(case, range(n))) for k, n in (("train", 300), ("test", 100))}
    person = lambda i: (i, (age := r.randint(17, 80)), some(r.choice(["Private", "State-gov"])), r.choice(["HS-grad", "Masters"]), r.choice(["x", "y"]), r.randint(10, 60), ">50K" if age > 45 else "<=50K")
    out |= {f"adult_{k}": write(f"adult_{k}.csv", ",age,workclass,education,race,hours-per-week,income-per-year", map(person, range(n))) for k, n in (("train", 300), ("test", 100))}
    return out


def inspected(spark, run, sensitive):
    check = tw.NoBiasIntroducedFor(sensitive)
    return tw.PipelineInspector.on_pipeline(lambda s: run()).add_checks([check, tw.NoIllegalFeatures()]).execute(spark)


def test_risks(spark, files):
    r = inspected(spark, lambda: risks(files["patients"], files["histories"], word_vectors=True), ["age_group", "race"])
    assert 0.3 <= r.names["accuracy"] <= 1
    joins = [n for n in r.dag.nodes if n.function == "merge"]
    last = r.dag_node_to_inspection_results[[n for n in r.dag.nodes if n.function == "where"][-1]][tw.HistogramForColumns(["age_group", "race"])]
    assert len(joins) == 2 and set(last["age_group"]) == {"group1", "group2", "group3"}, "known though projected away"
    assert [c.details.get("illegal") for c in r.check_to_check_results.values()][1] == ["race"]
    data = r.names["data"]
    assert sorted(map(str, spark.sql(tw.plans.sqltext.to_sql(data)).collect())) == sorted(map(str, data.to_df().collect()))


def test_recidivism(spark, files):
    r = inspected(spark, lambda: recidivism(files["compas_train"], files["compas_test"]), ["sex", "race"])
    assert 0.3 <= r.names["accuracy"] <= 1 and r.names["data"].columns[0] == "sex"
    assert [c.status for c in r.check_to_check_results.values()][1] is CheckStatus.FAILURE, "age is a feature"


def test_incomes(spark, files):
    with tw.Session(spark).active():
        assert incomes(files["adult_train"])["accuracy"] > 0.95
        assert incomes_with_imputation(files["adult_train"], files["adult_test"])["accuracy"] > 0.9
