"""Which defendants are given a high risk score."""

from __future__ import annotations

from tracewell.ml import ColumnTransformer, Imputer, KBins, LogisticRegression, OneHot, label_binarize
from tracewell.sources import read_csv

#: The published file's columns that the pipeline uses.
USED = ("sex", "dob", "age", "c_charge_degree", "race", "score_text", "priors_count", "days_b_screening_arrest", "decile_score", "is_recid", "two_year_recid", "c_jail_in", "c_jail_out")


def labelled(frame):
    """Medium scores count as low ones; high is 0, low is 1."""
    return label_binarize(frame.replace("Medium", "Low"), "score_text", ["High", "Low"])


def training_rows(frame):
    """Cases screened within a month of the arrest, with a known outcome, a charge and a score."""
    days = frame["days_b_screening_arrest"]
    return frame.where((days >= -30) & (days <= 30) & (frame["is_recid"] != -1) & (frame["c_charge_degree"] != "O") & (frame["score_text"] != "N/A"))


def recidivism(train_csv: str, test_csv: str) -> dict:
    """Trains a logistic regression on the training file and scores it on the rows of the other that have a score."""
    train, test = (read_csv(path, na_values="", index_col=0).select(*USED) for path in (train_csv, test_csv))
    train, test = labelled(training_rows(train)), labelled(test)
    features = ColumnTransformer([("outcome", [Imputer("most_frequent"), OneHot()], ["is_recid"]), ("age", [Imputer("mean"), KBins(4)], ["age"])]).fit(train)
    model = LogisticRegression().fit(features.transform(train), "score_text")
    return {"data": train, "accuracy": model.score(features.transform(test.dropna(subset=["score_text"])))}
