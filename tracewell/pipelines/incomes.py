"""Whose income is above a threshold."""

from __future__ import annotations

from tracewell.ml import ColumnTransformer, DecisionTree, Imputer, OneHot, Scaler, label_binarize
from tracewell.sources import read_csv

CLASSES = [">50K", "<=50K"]
GROUPS, NUMBERS = ["education", "workclass"], ["age", "hours-per-week"]


def _read(path: str):
    return read_csv(path, na_values="", index_col=0)


def incomes(train_csv: str) -> dict:
    """Rows with missing values are dropped; the tree is scored on the rows it was trained on."""
    data = label_binarize(_read(train_csv).dropna(), "income-per-year", CLASSES)
    features = ColumnTransformer([("groups", OneHot(), GROUPS), ("numbers", Scaler(), NUMBERS)]).fit_transform(data)
    return {"data": data, "accuracy": DecisionTree().fit(features, "income-per-year").score(features)}


def incomes_with_imputation(train_csv: str, test_csv: str) -> dict:
    """Missing groups are filled with the most frequent one; the tree is scored on other rows, by what training found."""
    train, test = (label_binarize(_read(path), "income-per-year", CLASSES) for path in (train_csv, test_csv))
    chain = ColumnTransformer([("groups", [Imputer("most_frequent"), OneHot()], GROUPS), ("numbers", Scaler(), NUMBERS)]).fit(train)
    return {"data": train, "accuracy": DecisionTree().fit(chain.transform(train), "income-per-year").score(chain.transform(test))}
