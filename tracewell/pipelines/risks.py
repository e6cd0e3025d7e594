"""Which patients are at a higher risk of complications."""

from __future__ import annotations

from tracewell.ml import ColumnTransformer, Imputer, NeuralNetwork, OneHot, Scaler, WordVectors, train_test_split
from tracewell.sources import read_csv

#: The counties whose patients are looked at.
COUNTIES = ("county2", "county3")
USED = ("smoker", "last_name", "county", "num_children", "race", "income", "label")


def prepared(patients_csv: str, histories_csv: str):
    """Patients with their histories, labelled by whether they had clearly more complications than their age group on average."""
    people = read_csv(patients_csv, na_values="").merge(read_csv(histories_csv, na_values=""), on="ssn")
    average = people.group_by("age_group").agg(mean_complications=("complications", "mean"))
    people = people.merge(average, on="age_group")
    people = people.with_column("label", people["complications"] > 1.2 * people["mean_complications"])
    return people.where_select(people["county"].isin(COUNTIES), *USED)


def risks(patients_csv: str, histories_csv: str, word_vectors: bool = False, seed: int = 0) -> dict:
    """Trains a network on three quarters of the patients and scores it on the others."""
    people = prepared(patients_csv, histories_csv)
    people = people.with_column("label", people["label"].when_else(1, 0))
    train, test = train_test_split(people, seed=seed)
    if word_vectors:
        names = WordVectors(min_count=2).fit(train, "last_name")
        train, test = names.transform(train), names.transform(test)
    features = ColumnTransformer([("groups", [Imputer("most_frequent"), OneHot()], ["smoker", "county", "race"]), ("numbers", Scaler(), ["num_children", "income"])]).fit(train)
    model = NeuralNetwork((9, 9), max_iter=50, seed=seed).fit(features.transform(train), "label")
    return {"data": people, "accuracy": model.score(features.transform(test))}
