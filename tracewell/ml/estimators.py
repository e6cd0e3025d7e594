"""Classifiers of ``pyspark.ml`` on an array of features, and word vectors."""

from __future__ import annotations

from pyspark.ml import classification
from pyspark.ml import feature as ml_feature
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tracewell.operators.frame import TracedFrame, quoted
from tracewell.plans.nodes import Op
from tracewell.plans.session import HIDDEN

VECTOR, LABEL = f"{HIDDEN}vector", f"{HIDDEN}label"


class Classifier:
    """Fits on the frame's own partitions; no rows go to the driver. Three nodes are recorded: the data, the labels, the estimator."""

    def _estimator(self, width: int, rows: int):
        raise NotImplementedError

    def fit(self, frame: TracedFrame, label: str, features: str = "features") -> Classifier:
        frame._known([label, features])
        data = frame._next(Op.EXAMPLES, "fit", f"{features} to learn from", frame.df, [features], f"SELECT {quoted(features)} FROM {frame._name()}")
        labels = frame._next(Op.TARGETS, "fit", f"{label} to learn", frame.df, [label], f"SELECT {quoted(label)} FROM {frame._name()}")
        frame.session.record(Op.FIT, "fit", type(self).__name__, [], (data.node, labels.node))
        rows = self._rows(frame, label, features).persist()
        try:
            width, n = rows.select(F.max(F.size(vector_to_array(VECTOR))), F.count("*")).first()
            self.model = self._estimator(width or 0, n).setFeaturesCol(VECTOR).setLabelCol(LABEL).fit(rows)
        finally:
            rows.unpersist()
        self.label, self.features = label, features
        return self

    @staticmethod
    def _rows(frame: TracedFrame, label: str, features: str):
        return frame.df.select(array_to_vector(features).alias(VECTOR), F.col(quoted(label)).cast("double").alias(LABEL))

    def predict(self, frame: TracedFrame) -> TracedFrame:
        """``frame`` with ``prediction``."""
        df = self.model.transform(frame.df.withColumn(VECTOR, array_to_vector(self.features)))
        keep = [c for c in frame.df.columns if c != "prediction"]
        visible = [*[c for c in frame.columns if c != "prediction"], "prediction"]
        return frame._next(Op.PREDICT, "predict", type(self).__name__, df.select(*map(quoted, keep), "prediction"), visible, None)

    def score(self, frame: TracedFrame) -> float:
        """Share of rows whose label is predicted."""
        made = self.model.transform(self._rows(frame, self.label, self.features))
        return made.select(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]


class DecisionTree(Classifier):
    def __init__(self, max_depth: int = 5, seed: int = 0):
        self.max_depth, self.seed = max_depth, seed

    def _estimator(self, width, rows):
        return classification.DecisionTreeClassifier(maxDepth=self.max_depth, seed=self.seed)


class LogisticRegression(Classifier):
    """``c`` is the inverse strength of the L2 penalty on the sum of losses."""

    def __init__(self, c: float = 1.0, max_iter: int = 100):
        self.c, self.max_iter = c, max_iter

    def _estimator(self, width, rows):
        return classification.LogisticRegression(regParam=1.0 / (self.c * max(1, rows)), maxIter=self.max_iter, standardization=False)


class NeuralNetwork(Classifier):
    """Hidden layers with sigmoid units and a softmax on top."""

    def __init__(self, hidden: tuple[int, ...] = (9, 9), classes: int = 2, max_iter: int = 100, seed: int = 0):
        self.hidden, self.classes, self.max_iter, self.seed = hidden, classes, max_iter, seed

    def _estimator(self, width, rows):
        return classification.MultilayerPerceptronClassifier(layers=[width, *self.hidden, self.classes], maxIter=self.max_iter, seed=self.seed)


class WordVectors:
    """A vector for every word of a column; words seen less than ``min_count`` times have only zeros."""

    def __init__(self, size: int = 10, min_count: int = 2, seed: int = 0):
        self.size, self.min_count, self.seed = size, min_count, seed

    def fit(self, frame: TracedFrame, column: str) -> WordVectors:
        frame._known([column])
        words = frame.df.where(F.col(quoted(column)).isNotNull()).select(F.array(F.col(quoted(column)).cast("string")).alias("words"))
        self.column = column
        self.model = ml_feature.Word2Vec(vectorSize=self.size, minCount=self.min_count, seed=self.seed, inputCol="words", outputCol="vector").fit(words)
        return self

    def transform(self, frame: TracedFrame) -> TracedFrame:
        df = self.model.setInputCol(f"{HIDDEN}words").setOutputCol(VECTOR).transform(frame.df.withColumn(f"{HIDDEN}words", F.array(F.coalesce(F.col(quoted(self.column)).cast("string"), F.lit("")))))
        df = df.withColumn(f"{HIDDEN}word", F.col(quoted(self.column))).withColumn(self.column, vector_to_array(VECTOR)).drop(VECTOR, f"{HIDDEN}words")
        return frame._next(Op.ENCODE, "WordVectors", f"WordVectors of {self.column}", df, frame.columns, None, changed=[self.column])
