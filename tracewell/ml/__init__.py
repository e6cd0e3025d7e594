"""Preprocessing that is fitted by aggregates and applied as expressions, and estimators."""

from tracewell.ml.estimators import DecisionTree, LogisticRegression, NeuralNetwork, WordVectors
from tracewell.ml.split import train_test_split
from tracewell.ml.transformers import ColumnTransformer, Imputer, KBins, OneHot, Scaler, label_binarize

__all__ = ["ColumnTransformer", "DecisionTree", "Imputer", "KBins", "LogisticRegression", "NeuralNetwork", "OneHot", "Scaler", "WordVectors", "label_binarize", "train_test_split"]
