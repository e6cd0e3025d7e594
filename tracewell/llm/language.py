"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and ASCII other than letters becomes a space; runs of one to three characters are hashed into
``DIM`` features, counted over the whole text, damped by a logarithm, weighted by inverse document frequency and
scaled to length one. The weights are learned by follow-the-regularised-leader with elastic-net penalties: the L1 part
leaves most of them exactly zero, and only the others travel to the executors. A temperature fitted on documents that the
weights have not seen turns scores into probabilities.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import held_out_mod
from tracewell.llm.learning import SAMPLE_ROWS, folds, texts_of, thinned

DIM, N = 1 << 15, 3
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3
#: Characters counted at a time; the last N - 1 of a piece are read again with the next, so no n-gram is lost.
PIECE = 1 << 18
#: Letters, and numerals that are neither letters nor decimal digits.
LETTER = re.compile(r"[^\W\d_]")
ASCII = np.arange(128, dtype=np.uint32)
ASCII[[i for i in range(128) if not chr(i).isalpha()]] = 32


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a text and how often each occurs."""
    total = None
    low = text.lower()
    for at in range(0, max(1, len(low)), PIECE):
        a = np.frombuffer(low[at : at + PIECE + N - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        a = np.where(a < 128, ASCII[np.minimum(a, 127)], a)
        h, own = a, []
        for n in range(1, N + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x9E3779B1) + a[n - 1 :]
            own.append(((h[:PIECE] if at + PIECE < len(low) else h) * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(17))
        c = np.bincount(np.concatenate(own), minlength=DIM)
        total = c if total is None else total + c
    at = np.flatnonzero(total)
    return at, total[at]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class LanguageModel:
    """``languages``, feature weights for the features that have any, and the temperature."""

    def __init__(self, languages: list[str]):
        self.languages, self.temperature = languages, 1.0

    def vector(self, at: np.ndarray, c: np.ndarray) -> np.ndarray:
        x = np.log1p(c) * self.idf[at]
        return x / max(1e-12, np.sqrt(x @ x))

    def fit(self, sparse: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seen: np.ndarray, n_docs: int, seed: int = 3) -> LanguageModel:
        """Learns from features and counts of documents and the number of each one's language. ``seen``: how many of ``n_docs`` documents have a feature."""
        k = len(self.languages)
        self.idf = np.log((1 + n_docs) / (1 + seen)) + 1
        rows = [(at, self.vector(at, c)) for at, c in sparse]
        order = folds(len(rows), seed)
        held, train = order[: len(order) // 5], order[len(order) // 5 :]
        z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

        def weights(at):
            w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
            w[np.abs(z[at]) <= L1] = 0
            return w

        for epoch in range(EPOCHS):
            for i in train[folds(len(train), seed + epoch)]:
                at, v = np.append(rows[i][0], DIM), np.append(rows[i][1], 1.0)  # the last feature is the intercept
                w = weights(at)
                p = softmax(v @ w)
                p[y[i]] -= 1
                g = np.outer(v, p)
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
                n[at] += g * g
        w = weights(np.arange(DIM + 1))
        # Row 0 of the kept weights is zero and stands for every feature without weight.
        kept = np.flatnonzero(np.any(w[:DIM] != 0, axis=1))
        self.row = np.zeros(DIM, dtype=np.int32)
        self.row[kept] = np.arange(1, len(kept) + 1)
        self.weights, self.intercept = np.vstack([np.zeros((1, k)), w[kept]]), w[DIM]
        scores = np.array([v @ self.weights[self.row[at]] + self.intercept for at, v in (rows[i] for i in held)]) if len(held) else np.zeros((0, k))
        if len(scores):
            grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
            loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ``und`` and 0 if there is no letter or no language was learned."""
        if not text or not self.languages or not any(m[0].isalpha() for m in LETTER.finditer(text)):
            return "und", 0.0
        at, c = counts(text)
        p = softmax((self.vector(at, c) @ self.weights[self.row[at]] + self.intercept) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, at, n) of ``docs`` (doc_id, lang, text): the features of every whole text and their counts."""

    def run(batches):
        for b in batches:
            each = [counts(t.as_py()) for t in b.column(2)]
            made = [pa.array([x[i] for x in each], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["doc_id", "lang", "at", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, "doc_id long, lang string, at array<int>, n array<int>")


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(how many of ``texts`` (text) have each feature, how many texts there are): every task adds up its own, at most ``DIM`` numbers."""

    def run(batches):
        seen, n = np.zeros(DIM + 1, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                seen[counts(t.as_py())[0]] += 1
            n += b.num_rows
        seen[DIM] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["at", "n"])

    out = np.zeros(DIM + 1)
    for r in texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out[:DIM], int(out[DIM])


def fit(docs: DataFrame, n: int = SAMPLE_ROWS) -> LanguageModel:
    """A model fitted on about ``n`` documents with text, language and id outside the held-out fifth, with document frequencies of all such documents."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out_mod(F.col("doc_id"), 5) != 0)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    marks = usable.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    rows = features(texts_of(usable, thinned(marks, "lang", n, 11))).collect()
    rows.sort(key=lambda r: r["doc_id"])
    languages = sorted({r["lang"] for r in rows})
    place = {x: i for i, x in enumerate(languages)}
    model = LanguageModel(languages)
    if not rows:
        return model
    sparse = [(np.array(r["at"], dtype=np.int64), np.array(r["n"], dtype=np.int64)) for r in rows]
    return model.fit(sparse, np.array([place[r["lang"]] for r in rows]), *document_frequencies(usable))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (in the place of columns of those names) from every whole text."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    made = docs.select(F.struct("*").alias("row"), run("text").alias("made"))
    return made.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], "made.lang_pred", "made.score")


def op8_language(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = predict(docs.select("doc_id", "text"), fit(docs))
    return rows.select("doc_id", (held_out_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
