"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded and convolved with learned filters of ``WIDTH`` bytes; in overlapping chunks that cover the whole
text each filter's largest response is kept, and the mean and the largest of these over the chunks go, with the text's length,
through a small hidden layer to one probability. A filter's response is a sum of one row per place from tables of
256 rows (embedding times filter), so no window is ever copied.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import held_out_mod
from tracewell.llm.learning import SAMPLE_ROWS, folds, labelled, sigmoid

WIDTH, EMBED, FILTERS, HIDDEN = 8, 8, 24, 16
CHUNK, HOP = 512, 384
#: Positions convolved at a time.
BLOCK = 1 << 14
EPOCHS, BATCH, RATE = 12, 32, 4e-3


def as_bytes(text: str | None) -> np.ndarray:
    """A text's UTF-8 bytes, with zeros after a text shorter than a filter."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(data + b"\0" * max(0, WIDTH - len(data)), dtype=np.uint8)


def chunk_bounds(positions: int) -> np.ndarray:
    """(starts, ends) of chunks of filter positions; each overlaps the next, and the last one ends at the end."""
    starts = np.arange(0, max(1, positions - (CHUNK - HOP)), HOP)
    return np.column_stack([starts, np.minimum(starts + CHUNK, positions)])


class ByteNetwork:
    """The network's parameters; plain arrays, so that it travels in a task's closure (under 100 KB)."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)), "filters": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)), "shift": np.zeros(FILTERS),
            "hidden": r.normal(0, (2 * FILTERS + 1) ** -0.5, (2 * FILTERS + 1, HIDDEN)), "hidden_shift": np.zeros(HIDDEN), "out": r.normal(0, HIDDEN**-0.5, HIDDEN), "out_shift": np.zeros(1),
        }
        self.tables()

    def tables(self) -> None:
        self.t = (self.p["embed"] @ self.p["filters"]).astype(np.float32)  # WIDTH, 256, FILTERS

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Responses of all filters at all positions of ``data``."""
        n = len(data) - WIDTH + 1
        out = np.take(self.t[0], data[:n], axis=0)
        part = np.empty_like(out)
        for k in range(1, WIDTH):
            out += np.take(self.t[k], data[k : k + n], axis=0, out=part, mode="clip")
        return out

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """Largest responses by chunk; blocks of whole chunks at a time, so memory does not follow the text."""
        bounds = chunk_bounds(len(data) - WIDTH + 1)
        rows, each = [], max(1, BLOCK // HOP)
        for i in range(0, len(bounds), each):
            b = bounds[i : i + each]
            low = b[0, 0]
            r = self.responses(data[low : b[-1, 1] + WIDTH - 1])
            edges = (b - low).ravel()
            if edges[-1] == len(r):
                edges = edges[:-1]
            rows.append(np.maximum.reduceat(r, edges, axis=0)[::2])
        return np.concatenate(rows)

    def head(self, mean: np.ndarray, most: np.ndarray, size: np.ndarray):
        x = np.column_stack([mean, most, np.log1p(size) / 10])
        h = np.tanh(x @ self.p["hidden"] + self.p["hidden_shift"])
        return x, h, h @ self.p["out"] + self.p["out_shift"][0]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts) -> list[float]:
        """The probability of each text. Short texts are laid end to end and convolved together; a long one goes in blocks of its own."""
        means, mosts, sizes = [], [], []
        held: list[np.ndarray] = []

        def together() -> None:
            if not held:
                return
            starts = np.cumsum([0, *(len(d) for d in held[:-1])])
            bounds = [chunk_bounds(len(d) - WIDTH + 1) for d in held]
            edges = np.concatenate([b + s for b, s in zip(bounds, starts, strict=True)]).ravel()
            r = self.responses(np.concatenate(held))
            top = np.maximum(np.maximum.reduceat(r, edges[:-1] if edges[-1] == len(r) else edges, axis=0)[::2] + self.p["shift"], 0)
            firsts = np.cumsum([0, *(len(b) for b in bounds[:-1])])
            means.append(np.add.reduceat(top, firsts, axis=0) / np.array([len(b) for b in bounds])[:, None])
            mosts.append(np.maximum.reduceat(top, firsts, axis=0))
            held.clear()

        room = BLOCK
        for text in texts:
            data = as_bytes(text)
            sizes.append(len(data))
            if len(data) > room:
                together()
                room = BLOCK
            if len(data) > BLOCK:
                v = np.maximum(self.pooled(data) + self.p["shift"], 0)
                means.append(v.mean(axis=0)[None])
                mosts.append(v.max(axis=0)[None])
            else:
                held.append(data)
                room -= len(data)
        together()
        return sigmoid(self.head(np.concatenate(means), np.concatenate(mosts), np.array(sizes))[2]).tolist() if sizes else []

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> ByteNetwork:
        """Adam on the logistic loss. Through a maximum the gradient goes to where it was reached."""
        data = [as_bytes(t) for t in texts]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(data) // BATCH)
        for epoch in range(epochs):
            order = folds(len(data), seed + epoch)
            for at in range(0, len(order), BATCH):
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, g in self._gradient([data[i] for i in order[at : at + BATCH]], y[order[at : at + BATCH]]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
                self.tables()
        return self

    def _gradient(self, data: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        values, places, sizes = [], [], []
        for d in data:
            bounds, each = chunk_bounds(len(d) - WIDTH + 1), max(1, BLOCK // HOP)
            for i in range(0, len(bounds), each):
                low = bounds[i, 0]
                r = self.responses(d[low : bounds[i : i + each][-1, 1] + WIDTH - 1])
                for a, b in bounds[i : i + each] - low:
                    where = a + r[a:b].argmax(axis=0)
                    values.append(r[where, np.arange(FILTERS)])
                    places.append(d[(low + where)[:, None] + np.arange(WIDTH)])  # FILTERS, WIDTH: the bytes under each filter
            sizes.append(len(bounds))
        v, places, sizes = np.array(values, dtype=np.float64) + self.p["shift"], np.array(places), np.array(sizes)
        v, firsts = np.maximum(v, 0), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean, most = np.add.reduceat(v, firsts, axis=0) / sizes[:, None], np.maximum.reduceat(v, firsts, axis=0)
        x, h, z = self.head(mean, most, np.array([len(d) for d in data]))
        dz = (sigmoid(z) - y) / len(y)
        dh = np.outer(dz, self.p["out"]) * (1 - h * h)
        dx = dh @ self.p["hidden"].T
        doc = np.repeat(np.arange(len(data)), sizes)
        dv = dx[doc, :FILTERS] / sizes[doc, None]
        top = (v == most[doc]).astype(np.float64)
        top /= np.add.reduceat(top, firsts, axis=0)[doc]  # chunks that reach the same maximum share it
        dv += top * dx[doc, FILTERS : 2 * FILTERS]
        dv *= v > 0
        dt = np.zeros((WIDTH, 256, FILTERS))
        for k in range(WIDTH):
            np.add.at(dt[k], (places[:, :, k], np.broadcast_to(np.arange(FILTERS), places.shape[:2])), dv)
        return {"embed": np.einsum("kbf,kef->be", dt, self.p["filters"]), "filters": np.einsum("be,kbf->kef", self.p["embed"], dt), "shift": dv.sum(axis=0),
                "hidden": x.T @ dh, "hidden_shift": dh.sum(axis=0), "out": h.T @ dz, "out_shift": np.array([dz.sum()])}


def fit(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_ROWS) -> ByteNetwork | float:
    """A network fitted on about ``n`` labelled documents outside the held-out third, or the label they all have (0.5 if there are none)."""
    texts, y = labelled(docs, labels, "quality", held_out_mod(F.col("doc_id"), 3) != 1, n)
    return ByteNetwork().fit(texts, y) if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.5


def scores(texts, model: ByteNetwork | float):
    """The probability of good quality of every whole text, as a column; a null text is scored like an empty one."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts) if isinstance(model, ByteNetwork) else [model] * len(texts), dtype="float64")

    return scored(F.coalesce(texts, F.lit("")))


def score(docs: DataFrame, model: ByteNetwork | float) -> DataFrame:
    """``docs`` with ``score`` (in the place of a column of that name)."""
    return docs.withColumn("score", scores(F.col("text"), model))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored at ``threshold`` or more, all columns kept as they are; all of them if there are no labels to learn from."""
    model = fit(docs, labels)
    return docs.select(F.struct("*").alias("row"), scores(F.col("text"), model).alias("score")).where(F.col("score") >= threshold).select("row.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", (held_out_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
