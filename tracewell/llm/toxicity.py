"""Toxicity: a linear-chain conditional random field over words, fitted and run in numpy.

Labels are per document, so words are labelled first: a feature of words (the word, its first three to five letters, its
last three) is *telling* if it is found in several toxic documents and hardly ever in others, and a word of a toxic document
with a telling feature is a toxic word. On words so labelled the field learns a weight per feature and a weight per
transition. Run over a whole text it gives every word its marginal probability by the forward-backward recursions; a small
logistic regression over the largest marginals and their sum, fitted on documents, gives the document's score, and words
whose marginal is high enough are reported with their offsets.

With two states the recursions need one number per word (the odds so far). The texts of a batch are laid end to end, with
no transition between one and the next, and many stretches of that chain advance together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import groups, held_out_mod
from tracewell.llm.learning import SAMPLE_ROWS, labelled, logistic, sigmoid

DIM = 1 << 16
#: Toxic documents that a telling feature needs, and how many times as frequent as elsewhere it must be.
MIN_DOCS, RATIO = 4, 30
STEPS, RATE, L2, LANE = 400, 0.5, 1e-4, 64
CACHED = 400_000
SPAN, THRESHOLD = 0.5, 0.7
CORE = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Runs of letters, and runs between white space that have none.
TOKEN = re.compile(CORE.pattern + r"|(?<!\S)(?:(?![^\W\d_])\S)++(?!\S)")
#: Letters of a run beyond which, as in a run of any length without upper and lower case, its n-grams are words too.
LONG, GRAM, MARK = 16, 3, "\0"


def _long(w: str) -> bool:
    return len(w) > LONG or (not w.isascii() and len(w) > 1 and w.lower() == w.upper())


def places(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end): every run of letters and, within long runs and scripts without case, what begins at each letter of it."""
    out = []
    for m in TOKEN.finditer(text):
        w, at, end = m[0], m.start(), m.end()
        out.append((w, at, end))
        if _long(w):
            out += [(MARK + w[i : i + GRAM], at + i, min(end, at + i + GRAM)) for i in range(len(w) - 1)]
    return out


def tokens(text: str | None) -> list[str]:
    """The words of ``places`` without their offsets, which most texts need not have."""
    out = []
    for w in TOKEN.findall(text or ""):
        out.append(w)
        if _long(w):
            out += [MARK + w[i : i + GRAM] for i in range(len(w) - 1)]
    return out


def features(word: str) -> list[str]:
    """A word's features: its letters, lower-cased, whole, and their first three to five and last three. A word without letters has one of its own;
    an n-gram from within a run has its first two and three letters."""
    if word[0] == MARK:
        w = word[1:].lower()
        return [f"{n}~{w[:n]}" for n in (2, 3) if len(w) >= n]
    m = CORE.search(word)
    if not m:
        return ["-"]
    w = m[0].lower()
    return [f"={w}", *(f"{n}<{w[:n]}" for n in (3, 4, 5) if len(w) > n), *([f">{w[-3:]}"] if len(w) > 3 else [])]


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % DIM for f in features(word)]


def _odds(evidence: np.ndarray, linked: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Odds of the toxic state at every place of a chain, from the places before it and its own evidence.

    ``linked`` is 0 where a sequence begins (its state does not depend on the place before) and 1 elsewhere. The chain is
    laid out as many stretches that advance together; a stretch starts from where the one before it ended, and
    all are run again until no start changes, which is when the result is that of one pass from the first place to the last.
    """
    n = len(evidence)
    steps = max(1, int(np.sqrt(n)))
    lanes = -(-n // steps)
    lay = lambda x, fill: np.ascontiguousarray(np.append(x, np.full(steps * lanes - n, fill)).reshape(lanes, steps).T)
    e, on = lay(evidence, 1.0), lay(linked, 0.0)
    out, start = np.empty_like(e), np.ones(lanes)
    while True:
        o = start
        for i in range(steps):
            ratio = (t[0, 1] + t[1, 1] * o) / (t[0, 0] + t[1, 0] * o)
            o = out[i] = (1 + on[i] * (ratio - 1)) * e[i]
        ends = np.append(1.0, o[:-1])
        if np.all(np.abs(ends - start) <= 1e-9 * np.abs(start)):
            return out.T.ravel()[:n]
        start = ends


def chain(evidence: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences laid end to end, with evidence as log odds: (marginals of the toxic state, forward
    odds with evidence, backward odds with evidence)."""
    e, t = np.exp(np.clip(evidence, -25, 25)), np.exp(t)
    linked = np.ones(len(e))
    ends = np.cumsum(lengths[lengths > 0])
    linked[0] = 0
    linked[ends[:-1]] = 0
    forward = _odds(e, linked, t)
    back = np.ones(len(e))
    back[ends - 1] = 0
    backward = _odds(e[::-1], back[::-1], t.T)[::-1]
    both = forward * backward / e
    return both / (1 + both), forward, backward


class ToxicField:
    """The field's weights and the document model; about half a megabyte."""

    def __init__(self):
        self.w, self.bias, self.t, self.top = np.zeros(DIM), 0.0, np.zeros((2, 2)), np.zeros(4)
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "young": {}, "old": {}}

    def _evidence(self, words: list[str]) -> np.ndarray:
        """What each word's features add up to. Known words are kept in two generations, so memory is bounded and frequent ones stay."""
        found = list(map(self.young.get, words))
        if None in found:
            missing = dict.fromkeys(w for w, f in zip(words, found, strict=True) if f is None)
            at = {w: v for w in missing if (v := self.old.get(w)) is not None}
            new = [w for w in missing if w not in at]
            if new:
                each = [slots(w) for w in new]
                firsts = np.cumsum([0, *map(len, each[:-1])])
                at.update(zip(new, (np.add.reduceat(self.w[[s for e in each for s in e]], firsts) + self.bias).tolist(), strict=True))
            if len(self.young) > CACHED:
                self.old, self.young = self.young, {}
            self.young.update((w, v) for w, v in at.items() if len(w) <= LANE)
            found = [at[w] if f is None else f for w, f in zip(words, found, strict=True)]
        return np.array(found, dtype=np.float64)

    def tag(self, texts: list[str | None]) -> list[np.ndarray]:
        """Marginals of the words of each text."""
        return self.marginals([tokens(t) for t in texts])

    def marginals(self, words: list[list[str]]) -> list[np.ndarray]:
        lengths = np.array([len(w) for w in words])
        if not lengths.sum():
            return [np.zeros(0) for _ in words]
        m, _, _ = chain(self._evidence([w for ws in words for w in ws]), lengths, self.t)
        return np.split(m, np.cumsum(lengths)[:-1])

    @staticmethod
    def summary(marginal: np.ndarray) -> np.ndarray:
        """Log odds of the two largest marginals (a text without words: of none), and the logarithm of their sum."""
        top = np.clip(np.sort(np.append(marginal, [1e-6, 1e-6]))[-2:], 1e-6, 1 - 1e-6)
        return np.append(np.log(top / (1 - top)), np.log1p(np.where(marginal > 0.1, marginal, 0).sum()))

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 5) -> ToxicField:
        """A field for texts with labels 0 and 1. Of texts without words nothing can be learned but how often they are toxic."""
        words, known = [], {}
        for text in texts:
            words.append([known.setdefault(w, w) for w in tokens(text)])
        of = {w: features(w) for w in known}
        telling = self._telling(words, of, y)
        tells = {w: not telling.isdisjoint(fs) for w, fs in of.items()}
        at = {w: np.array(slots(w), dtype=np.int32) for w in known}
        windows, marks = [], []
        rng = np.random.default_rng(seed)
        for ws, toxic in zip(words, y, strict=True):
            # Stretches of the whole text; where they begin is left to chance, so that telling words stand anywhere in them.
            for s in range(-int(rng.integers(LANE)), len(ws), LANE) if ws else ():
                each = [at[w] for w in ws[max(0, s) : s + LANE]]
                windows.append((np.concatenate(each), np.array([len(i) for i in each], dtype=np.int8)))
                marks.append(np.array([bool(toxic) and tells[w] for w in ws[max(0, s) : s + LANE]], dtype=bool))
        if windows:
            self._learn(windows, marks, rng)
        x = np.array([self.summary(m) for some in groups(words, 1 << 16, len) for m in self.marginals(some)])
        self.top = logistic(x, y)
        return self

    @staticmethod
    def _telling(words: list[list[str]], features_of: dict[str, list[str]], y: np.ndarray) -> set[str]:
        """Of the features of documents' words: those of at least ``MIN_DOCS`` toxic documents and hardly any others. Toxic documents that this
        leaves without one are few and may use words of their own: of features that two or more of them share and no other document has,
        those of most documents are taken first, until each such document has one."""
        of = lambda ws: {f for w in set(ws) for f in features_of[w] if f[0] != ">" and f != "-"}
        left = [of(ws) for ws, mark in zip(words, y, strict=True) if mark]
        toxic = Counter(f for fs in left for f in fs)
        several = {f for f, n in toxic.items() if n > 1}
        other = Counter(f for ws, mark in zip(words, y, strict=True) if not mark for f in several & of(ws))
        share = RATIO * y.sum() / max(1.0, len(y) - y.sum())
        telling = {f for f in several if toxic[f] >= MIN_DOCS and toxic[f] >= share * (other[f] + 0.5)}
        left = [fs & several for fs in left if telling.isdisjoint(fs)]
        while True:
            counts = Counter(f for fs in left for f in fs if f not in other)
            best = min(counts, key=lambda f: (-counts[f], len(f), f), default=None)
            if best is None or counts[best] < 2:
                return telling
            telling.add(best)
            left = [fs for fs in left if best not in fs]

    def _learn(self, windows: list, marks: list, rng) -> None:
        """AdaGrad on the log-likelihood: expected minus observed counts of features and transitions."""
        gw, gt, gb = np.full(DIM, 1e-8), np.full((2, 2), 1e-8), 1e-8
        with_span = np.flatnonzero([m.any() for m in marks])
        without = np.flatnonzero([not m.any() for m in marks])
        for _ in range(STEPS):
            pick = np.concatenate([rng.choice(a, min(len(a), n)) for a, n in ((with_span, 12), (without, 36)) if len(a)])
            lengths = np.array([len(marks[i]) for i in pick])
            at, each = np.concatenate([windows[i][0] for i in pick]), np.concatenate([windows[i][1] for i in pick])
            word = np.repeat(np.arange(len(each)), each)
            yy = np.concatenate([marks[i] for i in pick]).astype(float)
            e = np.bincount(word, weights=self.w[at]) + self.bias
            p, forward, backward = chain(e, lengths, self.t)
            d = p - yy
            inside = np.ones(len(e) - 1, dtype=bool)
            inside[np.cumsum(lengths)[:-1] - 1] = False
            a, b, et = forward[:-1], backward[1:], np.exp(self.t)
            pair = np.array([[np.full(len(a), et[0, 0]), et[0, 1] * b], [et[1, 0] * a, et[1, 1] * a * b]])
            pair /= pair.sum(axis=(0, 1))
            ya, yb = yy[:-1], yy[1:]
            seen = np.array([[(1 - ya) * (1 - yb), (1 - ya) * yb], [ya * (1 - yb), ya * yb]])
            g = ((pair - seen) * inside).sum(axis=2) / len(pick) + L2 * self.t
            step = np.zeros(DIM)
            np.add.at(step, at, d[word])
            step = step / len(pick) + L2 * self.w * (step != 0)
            gw += step * step
            gt += g * g
            gb += (d.sum() / len(pick)) ** 2
            self.w -= RATE * step / np.sqrt(gw)
            self.t -= 0.1 * RATE * g / np.sqrt(gt)
            self.bias -= RATE * d.sum() / len(pick) / np.sqrt(gb)

    def judge(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """(probability that it is toxic, offending spans) of each text; a bounded number of characters is worked on at a time."""
        out = []
        for some in groups(texts):
            for text, m in zip(some, self.tag(some), strict=True):
                out.append((float(sigmoid(self.summary(m) @ self.top[:3] + self.top[3])), self._spans(text, m) if len(m) and m.max() >= SPAN else []))
        return out

    def score(self, texts: list[str | None]) -> list[float]:
        return [p for p, _ in self.judge(texts)]

    @staticmethod
    def _spans(text: str | None, marginal: np.ndarray) -> list[tuple[int, int, float]]:
        out: list[tuple[int, int, float]] = []
        last = -2
        for i, ((_, a, b), p) in enumerate(zip(places(text or ""), marginal, strict=True)):
            if p >= SPAN:
                out = [*out[:-1], (out[-1][0], max(b, out[-1][1]), max(out[-1][2], float(p)))] if last == i - 1 else [*out, (a, b, float(p))]
                last = i
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, marginal) of runs of words that the field holds toxic; code points, end exclusive; the largest marginal of the run."""
        return self.judge([text])[0][1]


def fit(docs: DataFrame, labels: DataFrame, n: int = SAMPLE_ROWS) -> ToxicField | float:
    """A field fitted on about ``n`` labelled documents outside the held-out third, or the label they all have (0 if there are none)."""
    texts, y = labelled(docs, labels, "toxic", held_out_mod(F.col("doc_id"), 3) != 1, n)
    return ToxicField().fit(texts, y) if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.0


SPANS = "array<struct<start:int,end:int,marginal:double>>"


def score(docs: DataFrame, model: ToxicField | float) -> DataFrame:
    """``docs`` with ``score``, the probability that the whole text is toxic, and ``toxic_spans``, where (in the place of columns of those names).

    A null text is scored like an empty one. Where there was nothing to learn from, scores are all the same and there are no spans.
    """

    @F.pandas_udf(f"score double, toxic_spans {SPANS}")
    def judged(texts: pd.Series) -> pd.DataFrame:
        found = model.judge(texts.tolist()) if isinstance(model, ToxicField) else [(model, [])] * len(texts)
        return pd.DataFrame({"score": [p for p, _ in found], "toxic_spans": [[{"start": a, "end": b, "marginal": p} for a, b, p in spans] for _, spans in found]})

    made = docs.select(F.struct("*").alias("row"), judged(F.coalesce("text", F.lit(""))).alias("made"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("score", "toxic_spans")], "made.score", "made.toxic_spans")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted, and the offending spans (start:end, joined by commas)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.select("doc_id", (held_out_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), spans.alias("toxic_spans"))
