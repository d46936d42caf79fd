"""Document quality by Bradley-Terry pairwise ranking.

Pairs of a preferred and another document of a bounded labelled sample give a logistic loss on the
difference of their features; the linear score that minimises it ranks documents. The cut between
good and bad is the quantile of the sample's scores with the fewest errors, weighted for how the
sample was drawn; the reported score is a logistic of the distance to the cut that equals the
decision level there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlab.llm.common import fold_of, map_lists, typed
from tremorlab.llm.sampling import labelled_sample, texts_of

FOLDS, HELD_OUT = 4, 2
#: Labelled documents of each class in the sample, at most, and preference pairs drawn from them.
ROWS_PER_CLASS = 1500
PAIRS = 20_000
DECISION = 0.7
RIDGE = 1e-3
#: Score distance between the middle of the two classes, after scaling; the slope of the reported score.
SPREAD = 6.0

FEATURES = ("symbols", "symbol_words", "capitals", "capital_words", "lone_marks", "exclaims", "digits", "word_length", "long_words", "repeated_words", "repeated_lines", "repeated_runs", "no_sentence_end", "unprintable", "length")
_SYMBOL = re.compile(r"[^\w\s.,;:'\"!?()-]")
_END = re.compile(r"[.!?][\"')\]]*\s*$", re.M)


def features(text: str | None) -> list[float]:
    """Dense features of a whole text, each within 0 and 1 or near it; all zero for an empty one."""
    t = text or ""
    n, words = len(t), t.split()
    if not words:
        return [0.0] * len(FEATURES)
    m = len(words)
    count = Counter(words)
    unique = list(count.items())
    symbols = len(_SYMBOL.findall(t))
    letters = sum(c for w, k in unique for c in [k * sum(map(str.isalpha, w))])
    upper = sum(k * sum(map(str.isupper, w)) for w, k in unique)
    lines = [x for x in t.split("\n") if x.strip()]
    runs = Counter(zip(words, words[1:], words[2:], words[3:]))
    squash = lambda x, at: x / (x + at)
    return [
        squash(symbols / n, 0.03),
        sum(k for w, k in unique if _SYMBOL.search(w)) / m,
        upper / max(letters, 1),
        sum(k for w, k in unique if len(w) > 1 and w.isupper()) / m,
        sum(k for w, k in unique if len(w) == 1 and not w.isalnum()) / m,
        squash(t.count("!") / m, 0.1),
        squash(sum(k * sum(map(str.isdigit, w)) for w, k in unique) / n, 0.05),
        min(sum(len(w) * k for w, k in unique) / m / 20, 1.5),
        sum(k for w, k in unique if len(w) > 25) / m,
        1 - len(count) / m,
        1 - len(set(lines)) / len(lines),
        (sum(runs.values()) - len(runs)) / max(sum(runs.values()), 1),
        1 - min(1.0, len(_END.findall(t)) / len(lines)),
        sum(not c.isprintable() and not c.isspace() for w in count for c in w) / n,
        min(math.log1p(m) / 10, 1.5),
    ]


@dataclass
class QualityModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; DECISION at the cut."""
        z = np.clip((self.raw(x) - self.cut) * self.slope + math.log(DECISION / (1 - DECISION)), -30, 30)
        return 1 / (1 + np.exp(-z))


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, rounds: int = 30) -> np.ndarray:
    """Weights that minimise the mean logistic loss over sampled preference pairs, by Newton steps."""
    rng = np.random.default_rng(11)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d * p[:, None]).mean(axis=0) + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_quantile(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut between two neighbouring quantiles of the scores with the least weighted error; the widest gap of equals."""
    order = np.argsort(raw, kind="stable")
    r, w = raw[order], weight[order]
    below_good, above_bad = np.cumsum(w * (y[order] == 1)), (w * (y[order] == 0)).sum() - np.cumsum(w * (y[order] == 0))
    gap = np.diff(r, append=r[-1])
    error = np.where(gap > 0, below_good + above_bad, np.inf)
    if not np.isfinite(error).any():
        return float(r[0]) - 1.0
    near = np.flatnonzero(error <= error.min() + 1e-9 * weight.sum())
    k = near[gap[near].argmax()]
    return float((r[k] + r[k + 1]) / 2)


def fit(x: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> QualityModel:
    """A model from features and labels; constant where a class is missing."""
    k = x.shape[1]
    if not len(x) or len(set(y.tolist())) < 2:
        only = float(y[0]) if len(y) else 1.0
        return QualityModel(np.zeros(k), np.zeros(k), np.ones(k), -1.0 if only else 1.0, 1.0)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    s = (x - mean) / scale
    w = bradley_terry(s[y == 1], s[y == 0])
    raw = s @ w
    weight = np.where(y == 1, counts.get(1, 1) / max((y == 1).sum(), 1), counts.get(0, 1) / max((y == 0).sum(), 1))
    cut = best_quantile(raw, y, weight)
    gap = abs(float(np.median(raw[y == 1]) - np.median(raw[y == 0])))
    return QualityModel(w, mean, scale, cut, SPREAD / max(gap, 1e-6))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> QualityModel:
    """Fit on a bounded sample outside the held-out fold; only its features reach the driver."""
    sample, counts = labelled_sample(labels, label_col, id_col, FOLDS, HELD_OUT, rows_per_class)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "label": b["label"], "x": [features(t) for t in b["text"]]}

    rows = map_lists(texts_of(sample, docs, id_col, text_col), run, typed(docs, id_col, label=T.IntegerType(), x=T.ArrayType(T.DoubleType()))).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows]), counts)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null texts count as empty; an empty text has a score like any other. A null id has a null
    ``held_out``. Repeats and other columns change nothing; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            p = sent.value.scores(np.array([features(t) for t in b["text"]]).reshape(-1, len(FEATURES)))
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": p, "predicted": (p >= DECISION).astype(np.int32)}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", fold_of("doc_id", FOLDS) == HELD_OUT)
    return map_lists(rows, run, typed(docs, id_col, held_out=T.BooleanType(), score=T.DoubleType(), predicted=T.IntegerType()))
