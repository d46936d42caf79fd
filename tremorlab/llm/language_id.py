"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased letters are hashed into a fixed number of features and
weighted 1 + ln(tf) times idf at unit length. The weights are learned by follow-the-regularised-
leader with an elastic net (L1 and L2), on the driver, from a bounded sample; a temperature fitted on
a part of that sample kept from the weights calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlab.llm.common import fold_of, hash_share, map_lists, typed

UNDETERMINED = "und"
FOLDS, HELD_OUT = 4, 2
#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 2400
BITS = 15
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Texts with fewer letters and gaps than this are too short to be rejected.
SHORT = 64
#: Rejected is what has less than this share of the least contrast of held-out clean texts that are as long or longer.
SLACK = 0.5
#: Held-out texts that such a least contrast rests on, at least; the least of fewer bounds nothing, so nothing is rejected then.
FLOOR_ROWS = 50
#: Text handled at once, to bound memory for very long documents.
CHUNK = 1 << 19

_LETTER = np.ones(128, dtype=bool)
_LETTER[:] = [chr(i).isalpha() for i in range(128)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and how often each occurs in the whole text."""
    total = np.zeros(1 << BITS, dtype=np.int64)
    low = " " + text.lower() + " "
    held, after_gap = np.zeros(0, dtype=np.uint64), False  # the last two codes that were kept, and whether a gap came last
    for at in range(0, len(low), CHUNK):
        codes = np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        letter = np.ones(len(codes), dtype=bool)
        ascii_ = codes < 128
        letter[ascii_] = _LETTER[codes[ascii_].astype(np.int64)]
        kept = np.where(letter, codes, np.uint64(32))[letter | np.concatenate([[not after_gap], letter[:-1]])]
        after_gap = not letter[-1]
        if not len(kept):
            continue
        old, codes = len(held), np.concatenate([held, kept])
        a, b, c = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        shift = np.uint64(64 - BITS)
        one = codes * a
        # of every length, the n-grams that end in a code of this chunk
        for h in (one[old:], (one[:-1] * c + codes[1:] * b)[max(old - 1, 0) :], (one[:-2] * c + codes[1:-1] * b) * c + codes[2:] * a):
            total += np.bincount(((h * b) >> shift).astype(np.int64), minlength=1 << BITS)
        held = codes[-2:]
    idx = np.flatnonzero(total)
    return idx.astype(np.int32), total[idx]


def tf_vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return (x / max(np.sqrt((x * x).sum()), 1e-12)).astype(np.float64)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # languages x features
    idf: np.ndarray
    temperature: float = 1.0
    floors: tuple[float, ...] = ()  # by length class, the contrast below which a text is rejected

    def logits(self, text: str) -> np.ndarray:
        idx, n = ngram_counts(text)
        return self.weights[:, idx] @ tf_vector(n, self.idf[idx])

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 for texts without a letter."""
        if not has_letter(text) or not self.languages:
            return UNDETERMINED, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


    def accepts(self, text: str | None) -> bool:
        """Whether the text is in a learned language, or in several: not where no language stands out from any other.

        The contrast is the calibrated log odds of the likeliest against the least likely language. Short texts
        are accepted, and so is everything where no language was learned; else a text needs a letter.
        """
        if not self.languages:
            return True
        if not has_letter(text):
            return False
        idx, n = ngram_counts(text)
        k = length_class(n)
        if not self.floors or k < length_class(np.array([3 * SHORT])):
            return True
        z = self.weights[:, idx] @ tf_vector(n, self.idf[idx]) / self.temperature
        return bool(z.max() - z.min() >= self.floors[min(k, len(self.floors) - 1)])


def length_class(counts: np.ndarray) -> int:
    """The number of bits of a text's length, a third of its 1- to 3-grams."""
    return int(counts.sum() // 3).bit_length()


def contrast_floors(rows: list[tuple[int, float]]) -> tuple[float, ...]:
    """For each length class, SLACK times the least contrast of rows (class, contrast) of this or a longer class.

    Classes with fewer than FLOOR_ROWS such rows take what the next shorter one has; empty where none has enough.
    """
    floors: list[float] = []
    for k in range(max((r[0] for r in rows), default=-1) + 1):
        longer = [c for at, c in rows if at >= k]
        if len(longer) < FLOOR_ROWS:
            break
        floors.append(float(SLACK * min(longer)))
    return tuple(floors)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, features: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal, per-coordinate steps, over the rows in a fixed shuffled order."""
    z, n = np.zeros((classes, features)), np.zeros((classes, features))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            idx, x, y = rows[r]
            zi, ni = z[:, idx], n[:, idx]
            w = weights(zi, ni)
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = p[:, None] * x
            g2 = g * g
            z[:, idx] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * w
            n[:, idx] = ni + g2
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    lo, hi, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on up to ``train_rows`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    ok = d.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", FOLDS) != HELD_OUT))
    # the hash threshold leaves about twice the rows wanted, whatever the table's size, so that the sort stays small
    share = 2.0 * train_rows / max(ok.count(), 1)
    chosen = ok.select("doc_id").where(hash_share("doc_id") < share).orderBy(hash_share("doc_id"), "doc_id").limit(train_rows)
    sample = ok.join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            got = [ngram_counts(t) if has_letter(t) else (np.zeros(0, np.int32), np.zeros(0, np.int64)) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "lang": b["lang"], "idx": [i.tobytes() for i, _ in got], "n": [n.astype(np.int32).tobytes() for _, n in got]}

    rows = map_lists(sample, run, typed(docs, id_col, lang=T.StringType(), idx=T.BinaryType(), n=T.BinaryType())).collect()
    rows = sorted(((r["doc_id"], r["lang"], np.frombuffer(r["idx"], np.int32), np.frombuffer(r["n"], np.int32)) for r in rows if r["idx"]), key=lambda r: (str(r[0]), r[1]))
    rows = rows[:train_rows]
    languages = sorted({r[1] for r in rows})
    if not rows:
        return LanguageModel([], np.zeros((0, 1 << BITS)), np.ones(1 << BITS))
    df = np.bincount(np.concatenate([r[2] for r in rows]), minlength=1 << BITS)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    data = [(idx, tf_vector(n, idf[idx]), languages.index(lang)) for _, lang, idx, n in rows]
    kept, part = [r for i, r in enumerate(data) if i % 5 == 4], [r for i, r in enumerate(data) if i % 5 != 4]
    t, floors = 1.0, ()
    if kept and len(languages) > 1:
        w = ftrl(part, len(languages), 1 << BITS)
        z = np.array([w[:, i] @ x for i, x, _ in kept])
        t = temperature(z, np.array([y for _, _, y in kept]))
        sizes = [length_class(r[3]) for i, r in enumerate(rows) if i % 5 == 4]
        floors = contrast_floors([(k, (v.max() - v.min()) / t) for k, v, (_, _, y) in zip(sizes, z, kept) if v.argmax() == y])
    return LanguageModel(languages, ftrl(data, len(languages), 1 << BITS), idf, t, floors)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0. A null id has a null ``held_out``.
    Rows are independent; repeats and other columns change nothing; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = sent.value
        for b in batches:
            got = [m.predict(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", fold_of("doc_id", FOLDS) == HELD_OUT)
    return map_lists(rows, run, typed(docs, id_col, held_out=T.BooleanType(), lang_pred=T.StringType(), score=T.DoubleType()))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float | None = 0.5) -> DataFrame:
    """The rows whose language is identified with a score of ``least`` or more, or that the model accepts where ``least`` is None; all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        if least is None:
            return texts.map(sent.value.accepts)
        return texts.map(lambda t: (lambda g: g[0] != UNDETERMINED and g[1] >= least)(sent.value.predict(t)))

    return docs.where(keep(F.col(text_col)))
