"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of fixed word lists and of a learned one, how near such words stand to the second person,
capitals, punctuation, and rates of obfuscated spelling. The learned lexicon holds words and word beginnings that far more toxic than clean
documents of the training fold have, so that abuse in languages without a fixed list is seen as well; a training
document's features use a lexicon learned from the other parts of the sample. Trees are grown on a bounded labelled
sample by Newton boosting on binned features; out-of-fold margins are calibrated by pooling
adjacent violators.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlab.llm.common import Scratch, fold_of, map_lists, typed
from tremorlab.llm.sampling import labelled_sample, texts_of

FOLDS, HELD_OUT = 3, 1
#: Labelled documents of each class in the sample, at most.
ROWS_PER_CLASS = 2000
DECISION = 0.7
#: Parts of the sample, each scored by what the others teach.
PARTS = 4
#: A learned entry's share of toxic documents is at least so many times that of clean ones; its toxic documents are so many standard
#: deviations more than chance would give, which takes 7 where a tenth of the documents are toxic; and it is among so many entries at most.
LEAST_RATIO, LEAST_DEVIATIONS, MOST_ENTRIES = 5.0, 7.0, 3000
#: Lengths of the word beginnings that may be learned.
BEGINNINGS = (4, 5, 6, 7)
TREES, DEPTH, RATE, BINS, LEAF_WEIGHT, RIDGE = 60, 3, 0.2, 32, 5.0, 1.0

# Fixed word lists: general insults and slurs-free abuse, by language and strength.
INSULTS = frozenset("idiot idiots stupid moron morons dumb fool fools loser losers clown clowns imbecile jerk jerks dimwit halfwit nitwit cretin bozo dunce simpleton ignoramus".split())
CONTEMPT = frozenset("pathetic worthless trash garbage scum disgusting vile filth filthy despicable repulsive vermin scumbag lowlife parasite useless hateful sickening revolting".split())
THREATS = frozenset("kill die hurt destroy beat punch strangle smash crush hang shoot burn".split())
OTHER_LANGUAGES = frozenset("idioten dumm dummkopf trottel arschloch widerlich abschaum wertlos versager crétin imbécile abruti connard salaud minable dégoûtant ordure idiota estúpido imbécil tonto payaso asqueroso basura inútil perdedor".split())
SECOND_PERSON = frozenset("you your you're youre u ur yourself yours du dich dir dein deine tu te toi ton ta vous usted tú ti".split())
# Fixed substitutions of obfuscated spelling.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})

LEXICON = INSULTS | CONTEMPT | OTHER_LANGUAGES
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_MIXED = re.compile(r"[^\W\d_][\d@$!*_.-]+[^\W\d_]")
_SPACED = re.compile(r"\b(?:[^\W\d_] ){3,}[^\W\d_]\b")
NEAR = 6

FEATURES = ("insults", "contempt", "threats", "other_languages", "any_word", "distinct_words", "obfuscated_words", "mixed_rate", "spaced_rate", "second_person", "near_second_person", "capitals", "capital_words", "exclaims", "questions", "symbols", "length", "learned", "learned_share", "learned_distinct")


def entries(word: str) -> list[str]:
    """What a lower-case word may be learned by: itself and its beginnings, marked by a star."""
    return [word, *[word[:k] + "*" for k in BEGINNINGS if len(word) > k]]


def features(text: str | None, learned: frozenset[str] = frozenset()) -> list[float]:
    """Dense features of a whole text; all zero for one without a word."""
    t = text or ""
    tokens = t.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    n, m = len(t), len(tokens)
    raw = Counter(tokens)
    words: Counter = Counter()
    hidden = mixed = upper = letters = shout = 0
    for token, k in raw.items():
        found = [w.lower() for w in _WORD.findall(token)]
        for w in found:
            words[w] += k
        odd = _MIXED.search(token) is not None
        mixed += k * odd
        if odd and not any(w in LEXICON for w in found):
            hidden += k * (token.lower().strip("!?.,;:\"'()").translate(LEET) in LEXICON)
        a, u = sum(map(str.isalpha, token)), sum(map(str.isupper, token))
        letters, upper, shout = letters + a * k, upper + u * k, shout + k * (a > 1 and u == a)
    by_lexicon = {w for w in words if any(e in learned for e in entries(w))} if learned else set()
    n_learned = sum(words[w] for w in by_lexicon)
    count = lambda lexicon: sum(words[w] for w in words.keys() & lexicon)
    hits = count(LEXICON)
    near = 0
    if hits and words.keys() & SECOND_PERSON:
        line = [w.lower() for w in _WORD.findall(t)]
        you = [i for i, w in enumerate(line) if w in SECOND_PERSON]
        at = np.array([i for i, w in enumerate(line) if w in LEXICON])
        pos = np.searchsorted(you, at)
        edge = np.array([-(10**9), *you, 10**9])
        near = int(((at - edge[pos] <= NEAR) | (edge[pos + 1] - at <= NEAR)).sum())
    squash = lambda x, k: x / (x + k)
    per = 1000 / m
    return [
        squash(count(INSULTS) * per, 5),
        squash(count(CONTEMPT) * per, 5),
        squash(count(THREATS) * per, 5),
        squash(count(OTHER_LANGUAGES) * per, 5),
        squash(hits, 2),
        squash(len(words.keys() & LEXICON), 2),
        squash(hidden, 1),
        mixed / m,
        len(_SPACED.findall(t)) / m,
        count(SECOND_PERSON) / m,
        squash(near, 1),
        upper / max(letters, 1),
        shout / m,
        squash(t.count("!") / m, 0.1),
        squash(t.count("?") / m, 0.1),
        sum(k * sum(not c.isalnum() for c in w) for w, k in raw.items()) / n,
        min(math.log1p(m) / 10, 1.5),
        squash(n_learned, 2),
        squash(n_learned * per, 5),
        squash(len(by_lexicon), 2),
    ]


@dataclass
class Boosted:
    """Trees as flat arrays: feature, threshold, left child (right follows it), value."""

    base: float
    trees: list[list[tuple[int, float, int, float]]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=int)
            feature, cut, left, value = (np.array(c) for c in zip(*tree))
            for _ in range(DEPTH):
                inner = left[at] > 0
                right = x[np.arange(len(x)), feature[at]] > cut[at]
                at = np.where(inner, left[at] + right, at)
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
    """Newton boosting of the weighted logistic loss."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    rate = np.clip((weight * y).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(rate / (1 - rate))))
    f = np.full(len(x), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (p - y), weight * p * (1 - p)
        tree: list = [None]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if depth < DEPTH:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(code[rows, j], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], h[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                    gain[(hl < LEAF_WEIGHT * 0.05) | (hs - hl < LEAF_WEIGHT * 0.05)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] < 0:
                tree[at] = (0, 0.0, 0, float(-RATE * gs / (hs + RIDGE)))
                f[rows] += tree[at][3]
                continue
            _, j, k = best
            left = len(tree)
            tree += [None, None]
            tree[at] = (j, float(edges[j][k]), left, 0.0)
            goes = code[rows, j] > k
            todo += [(left, rows[~goes], depth + 1), (left + 1, rows[goes], depth + 1)]
        model.trees.append(tree)
    return model


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step values by pooling adjacent violators: block starts and block means."""
    order = np.argsort(score, kind="stable")
    xs, first = np.unique(score[order], return_index=True)
    w = np.add.reduceat(weight[order], first)
    v = np.add.reduceat((weight * y)[order], first)
    blocks: list[list[float]] = []
    for x, wi, vi in zip(xs, w, v):
        blocks.append([x, wi, vi])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, wb, vb = blocks.pop()
            blocks[-1][1] += wb
            blocks[-1][2] += vb
    return np.array([b[0] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


@dataclass
class ToxicityModel:
    trees: Boosted
    starts: np.ndarray
    means: np.ndarray
    learned: frozenset[str] = frozenset()

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, self.trees.margin(x), side="right") - 1
        return np.clip(self.means[np.maximum(at, 0)], 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, counts: dict[int, int], part: np.ndarray) -> ToxicityModel:
    """A model from features, labels and parts, weighted to the classes' whole counts; constant where a class is missing."""
    if not len(x) or len(set(y.tolist())) < 2:
        only = float(y[0]) if len(y) else 0.0
        return ToxicityModel(Boosted(0.0), np.array([0.0]), np.array([only]))
    n = np.bincount(y, minlength=2)
    weight = np.where(y == 1, counts.get(1, n[1]) / n[1], counts.get(0, n[0]) / n[0]).astype(float)
    weight *= len(y) / weight.sum()
    margin = np.zeros(len(y))
    for k in range(PARTS):
        if len(set(y[part != k].tolist())) == 2:
            margin[part == k] = boost(x[part != k], y[part != k], weight[part != k]).margin(x[part == k])
    starts, means = isotonic(margin, y.astype(float), weight)
    return ToxicityModel(boost(x, y, weight), starts, means)


def learn_lexica(rows: DataFrame) -> list[frozenset[str]]:
    """Lexica of (label, part, text): one from all parts but each, then one from all.

    Documents that hold an entry are counted by part and label; the driver gets at most MOST_ENTRIES entries.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            n: Counter = Counter()
            for label, part, text in zip(b["label"], b["part"], b["text"]):
                words = {w.lower() for w in _WORD.findall(text or "")}
                n.update((e, part, label) for e in {e for w in words for e in entries(w)})
            if n:
                entry, part, label = zip(*n)
                yield {"entry": entry, "part": part, "label": label, "n": list(n.values())}

    schema = T.StructType([T.StructField("entry", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("n", T.LongType())])
    of = [(k, c) for k in range(PARTS) for c in (0, 1)]
    size = {(r["part"], r["label"]): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    sums = [F.sum(F.when((F.col("part") == k) & (F.col("label") == c), F.col("n")).otherwise(0)).alias(f"n{k}{c}") for k, c in of]
    toxic, clean = (sum(F.col(f"n{k}{c}") for k in range(PARTS)) for c in (1, 0))
    docs = [sum(size.get((k, c), 0) for k in range(PARTS)) for c in (0, 1)]

    def strength(a, b, total):
        """Ratio of shares, and the square of the standard deviations above chance, of counts in toxic and clean documents."""
        rate = (total[1] + 1) / (total[0] + total[1] + 2)
        return (a + 0.5) / (total[1] + 1) * (total[0] + 1) / (b + 0.5), (a - (a + b) * rate) * (a - (a + b) * rate) / ((a + b) * rate * (1 - rate))

    ratio, squared = strength(toxic, clean, docs)
    found = map_lists(rows.select("label", "part", "text"), run, schema).groupBy("entry").agg(*sums).where(toxic > 0).where((ratio >= LEAST_RATIO) & (squared >= LEAST_DEVIATIONS**2))
    best = found.orderBy((toxic * F.log(ratio)).desc(), "entry").limit(MOST_ENTRIES).collect()

    def without(part: int | None) -> frozenset[str]:
        kept = [k for k in range(PARTS) if k != part]
        total = [sum(size.get((k, c), 0) for k in kept) for c in (0, 1)]
        out = set()
        for r in best:
            a, b = (sum(r[f"n{k}{c}"] for k in kept) for c in (1, 0))
            if a:
                ratio, squared = strength(a, b, total)
                if ratio >= LEAST_RATIO and squared >= LEAST_DEVIATIONS**2:
                    out.add(r["entry"])
        return frozenset(out)

    return [without(k) for k in [*range(PARTS), None]]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel:
    """Fit on a bounded sample outside the held-out fold; only its features and the lexicon reach the driver."""
    sample, counts = labelled_sample(labels, label_col, id_col, FOLDS, HELD_OUT, rows_per_class)
    # equal texts fall into one part, or a part would teach its own copies
    part = F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int")
    with Scratch(docs.sparkSession) as scratch:
        texts = scratch.table(texts_of(sample, docs, id_col, text_col).withColumn("part", part), "toxicity-sample")
        lexica = learn_lexica(texts)
        sent = docs.sparkSession.sparkContext.broadcast(lexica)

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            for b in batches:
                yield {"doc_id": b["doc_id"], "label": b["label"], "part": b["part"], "x": [features(t, sent.value[k]) for t, k in zip(b["text"], b["part"])]}

        rows = map_lists(texts, run, typed(docs, id_col, label=T.IntegerType(), part=T.IntegerType(), x=T.ArrayType(T.DoubleType()))).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x, y, part_of = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], dtype=int), np.array([r["part"] for r in rows], dtype=int)
    model = fit(x, y, counts, part_of)
    model.learned = lexica[-1]
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null texts count as empty; an empty text has a score like any other. A null id has a null
    ``held_out``. Repeats and other columns change nothing; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            p = sent.value.scores(np.array([features(t, sent.value.learned) for t in b["text"]]).reshape(-1, len(FEATURES)))
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "score": p, "predicted": (p >= DECISION).astype(np.int32)}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", fold_of("doc_id", FOLDS) == HELD_OUT)
    return map_lists(rows, run, typed(docs, id_col, held_out=T.BooleanType(), score=T.DoubleType(), predicted=T.IntegerType()))
