"""Online calibrators with delayed labels: multi-feature logistic, by regime, with safety gates and histogram layer."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FEATURES = ("delta_sigma", "vol_ratio", "vol_of_vol", "vol_20")
CLIP = 10.0


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def _logit(p: float) -> float:
    q = min(max(p, 1e-7), 1 - 1e-7)
    return float(np.log(q / (1 - q)))


@dataclass
class SafetyGate:
    """Emits the raw probability while, over a full window, the calibrated one scores worse or does not discriminate."""

    window: int = 200
    least_auc: float = 0.5
    rows: deque = field(default_factory=deque)
    closed: bool = False

    def __post_init__(self) -> None:
        self.closed = self._judge()

    def add(self, raw: float, cal: float, y: float) -> None:
        self.rows.append((raw, cal, y))
        if len(self.rows) > self.window:
            self.rows.popleft()
        self.closed = self._judge()

    def _judge(self) -> bool:
        if len(self.rows) < self.window:
            return False
        a = np.array(self.rows)
        if np.mean((a[:, 1] - a[:, 2]) ** 2) > np.mean((a[:, 0] - a[:, 2]) ** 2):
            return True
        pos, neg = a[a[:, 2] == 1, 1], a[a[:, 2] == 0, 1]
        if not len(pos) or not len(neg):
            return False
        auc = (np.sum(pos[:, None] > neg) + 0.5 * np.sum(pos[:, None] == neg)) / (len(pos) * len(neg))
        return auc < self.least_auc


@dataclass
class OnlineLogistic:
    """w.x with x = (1, logit p, scaled features): steps lr / sqrt(1 + n), L2 on all weights, gradient norm at most 10."""

    size: int
    lr: float = 0.01
    l2: float = 1e-4
    warm_up: int = 100
    n: int = 0
    w: np.ndarray | None = None
    gate: SafetyGate = field(default_factory=SafetyGate)

    def __post_init__(self) -> None:
        if self.w is None:
            self.w = np.zeros(self.size)
            self.w[1] = 1.0

    def emit(self, p: float, x: np.ndarray) -> float:
        return p if self.n < self.warm_up or self.gate.closed else _sigmoid(self.w @ x)

    def update(self, p: float, x: np.ndarray, y: float) -> None:
        cal = _sigmoid(self.w @ x)
        self.gate.add(p, p if self.n < self.warm_up else cal, y)
        g = (cal - y) * x + self.l2 * self.w
        norm = np.linalg.norm(g)
        self.w = self.w - self.lr / np.sqrt(1 + self.n) * g * min(1.0, CLIP / max(norm, 1e-12))
        self.n += 1

    def state(self) -> dict:
        """All of it, gates included, as plain values."""
        return {"size": self.size, "lr": self.lr, "l2": self.l2, "warm_up": self.warm_up, "n": self.n, "w": self.w.tolist(), "gate": [list(r) for r in self.gate.rows], "window": self.gate.window, "least_auc": self.gate.least_auc}

    @classmethod
    def restore(cls, s: dict) -> OnlineLogistic:
        gate = SafetyGate(s["window"], s["least_auc"], deque(tuple(r) for r in s["gate"]))
        return cls(s["size"], s["lr"], s["l2"], s["warm_up"], s["n"], np.array(s["w"]), gate)


@dataclass
class Histogram:
    """Running bins with a shrunk additive correction, active from ``least`` rows on."""

    bins: int = 10
    least: int = 15
    prior: float = 15.0
    n: np.ndarray | None = None
    sp: np.ndarray | None = None
    sy: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.n is None:
            self.n, self.sp, self.sy = np.zeros(self.bins), np.zeros(self.bins), np.zeros(self.bins)

    def _bin(self, p: float) -> int:
        return min(int(p * self.bins), self.bins - 1)

    def emit(self, p: float) -> float:
        k = self._bin(p)
        n = self.n[k]
        if n < self.least:
            return p
        return float(np.clip(p + n / (n + self.prior) * (self.sy[k] - self.sp[k]) / n, 0, 1))

    def update(self, p: float, y: float) -> None:
        k = self._bin(p)
        self.n[k] += 1
        self.sp[k] += p
        self.sy[k] += y


#: What scales FEATURES to numbers of about one.
SCALES = np.array([100.0, 1.0, 100.0, 10.0])


def route(seen: deque | list, sigma: float, kind: str, regimes: int) -> int:
    """The model that a volatility goes to: by its share among those seen lately; the first while fewer than 50 are known."""
    if kind != "regime" or len(seen) < 50 or not np.isfinite(sigma):
        return 0
    return min(int(np.mean(np.array(seen) < sigma) * regimes), regimes - 1)


def emit(state: dict, p: float, features: list[float]) -> float:
    """The calibrated probability of a raw one by a state that ``walk`` left."""
    model = [OnlineLogistic.restore(m) for m in state["models"]]
    m = model[route(state["seen"], features[FEATURES.index("vol_20")], state["kind"], len(model))]
    x = np.concatenate([[1.0, _logit(p)], np.nan_to_num(np.array(features, dtype=float)) * SCALES])
    hist = Histogram(n=np.array(state["n"]), sp=np.array(state["sp"]), sy=np.array(state["sy"]))
    return p if m.gate.closed else hist.emit(m.emit(p, x))


def walk(g: pd.DataFrame, horizon: int, kind: str, regimes: int = 3, end: dict | None = None) -> pd.DataFrame:
    """p_cal for each row of one series and horizon, in time order; a label is learned from ``horizon`` rows after its prediction, before that row's own prediction.

    What was learned by the last row goes into ``end``, as plain values.
    """
    g = g.sort_values("idx")
    model = [OnlineLogistic(2 + len(FEATURES)) for _ in range(regimes if kind == "regime" else 1)]
    hist, queue, seen = Histogram(), deque(), deque(maxlen=252)
    feats = g[list(FEATURES)].astype(float).fillna(0.0).to_numpy() * SCALES
    ys, ps, at = g["y"].to_numpy(dtype=float), g["p"].to_numpy(dtype=float), g["idx"].to_numpy()
    sig = g["vol_20"].to_numpy(dtype=float)
    out = []

    for i in range(len(g)):
        while queue and at[i] - at[queue[0][0]] >= horizon:
            j, x, cal = queue.popleft()
            if np.isfinite(ys[j]):
                model[route(seen, sig[j], kind, regimes)].update(ps[j], x, ys[j])
                hist.update(cal, ys[j])
        p = ps[i]
        if not np.isfinite(p):
            out.append((None, None))
            continue
        x = np.concatenate([[1.0, _logit(p)], feats[i]])
        m = model[route(seen, sig[i], kind, regimes)]
        cal = m.emit(p, x)
        out.append((cal, p if m.gate.closed else hist.emit(cal)))
        queue.append((i, x, cal))
        if np.isfinite(sig[i]):
            seen.append(sig[i])
    if end is not None:
        end.update(kind=kind, models=[m.state() for m in model], seen=list(seen), n=hist.n.tolist(), sp=hist.sp.tolist(), sy=hist.sy.tolist())
    g = g.assign(p_model=[o[0] for o in out], p_cal=[o[1] for o in out])
    return g[["ticker", "idx", "horizon", "p", "y", "p_model", "p_cal"]]


def calibrate(frame: DataFrame, kind: str = "multi") -> DataFrame:
    """Walk every (ticker, horizon) series on its own; kind is ``multi`` or ``regime``. Groups are single series."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return walk(g, int(key[1]), kind)

    cols = ["ticker", "idx", "horizon", "p", "y", *FEATURES]
    return frame.select(*cols).groupBy("ticker", "horizon").applyInPandas(run, "ticker string, idx int, horizon int, p double, y double, p_model double, p_cal double")


def train_states(frame: DataFrame, kind: str = "multi") -> DataFrame:
    """(ticker, horizon, state): what the calibrators of each series have learned by its last row, as JSON."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        end: dict = {}
        walk(g, int(key[1]), kind, end=end)
        return pd.DataFrame([{"ticker": key[0], "horizon": int(key[1]), "state": json.dumps(end)}])

    cols = ["ticker", "idx", "horizon", "p", "y", *FEATURES]
    return frame.select(*cols).groupBy("ticker", "horizon").applyInPandas(run, "ticker string, horizon int, state string")
