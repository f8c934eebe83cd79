"""Models that run along one series: hidden Markov, GARCH, changepoints, matrix profile, tabular Q-learning.

Each is sequential within a series and parallel over series (and parameter settings): along() hands one series at a time, in order, to a function.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def along(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over each series in order. A series is one task by nature of these models, so it must fit into one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(order, kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


class GaussianHMM:
    """Diagonal Gaussians, fitted by expectation maximisation in logs; starts from quantiles of the first feature, so it needs no seed."""

    def __init__(self, states: int = 2, rounds: int = 100, tol: float = 1e-4):
        self.k, self.rounds, self.tol = states, rounds, tol

    def _emission(self, x: np.ndarray) -> np.ndarray:
        return -0.5 * (((x[:, None] - self.mean) ** 2 / self.var) + np.log(2 * np.pi * self.var)).sum(axis=2)

    def _forward(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and log scales."""
        n = len(b)
        top = b.max(axis=1)
        e = np.exp(b - top[:, None])
        a, c = np.zeros_like(e), np.zeros(n)
        for t in range(n):
            p = (self.start if t == 0 else a[t - 1] @ self.trans) * e[t]
            s = max(p.sum(), 1e-300)
            a[t], c[t] = p / s, np.log(s) + top[t]
        return a, c

    def _smooth(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        a, c = self._forward(b)
        top = b.max(axis=1)
        e = np.exp(b - top[:, None]) / np.exp(c - top)[:, None]
        back = np.ones_like(a)
        for t in range(len(b) - 2, -1, -1):
            back[t] = self.trans @ (e[t + 1] * back[t + 1])
        post = a * back
        post /= post.sum(axis=1, keepdims=True)
        pairs = np.einsum("ti,ij,tj->ij", a[:-1], self.trans, e[1:] * back[1:])
        return a, post, pairs, float(c.sum())

    def fit(self, x: np.ndarray) -> GaussianHMM:
        k = self.k
        group = np.minimum((np.argsort(np.argsort(np.abs(x[:, 0]), kind="stable")) * k) // len(x), k - 1)
        self.mean = np.array([x[group == j].mean(axis=0) for j in range(k)])
        self.var = np.array([x[group == j].var(axis=0) for j in range(k)]) + 1e-8
        self.start, self.trans = np.full(k, 1 / k), np.full((k, k), 0.05 / max(k - 1, 1)) + np.eye(k) * (0.95 - 0.05 / max(k - 1, 1))
        last = -np.inf
        for _ in range(self.rounds):
            _, post, pairs, value = self._smooth(self._emission(x))
            w = post.sum(axis=0) + 1e-12
            self.start, self.trans = post[0], (pairs + 1e-12) / (pairs + 1e-12).sum(axis=1, keepdims=True)
            self.mean = post.T @ x / w[:, None]
            self.var = np.maximum(post.T @ (x * x) / w[:, None] - self.mean**2, 0) + 1e-8
            if value - last < self.tol:
                break
            last = value
        return self

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(filtered, smoothed): the filtered one uses no later observation and is the one to score in real time."""
        filtered, smoothed, _, _ = self._smooth(self._emission(x))
        return filtered, smoothed

    def lively(self) -> int:
        """The state with the largest variance of the first feature."""
        return int(np.argmax(self.var[:, 0]))


def hmm_scores(df: DataFrame, keys: list[str], at: str, features: list[str], states: int = 2) -> DataFrame:
    """(keys, at, filtered, smoothed): probability of the liveliest state; rows with null features are left out, series with fewer than 10 rows give none."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=features)
        x = pdf[features].to_numpy(float)
        if len(x) < 10:
            return pd.DataFrame({c: [] for c in [*keys, at, "filtered", "smoothed"]})
        m = GaussianHMM(states).fit(x)
        f, s = m.posteriors(x)
        j = m.lively()
        return pdf[[*keys, at]].assign(filtered=f[:, j], smoothed=s[:, j])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, at])
    return along(df, keys, [at], fn, f"{fields}, filtered double, smoothed double")


def garch_variance(ret: np.ndarray, omega: float, alpha: float, beta: float, first: float | None = None) -> np.ndarray:
    """Conditional variance of each row from the rows before it."""
    h = np.empty(len(ret))
    h[0] = ret.var() if first is None else first
    for t in range(1, len(ret)):
        h[t] = omega + alpha * ret[t - 1] ** 2 + beta * h[t - 1]
    return h


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, scale: np.ndarray, rounds: int = 400, tol: float = 1e-10) -> np.ndarray:
    """Downhill simplex."""
    n = len(start)
    pts = [np.array(start, float)] + [start + scale * np.eye(n)[i] for i in range(n)]
    vals = [f(p) for p in pts]
    for _ in range(rounds):
        o = np.argsort(vals, kind="stable")
        pts, vals = [pts[i] for i in o], [vals[i] for i in o]
        if abs(vals[-1] - vals[0]) <= tol * (abs(vals[0]) + tol):
            break
        c = np.mean(pts[:-1], axis=0)
        r = c + (c - pts[-1])
        fr = f(r)
        if fr < vals[0]:
            e = c + 2 * (c - pts[-1])
            fe = f(e)
            pts[-1], vals[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = r, fr
        else:
            k = c + 0.5 * ((r if fr < vals[-1] else pts[-1]) - c)
            fk = f(k)
            if fk < min(fr, vals[-1]):
                pts[-1], vals[-1] = k, fk
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))]


def fit_garch(ret: np.ndarray) -> tuple[float, float, float]:
    """(omega, alpha, beta) by maximum likelihood with the long-run variance held at the sample's."""
    v = max(float(ret.var()), 1e-18)

    def value(p: np.ndarray) -> float:
        persistence, part = 0.9999 / (1 + np.exp(-p[0])), 1 / (1 + np.exp(-p[1]))
        a, b = persistence * part, persistence * (1 - part)
        h = np.maximum(garch_variance(ret, v * (1 - a - b), a, b, v), 1e-18)
        return float((np.log(h) + ret**2 / h).sum())

    p = minimise(value, np.array([2.5, -2.0]), np.array([0.7, 0.7]), 200)
    persistence, part = 0.9999 / (1 + np.exp(-p[0])), 1 / (1 + np.exp(-p[1]))
    a, b = persistence * part, persistence * (1 - part)
    return v * (1 - a - b), a, b


def garch_forecast(h_next: np.ndarray, omega: float, alpha: float, beta: float, horizon: int) -> np.ndarray:
    """Sum of the variances of the next `horizon` rows, given that of the next one."""
    p = alpha + beta
    long_run = omega / (1 - p)
    weight = (1 - p**horizon) / (1 - p)
    return horizon * long_run + (h_next - long_run) * weight


def garch_scores(df: DataFrame, keys: list[str], at: str, ret: str, horizon: int = 1) -> DataFrame:
    """(keys, at, omega, alpha, beta, variance, forecast): the variance of each row, and the forecast over the next `horizon` rows."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[ret])
        r = pdf[ret].to_numpy(float)
        if len(r) < 20:
            return pd.DataFrame({c: [] for c in [*keys, at, "omega", "alpha", "beta", "variance", "forecast"]})
        o, a, b = fit_garch(r)
        h = garch_variance(r, o, a, b)
        nxt = o + a * r**2 + b * h
        return pdf[[*keys, at]].assign(omega=o, alpha=a, beta=b, variance=h, forecast=garch_forecast(nxt, o, a, b, horizon))

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, at])
    return along(df, keys, [at], fn, f"{fields}, omega double, alpha double, beta double, variance double, forecast double")


def matrix_profile(x: np.ndarray, m: int) -> np.ndarray:
    """Distance of each z-normalised subsequence of length m to its nearest one, at least m / 4 apart; row by row, so memory is linear."""
    n = len(x) - m + 1
    if n < 2:
        return np.full(max(n, 0), np.nan)
    c = np.concatenate([[0.0], np.cumsum(x)])
    c2 = np.concatenate([[0.0], np.cumsum(x * x)])
    mean = (c[m:] - c[:-m]) / m
    sd = np.sqrt(np.maximum((c2[m:] - c2[:-m]) / m - mean**2, 0))
    sd = np.where(sd < 1e-12, 1.0, sd)
    dots = np.array([x[i : i + m] @ x[:m] for i in range(n)])
    first = dots.copy()
    out, gap = np.full(n, np.inf), max(1, m // 4)
    for i in range(n):
        if i:
            dots[1:] = dots[:-1] - x[: n - 1] * x[i - 1] + x[m : m + n - 1] * x[i + m - 1]
            dots[0] = first[i]
        corr = (dots - m * mean * mean[i]) / (m * sd * sd[i])
        d = np.sqrt(np.maximum(2 * m * (1 - corr), 0))
        d[max(0, i - gap + 1) : i + gap] = np.inf
        out[i] = d.min()
    return out


def profile_scores(df: DataFrame, keys: list[str], at: str, value: str, m: int = 30) -> DataFrame:
    """(keys, at, profile): the profile of the subsequence that starts at the row. It sees the whole series."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value])
        p = matrix_profile(pdf[value].to_numpy(float), m)
        return pdf[[*keys, at]].iloc[: len(p)].assign(profile=p)

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, at])
    return along(df, keys, [at], fn, f"{fields}, profile double")


def changepoints(x: np.ndarray, penalty: float, least: int = 2) -> list[int]:
    """Optimal segmentation under the radial kernel cost (width by the median distance) with pruning; the ends of all segments but the last."""
    x = x.reshape(len(x), -1)
    n = len(x)
    if n < 2 * least:
        return []
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    positive = d[d > 0]
    k = np.exp(-d / (np.median(positive) if len(positive) else 1.0))
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = k.cumsum(axis=0).cumsum(axis=1)

    def cost(a: int, b: int) -> float:
        return (b - a) - (total[b, b] - total[a, b] - total[b, a] + total[a, a]) / (b - a)

    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    alive = [0]
    for t in range(least, n + 1):
        values = [best[s] + cost(s, t) + penalty for s in alive if t - s >= least]
        starts = [s for s in alive if t - s >= least]
        if values:
            j = int(np.argmin(values))
            best[t], back[t] = values[j], starts[j]
            alive = [s for s in alive if t - s < least or best[s] + cost(s, t) <= best[t]]
        alive.append(t - least + 1)
        alive = sorted(set(alive))
    out, t = [], back[n]
    while t > 0:
        out.append(int(t))
        t = back[t]
    return out[::-1]


def changepoint_times(df: DataFrame, keys: list[str], at: str, value: str, penalties: list[float]) -> DataFrame:
    """(keys, penalty, at): first rows of new segments, for each penalty."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value])
        x = pdf[value].to_numpy(float)
        parts = []
        for p in penalties:
            cut = changepoints((x - x.mean()) / max(x.std(), 1e-12), p) if len(x) else []
            parts.append(pdf[[*keys, at]].iloc[cut].assign(penalty=float(p)))
        return pd.concat(parts) if parts else pdf[[*keys, at]].iloc[:0].assign(penalty=0.0)

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, at])
    return along(df, keys, [at], fn, f"{fields}, penalty double")


LEVELS = np.array([-1.0, 0.0, 1.0])
FLAT = 1


def q_learn(
    state: np.ndarray, ret: np.ndarray, vol: np.ndarray, states: int, epochs: int = 400, gamma: float = 0.95, eps: tuple[float, float] = (0.3, 0.02), least_rate: float = 0.01,
    cost: float = 0.0005, risk: float = 0.1, seed: int = 0, abreast: int = 40,
) -> np.ndarray:
    """(states, levels): table of action values from `epochs` walks along the series (fixed values: the settings above; each walk starts flat, and walks explore less and less).

    `abreast` walks go side by side and share the table: at a row all are in the same market state, so a row is one array step. What its walks found for an action moves the
    action's value towards their mean, by as much as that many single steps at the rate of one over the visits (not below `least_rate`) would."""
    rng = np.random.default_rng(seed)
    table, visits = np.zeros((states, len(LEVELS))), np.zeros((states, len(LEVELS)))
    gain = ret[:, None] * LEVELS - risk * (vol[:, None] * LEVELS) ** 2
    toll = cost * np.abs(LEVELS[:, None] - LEVELS)
    for curious in np.array_split(np.linspace(*eps, epochs), max(1, -(-epochs // abreast))):
        walks = len(curious)
        guess = rng.integers(len(LEVELS), size=(len(state), walks))
        guess[rng.random(guess.shape) >= curious] = -1
        held = np.full(walks, FLAT)
        for row, (here, there) in enumerate(zip(state, [*state[1:], -1])):
            chosen = np.where(guess[row] < 0, table[here].argmax(), guess[row])
            worth = gain[row, chosen] - toll[chosen, held] + (gamma * table[there].max() if there >= 0 else 0.0)
            tally, total = (np.bincount(chosen, v, len(LEVELS)) for v in (None, worth))
            visits[here] += tally
            pull = 1 - (1 - np.maximum(least_rate, 1 / np.maximum(visits[here], 1))) ** tally
            table[here] += pull * (total / np.maximum(tally, 1) - table[here])
            held = chosen
    return table


def greedy(state: np.ndarray, ret: np.ndarray, q: np.ndarray, cost: float = 0.0005) -> tuple[np.ndarray, np.ndarray]:
    """(positions, returns after costs) of the best action in each state."""
    w = LEVELS[q.argmax(axis=1)[state]]
    return w, w * ret - cost * np.abs(np.diff(w, prepend=0.0))


def q_policy(df: DataFrame, keys: list[str], at: str, state: str, ret: str, vol: str, states: int = 12, train: float = 0.65, purge: int = 20, epochs: int = 400) -> DataFrame:
    """(keys, at, position, strategy_return) on the rows after the train share of each series; the policy is learned on the earlier rows less a purge."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[state, ret, vol])
        cut = int(len(pdf) * train)
        a, b = pdf.iloc[: max(0, cut - purge)], pdf.iloc[cut:]
        if not len(a):
            return pdf[[*keys, at]].iloc[:0].assign(position=0.0, strategy_return=0.0)
        q = q_learn(a[state].to_numpy(int), a[ret].to_numpy(float), a[vol].to_numpy(float), states, epochs)
        w, r = greedy(b[state].to_numpy(int), b[ret].to_numpy(float), q)
        return b[[*keys, at]].assign(position=w, strategy_return=r)

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, at])
    return along(df, keys, [at], fn, f"{fields}, position double, strategy_return double")
