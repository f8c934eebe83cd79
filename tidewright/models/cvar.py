"""One-class machine with a smooth tail-risk objective that depends on the expected signature only.

minimise |w|^2 / 2 + min over rho of sum_m b_m rho^m, where the hinge is replaced by its least-squares polynomial a on [-K, K] and
b_m = [m = 1] + (sum_{i >= m} a_i C(i, m) (-1)^m <(-w)^{shuffle (i - m)}, E S>) / (1 - alpha).
The shuffle powers are multilinear in w, so their pairings with E S are tabled once; what is left is small and runs on the driver.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.signature import shuffle_elements, signature_dim, with_signature
from tidewright.operators.scores import dot, mean_array


class TailRiskMachine:
    def __init__(self, d: int, depth: int = 2, alpha: float = 0.9, k: float = 10.0, degree: int = 2):
        self.d, self.depth, self.alpha, self.k, self.degree = d, depth, alpha, k, degree

    def _tables(self, expected: np.ndarray) -> list[np.ndarray]:
        """Symmetric tensors t_k with t_k[w, ..., w] = <w^{shuffle k}, E S>."""
        d, n = self.d, signature_dim(self.d, self.depth)
        levels, at = [np.ones(1)], 0
        for j in range(1, self.depth * self.degree + 1):
            levels.append(expected[at : at + d**j])
            at += d**j
        words = [(j, i) for j in range(1, self.depth + 1) for i in range(d**j)]

        def unit(word: tuple[int, int]) -> list[np.ndarray]:
            e = [np.zeros(d**j) for j in range(self.depth + 1)]
            e[word[0]][word[1]] = 1.0
            return e

        tables = [np.array(1.0)]
        for k in range(1, self.degree + 1):
            t = np.zeros((n,) * k)
            for idx in itertools.combinations_with_replacement(range(n), k):
                e = [np.ones(1)]
                for i in idx:
                    e = shuffle_elements(e, unit(words[i]), d)
                v = sum(float(a @ b) for a, b in zip(e, levels))
                for p in set(itertools.permutations(idx)):
                    t[p] = v
            tables.append(t)
        return tables

    def _powers(self, w: np.ndarray) -> tuple[list[float], list[np.ndarray]]:
        """Pairings of the powers of -w, and their gradients in w."""
        values, slopes = [], []
        for k, t in enumerate(self.tables):
            part = t
            for _ in range(k - 1):
                part = part @ -w
            values.append(float(part @ -w) if k else 1.0)
            slopes.append(-k * part if k else np.zeros(len(w)))
        return values, slopes

    def _value(self, w: np.ndarray) -> tuple[float, np.ndarray, float]:
        p, g = self._powers(w)
        b, db = np.zeros(self.degree + 1), np.zeros((self.degree + 1, len(w)))
        for m in range(self.degree + 1):
            for i in range(m, self.degree + 1):
                c = self.a[i] * comb(i, m) * (-1) ** m / (1 - self.alpha)
                b[m] += c * p[i - m]
                db[m] += c * g[i - m]
            b[m] += m == 1
        roots = np.roots(np.polyder(b[::-1])) if np.any(b[1:]) else np.array([])
        spots = [-self.k, self.k, *(float(r.real) for r in roots if abs(r.imag) < 1e-9 and abs(r.real) < self.k)]
        rho = min(spots, key=lambda r: np.polyval(b[::-1], r))
        return 0.5 * w @ w + float(np.polyval(b[::-1], rho)), w + rho ** np.arange(self.degree + 1) @ db, rho

    def fit(self, expected: np.ndarray, typical_norm: float, rounds: int = 500) -> TailRiskMachine:
        """expected: mean signature to depth * degree; projected gradient with a backtracking step inside |w_i| <= K / typical norm."""
        xs = np.linspace(-self.k, self.k, 4000)
        self.a = np.polyfit(xs, np.maximum(xs, 0.0), self.degree)[::-1]
        self.tables = self._tables(expected)
        bound = self.k / max(typical_norm, 1e-6)
        w = np.zeros(signature_dim(self.d, self.depth))
        value, grad, self.rho = self._value(w)
        step = bound / max(np.abs(grad).max(), 1e-12)
        for _ in range(rounds):
            while step > 1e-18:
                new = np.clip(w - step * grad, -bound, bound)
                v, g, rho = self._value(new)
                if v <= value - 1e-4 * float(grad @ (w - new)):
                    break
                step /= 2
            else:
                break
            done = value - v < 1e-12 * (1 + abs(value))
            w, value, grad, self.rho = new, v, g, rho
            step *= 2
            if done:
                break
        self.w, self.value = w, value
        return self


def tail_risk_scores(df: DataFrame, reference: DataFrame, d: int, depth: int = 2, path: str = "path", **settings: float) -> DataFrame:
    """df with `score` = rho - <w, S(path)>. Expected signatures and the median norm are taken over all reference paths in the executors."""
    m = TailRiskMachine(d, depth, **settings)
    deep = with_signature(reference, depth * m.degree, path, "_deep")
    short = F.slice("_deep", 1, signature_dim(d, depth))
    norm = deep.select(F.sqrt(dot(short, short)).alias("n")).agg(F.percentile_approx("n", 0.5, 10_000)).first()[0]
    expected = mean_array(deep.where("_deep is not null"), "_deep", []).first()
    if expected is None or norm is None:
        raise ValueError("no reference paths")
    m.fit(np.array(expected[0]), float(norm))
    w = F.array(*[F.lit(float(x)) for x in m.w])
    return with_signature(df, depth, path, "_sig").withColumn("score", F.lit(m.rho) - dot(F.col("_sig"), w)).drop("_sig")
