"""One-class detectors; scores are higher for more anomalous vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import hash_sample

#: Most reference vectors a detector is fitted on; a hash of the id picks them, so every run picks the same. All vectors are scored.
FIT_ROWS = 2000


class Scaler:
    """Zero mean and unit population deviation; constant columns stay."""

    def fit(self, x: np.ndarray) -> Scaler:
        self.mean, sd = x.mean(axis=0), x.std(axis=0)
        self.sd = np.where(sd < 1e-12, 1.0, sd)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd


class PCA:
    """Centred principal components; used when the width exceeds half the number of rows."""

    def __init__(self, k: int):
        self.k = k

    def fit(self, x: np.ndarray) -> PCA:
        self.mean = x.mean(axis=0)
        _, self.s, vt = np.linalg.svd(x - self.mean, full_matrices=False)
        self.v = vt[: self.k].T
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.v


class OneClassSVM:
    """Radial kernel with width 1 / (d var(x)); the dual is solved by pairwise steps on the most violating pair."""

    def __init__(self, nu: float = 0.05, steps: int = 20_000, tol: float = 1e-5):
        self.nu, self.steps, self.tol = nu, steps, tol

    def fit(self, x: np.ndarray) -> OneClassSVM:
        self.scaler = Scaler().fit(x)
        x = self.scaler(x)
        n = len(x)
        self.gamma = 1.0 / (x.shape[1] * max(x.var(), 1e-12))
        k = self._kernel(x, x)
        cap = 1.0 / (self.nu * n)
        a = np.zeros(n)
        full = int(self.nu * n)
        a[:full] = cap
        if full < n:
            a[full] = 1.0 - full * cap
        g = k @ a
        for _ in range(self.steps):
            up, down = a < cap - 1e-15, a > 1e-15
            i = int(np.argmin(np.where(up, g, np.inf)))
            j = int(np.argmax(np.where(down, g, -np.inf)))
            if g[j] - g[i] < self.tol:
                break
            t = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), cap - a[i], a[j])
            a[i] += t
            a[j] -= t
            g += t * (k[:, i] - k[:, j])
        inner = (a > 1e-12) & (a < cap - 1e-12)
        self.rho = float(g[inner].mean() if inner.any() else (g[a > 1e-12].max() + g[a < cap - 1e-12].min()) / 2)
        keep = a > 1e-12
        self.x, self.a = x[keep], a[keep]
        return self

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
        return np.exp(-self.gamma * np.maximum(d, 0))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.rho - self._kernel(self.scaler(x), self.x) @ self.a


class IsolationForest:
    def __init__(self, trees: int = 300, size: int = 256, seed: int = 0):
        self.trees, self.size, self.seed = trees, size, seed

    @staticmethod
    def _mean_depth(n: float) -> float:
        return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        self.n = min(self.size, len(x))
        limit = int(np.ceil(np.log2(max(self.n, 2))))

        def grow(rows: np.ndarray, depth: int):
            spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(x.shape[1])
            choices = np.flatnonzero(spread > 0)
            if depth >= limit or len(rows) < 2 or not len(choices):
                return depth + self._mean_depth(len(rows))
            f = int(rng.choice(choices))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = rows[:, f] < cut
            return f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)

        self.forest = [grow(x[rng.choice(len(x), self.n, replace=False)], 0) for _ in range(self.trees)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))

        def walk(node, at: np.ndarray) -> None:
            if isinstance(node, tuple):
                left = x[at, node[0]] < node[1]
                if left.any():
                    walk(node[2], at[left])
                if not left.all():
                    walk(node[3], at[~left])
            else:
                total[at] += node

        for tree in self.forest:
            walk(tree, np.arange(len(x)))
        return np.exp2(-total / self.trees / max(self._mean_depth(self.n), 1e-12))


class LocalOutlierFactor:
    def __init__(self, k: int = 20):
        self.k = k

    def fit(self, x: np.ndarray) -> LocalOutlierFactor:
        self.x, self.k = x, min(self.k, len(x) - 1)
        d = self._distances(x)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1)[:, : self.k]
        self.kdist = np.take_along_axis(d, near, 1)[:, -1]
        self.density = 1.0 / (np.maximum(np.take_along_axis(d, near, 1), self.kdist[near]).mean(axis=1) + 1e-10)
        return self

    def _distances(self, a: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (self.x * self.x).sum(1)[None] - 2 * a @ self.x.T, 0))

    def score(self, x: np.ndarray) -> np.ndarray:
        d = self._distances(x)
        near = np.argsort(d, axis=1)[:, : self.k]
        reach = np.maximum(np.take_along_axis(d, near, 1), self.kdist[near]).mean(axis=1)
        return self.density[near].mean(axis=1) * (reach + 1e-10)


class RobustEnvelope:
    """Mahalanobis distance under the covariance of the half of the rows that lies closest together (concentration steps from several starts)."""

    def __init__(self, starts: int = 10, seed: int = 0):
        self.starts, self.seed = starts, seed

    def fit(self, x: np.ndarray) -> RobustEnvelope:
        rng = np.random.default_rng(self.seed)
        n, d = x.shape
        h = (n + d + 1) // 2
        best = np.inf
        for _ in range(self.starts):
            rows = rng.choice(n, min(n, d + 1), replace=False)
            for _ in range(20):
                mean = x[rows].mean(axis=0)
                cov = np.cov(x[rows].T, bias=True).reshape(d, d) + 1e-9 * np.eye(d)
                dist = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
                new = np.sort(np.argsort(dist, kind="stable")[:h])
                if len(new) == len(rows) and (new == rows).all():
                    break
                rows = new
            _, log_det = np.linalg.slogdet(cov)
            if log_det < best:
                best, self.mean, self.precision = log_det, mean, np.linalg.pinv(cov)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk,ik->i", x - self.mean, self.precision, x - self.mean)


DETECTORS = {"ocsvm": OneClassSVM, "iforest": IsolationForest, "lof": LocalOutlierFactor, "envelope": RobustEnvelope}


def bounded_sample(df: DataFrame, vector: str, key: str, rows: int = FIT_ROWS) -> np.ndarray:
    """At most `rows` vectors, those with the smallest hash of the key."""
    got = hash_sample(df.where(F.col(vector).isNotNull()).select(vector, key), [key], rows).collect()
    return np.array([r[0] for r in got], float)


def scored(df: DataFrame, reference: DataFrame, vector: str, key: str, detectors: list[str] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """df with a score column per detector, each fitted on a bounded sample of the reference vectors. Wide vectors (more than half the sample) are projected to
    half the sample's number of principal components first. Null vectors get null scores; fewer than three reference vectors are an error."""
    x = bounded_sample(reference, vector, key, fit_rows)
    if len(x) < 3:
        raise ValueError("a detector needs at least three reference vectors")
    reduce = PCA(max(1, len(x) // 2)).fit(x) if x.shape[1] > len(x) / 2 else (lambda v: v)
    models = {name: DETECTORS[name]().fit(reduce(x)) for name in detectors or DETECTORS}
    schema = df.select("*", *[F.lit(None).cast("double").alias(name) for name in models]).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = pdf[vector].notna().to_numpy()
            out = pdf.copy()
            v = np.array(pdf[vector][ok].tolist(), float)
            for name, m in models.items():
                s = np.full(len(pdf), np.nan)
                if ok.any():
                    s[ok] = m.score(reduce(v))
                out[name] = pd.Series(s, index=pdf.index).where(ok, None)
            yield out

    return df.mapInPandas(run, schema)
