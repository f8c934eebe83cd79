"""Least squares, heterogeneous autoregressive forecasts, ridge with time-ordered validation: from Gram matrices summed in the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.frames import with_frames
from tidewright.operators.scores import WIDEST, dot

ALPHAS = np.logspace(-4, 5, 30)


def gram(df: DataFrame, x: str, y: str, group: str | None = None) -> dict[object, tuple[float, np.ndarray]]:
    """By group: (rows, Z^T Z) with Z = (1, x, y). One pass; what reaches the driver is the square of the checked width for each group."""
    width = df.select(F.max(F.size(x))).first()[0]
    if width is None:
        return {}
    if width > WIDEST:
        raise ValueError(f"more than {WIDEST} features")
    size = width + 2
    upper = np.triu_indices(size)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), (F.col(group) if group else F.lit(0)).cast("int").alias("g"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), np.array(pdf["x"].tolist(), float).reshape(len(pdf), width), pdf["y"].to_numpy(float)])
            for g in np.unique(pdf["g"]):
                part = z[(pdf["g"] == g).to_numpy()]
                total[int(g)] = total.get(int(g), 0) + part.T @ part
        for g, q in total.items():
            yield pd.DataFrame({"g": g, "i": range(len(upper[0])), "v": q[upper]})

    sums = rows.mapInPandas(run, "g int, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).toArrow()
    at, i, v = (sums[c].to_numpy() for c in ("g", "i", "v"))
    out: dict[object, tuple[float, np.ndarray]] = {}
    for g in np.unique(at):
        q = np.zeros((size, size))
        own = i[at == g]
        q[upper[0][own], upper[1][own]] = q[upper[1][own], upper[0][own]] = v[at == g]
        out[int(g)] = (q[0, 0], q)
    return out


def solve(q: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """Coefficients (intercept first) from Z^T Z; the penalty acts on features scaled to unit population deviation and not on the intercept."""
    n, p = q[0, 0], len(q) - 2
    mean = q[0, 1:-1] / n
    cov = q[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd < 1e-12, 1.0, sd)
    c = q[1:-1, -1] / n - mean * q[0, -1] / n
    b = np.linalg.lstsq(cov / np.outer(sd, sd) + penalty / n * np.eye(p), c / sd, rcond=None)[0] / sd
    return np.concatenate([[q[0, -1] / n - mean @ b], b])


def solve_each(q: np.ndarray, penalties: np.ndarray) -> list[np.ndarray]:
    """solve() for each penalty above nought, from one decomposition."""
    n = q[0, 0]
    mean = q[0, 1:-1] / n
    cov = q[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd < 1e-12, 1.0, sd)
    w, axes = np.linalg.eigh(cov / np.outer(sd, sd))
    c = axes.T @ ((q[1:-1, -1] / n - mean * q[0, -1] / n) / sd)
    bs = [axes @ (c / (np.maximum(w, 0) + a / n)) / sd for a in penalties]
    return [np.concatenate([[q[0, -1] / n - mean @ b], b]) for b in bs]


def squared_error(q: np.ndarray, b: np.ndarray) -> float:
    v = np.concatenate([-b, [1.0]])
    return float(v @ q @ v)


def ridge(df: DataFrame, x: str, y: str, fold: str, alphas: np.ndarray = ALPHAS) -> tuple[np.ndarray, float]:
    """(coefficients, penalty): time-ordered validation - block k is predicted from the blocks before it - over the sums of each block, then a fit on all."""
    g = gram(df, x, y, fold)
    blocks = [g[k][1] for k in sorted(g)]
    if len(blocks) < 2:
        return solve(sum(blocks), float(alphas[0])), float(alphas[0])
    seen, errors = blocks[0], np.zeros(len(alphas))
    for b in blocks[1:]:
        errors += [squared_error(b, s) for s in solve_each(seen, alphas)]
        seen = seen + b
    best = float(alphas[int(np.argmin(errors))])
    return solve(sum(blocks), best), best


def predict(x: Column, b: np.ndarray) -> Column:
    return F.lit(float(b[0])) + dot(x, F.array(*[F.lit(float(v)) for v in b[1:]]))


def har(df: DataFrame, x: str, log_y: str, train: Column, steps: int, at: str, lags: int = 5, errors_by: list[str] | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray | None]:
    """(df with `prediction`, coefficients, standard errors if `errors_by` names the keys of a series): log mean variance on HAR features by least squares over the train rows; back from logs with the smearing
    factor mean(exp(residual)), then the root of `steps` times the mean variance, at least 1e-8. Standard errors are robust to autocorrelation up to `lags` rows
    (Bartlett weights), from sums of lagged products along the order of `at` within each series."""
    own = df.where(train & F.col(x).isNotNull() & F.col(log_y).isNotNull())
    q = gram(own, x, log_y)[0][1]
    b = solve(q)
    own = own.withColumn("_e", F.col(log_y) - predict(F.col(x), b))
    smear = own.agg(F.avg(F.exp("_e"))).first()[0]
    out = df.withColumn("prediction", F.greatest(F.sqrt(steps * F.exp(predict(F.col(x), b)) * smear), F.lit(1e-8)))
    if errors_by is None:
        return out, b, None
    z = own.select(*errors_by, at, F.transform(F.concat(F.array(F.lit(1.0)), F.col(x)), lambda v: v * F.col("_e")).alias("u"))
    p = len(b)
    cols = [F.sum(F.get("u", F.lit(i)) * F.get(f"l{k}", F.lit(j))).alias(f"s_{k}_{i}_{j}") for k in range(lags + 1) for i in range(p) for j in range(p)]
    z = with_frames(z, errors_by, at, [at], lags + 1, 0, lambda w: {f"l{k}": F.lag("u", k).over(w) for k in range(lags + 1)})
    s = z.agg(*cols).first()
    meat = np.zeros((p, p))
    for k in range(lags + 1):
        m = np.array([[s[f"s_{k}_{i}_{j}"] or 0.0 for j in range(p)] for i in range(p)])
        meat += m if k == 0 else (1 - k / (lags + 1)) * (m + m.T)
    bread = np.linalg.pinv(q[:-1, :-1])
    se = np.sqrt(np.maximum(np.diag(bread @ meat @ bread), 0))
    return out, b, se


def multinomial(x: np.ndarray, y: np.ndarray, classes: int, penalty: float = 0.01, rounds: int = 400) -> np.ndarray:
    """(features + 1, classes): logistic weights, the intercept's last, by accelerated gradient steps on columns of unit deviation (x must be so scaled)."""
    z = np.column_stack([x, np.ones(len(x))])
    truth, w, v = np.eye(classes)[y], np.zeros((z.shape[1], classes)), np.zeros((z.shape[1], classes))
    step = 1 / (0.5 * np.linalg.norm(z, 2) ** 2 / len(z) + penalty)
    for t in range(rounds):
        s = z @ v
        e = np.exp(s - s.max(axis=1, keepdims=True))
        new = v - step * (z.T @ (e / e.sum(axis=1, keepdims=True) - truth) / len(z) + penalty * v)
        w, v = new, new + t / (t + 3) * (new - w)
    return w


def shape_folds(df: DataFrame, folds: int) -> DataFrame:
    """(id, fold, y, prediction) of each row (id, y, sig), predicted by a multinomial model fitted on the other folds, by id. A fold is one task with all rows, so it is meant for
    bounded tables such as synthetic paths."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, test = np.array(pdf["sig"].tolist(), float), (pdf["id"] % folds == pdf["fold"]).to_numpy()
        y = pdf["y"].to_numpy(int)
        mean, sd = x[~test].mean(axis=0), x[~test].std(axis=0)
        x = (x - mean) / np.where(sd < 1e-12, 1.0, sd)
        w = multinomial(x[~test], y[~test], int(y.max()) + 1)
        return pdf.loc[test, ["id", "fold", "y"]].assign(prediction=(np.column_stack([x[test], np.ones(test.sum())]) @ w).argmax(axis=1))

    each = df.select("id", "y", "sig", F.explode(F.array(*[F.lit(k) for k in range(folds)])).alias("fold"))
    return each.groupBy("fold").applyInPandas(run, "id bigint, fold int, y int, prediction int")
