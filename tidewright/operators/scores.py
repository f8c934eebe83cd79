"""Distances of vectors to a reference, calibration, ranking metrics and test statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.frames import with_frames
from tidewright.operators.ranks import value_ranks
from tidewright.session import small

#: Widest vector whose second moments go to the driver (width squared doubles).
WIDEST = 2048


def mean_vectors(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """(keys, pos, mean): elementwise mean of arrays of equal length. Partial sums before the shuffle."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def mean_array(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    m = mean_vectors(df, vector, keys)
    return m.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("mean"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def expected_distance(df: DataFrame, reference: DataFrame, vector: str) -> DataFrame:
    """df with `score`: Euclidean distance of each vector to the mean of the reference vectors (one row, broadcast)."""
    return df.crossJoin(F.broadcast(mean_array(reference, vector, []))).withColumn("score", distance(F.col(vector), F.col("mean"))).drop("mean")


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum x, sum x x^T) of the vectors, summed in the executors; of fixed size, as the width is checked."""
    width = (df.select(F.max(F.size(vector))).first()[0]) or 0
    if width > WIDEST:
        raise ValueError(f"vectors wider than {WIDEST}")

    def run(batches):
        import pandas as pd

        n, s, q = 0, np.zeros(width), np.zeros((width, width))
        for pdf in batches:
            x = np.array(pdf[vector].tolist(), float).reshape(-1, width)
            n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    parts = df.where(F.col(vector).isNotNull()).select(vector).mapInPandas(run, "n bigint, s array<double>, q array<double>")
    rows = parts.select("n", F.posexplode(F.concat("s", "q")).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect() if width else []
    flat = np.zeros(width + width * width)
    n = 0
    for r in rows:
        flat[r["i"]], n = r["v"], int(r["n"])
    return n, flat[:width], flat[width:].reshape(width, width)


def ledoit_wolf(n: int, s: np.ndarray, q: np.ndarray, fourth: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, shrunk covariance, shrinkage) towards the mean variance times the identity; fourth: mean of the squared norms' squares of centred vectors."""
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    p = len(s)
    mu = np.trace(cov) / p
    delta = ((cov - mu * np.eye(p)) ** 2).sum() / p
    beta = min((fourth / n - (cov**2).sum()) / (n * p), delta)
    shrink = 0.0 if delta == 0 else max(0.0, beta) / delta
    return mean, (1 - shrink) * cov + shrink * mu * np.eye(p), shrink


def mahalanobis(df: DataFrame, reference: DataFrame, vector: str) -> DataFrame:
    """df with `score`: Mahalanobis distance to the reference mean under the shrunk covariance of the reference vectors."""
    n, s, q = moments(reference, vector)
    mean = s / max(n, 1)
    centred = F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a.cast("double") - b)
    norm = F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x)
    fourth = reference.agg(F.avg(norm * norm)).first()[0] * n
    mean, cov, _ = ledoit_wolf(n, s, q, fourth / 1.0)
    root = np.linalg.cholesky(np.linalg.pinv(cov) + 1e-15 * np.eye(len(mean)))

    @F.pandas_udf("double")
    def score(batches):
        import pandas as pd

        return pd.Series(np.linalg.norm((np.array(batches.tolist(), float).reshape(-1, len(mean)) - mean) @ root, axis=1))

    import pandas as pd

    score.func.__annotations__ = {"batches": pd.Series, "return": pd.Series}
    return df.withColumn("score", score(F.col(vector)))


def mmd_squared(x: DataFrame, y: DataFrame, vector: str) -> DataFrame:
    """One row: unbiased squared maximum mean discrepancy with the linear kernel, from sums only; with one x vector its own term is its squared norm."""

    def parts(df: DataFrame, p: str) -> DataFrame:
        sums = df.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v").cast("double")).alias("s"))
        sums = sums.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda z: z["s"]).alias(f"{p}s"))
        own = df.agg(F.sum(dot(F.col(vector), F.col(vector))).alias(f"{p}q"), F.count("*").alias(f"{p}n"))
        return sums.crossJoin(F.broadcast(own))  # one row each

    both = parts(x, "x").crossJoin(F.broadcast(parts(y, "y")))
    m, n = F.col("xn"), F.col("yn")
    xx = F.when(m > 1, (dot(F.col("xs"), F.col("xs")) - F.col("xq")) / F.when(m > 1, m * (m - 1))).otherwise(F.col("xq"))
    yy = (dot(F.col("ys"), F.col("ys")) - F.col("yq")) / F.when(n > 1, n * (n - 1))
    return both.select((xx + yy - 2 * dot(F.col("xs"), F.col("ys")) / (m * n)).alias("mmd2"), m.alias("m"), n.alias("n"))


def trailing_mmd(windows: DataFrame, reference: DataFrame, vector: str, keys: list[str], order: list[str], batch: int) -> DataFrame:
    """windows with `mmd2` of the last `batch` vectors (those up to the row) against the reference; null until there are so many. keys must bound a series to a
    size one task can sort; frames are running arrays of fixed width."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(batch - 1), 0)
    r = reference.select(F.posexplode(vector).alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v").cast("double")).alias("s"))
    r = r.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda z: z["s"]).alias("_ys")).crossJoin(F.broadcast(reference.agg(F.sum(dot(F.col(vector), F.col(vector))).alias("_yq"), F.count("*").alias("_yn"))))
    x = windows.withColumns({"_xs": F.collect_list(vector).over(w), "_q": dot(F.col(vector), F.col(vector))}).withColumns({"_xq": F.sum("_q").over(w), "_m": F.size("_xs")})
    total = F.aggregate(F.slice("_xs", 2, batch), F.get("_xs", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    x = x.withColumn("_s", total).crossJoin(F.broadcast(r))  # one row
    m, n = F.col("_m"), F.col("_yn")
    xx = F.when(m > 1, (dot(F.col("_s"), F.col("_s")) - F.col("_xq")) / F.when(m > 1, m * (m - 1))).otherwise(F.col("_xq"))
    yy = (dot(F.col("_ys"), F.col("_ys")) - F.col("_yq")) / F.when(n > 1, n * (n - 1))
    return x.withColumn("mmd2", F.when(m == batch, xx + yy - 2 * dot(F.col("_s"), F.col("_ys")) / (m * n))).select(*windows.columns, "mmd2")


def calibrated(scores: DataFrame, calibration: DataFrame, score: str) -> DataFrame:
    """scores with `p_value`: (1 + calibration scores at least as high) / (n + 1). Scores that are null or NaN are left out.

    Distinct scores of both tables are counted and ranked together; each gets its p value once, and rows find theirs by an equi-join on the score."""
    both = scores.select(F.col(score).cast("double").alias("_s"), F.lit(0).alias("_y")).unionByName(calibration.select(F.col(score).cast("double").alias("_s"), F.lit(1).alias("_y")))
    r = value_ranks(both, [], "_s", {"cal": F.col("_y")})
    p = r.select("_v", ((1 + F.col("cal_total") - F.col("cal_upto") + F.col("cal")) / (F.col("cal_total") + 1)).alias("p_value"))
    return scores.join(p, F.col(score).cast("double") == p["_v"]).drop("_v")


def weibull_tail(calibration: DataFrame, score: str, depth: int, tail: float = 0.3) -> DataFrame:
    """One row (a, b, n): fit of ln survival = ln a - b score^(2/depth) over the ordered scores above the share 1 - tail."""
    ranked = value_ranks(calibration, [], score).select(F.col("_v").alias("s"), (F.col("_upto") - F.col("_n")).alias("below"), F.col("_n").alias("k"), F.col("_total").alias("n"))
    each = ranked.withColumn("i", F.explode(F.sequence(F.col("below") + 1, F.col("below") + F.col("k")))).where(F.col("i") > F.floor((1 - tail) * F.col("n")))
    y, x = F.log(1 - F.col("i") / (F.col("n") + 1)), F.pow("s", F.lit(2.0 / depth))
    return each.agg(F.exp(F.regr_intercept(y, x)).alias("a"), (-F.regr_slope(y, x)).alias("b"), F.max("n").alias("n"))


def weibull_p(score: Column, a: Column, b: Column, depth: int) -> Column:
    return F.least(a * F.exp(-b * F.pow(score, F.lit(2.0 / depth))), F.lit(1.0))


def weibull_threshold(alpha: float, a: float, b: float, depth: int) -> float:
    if alpha >= a:
        raise ValueError("alpha must lie below the fitted constant")
    return (math.log(a / alpha) / b) ** (depth / 2)


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.1) -> DataFrame:
    """df with `rejected`: p at most the largest p(i) with p(i) <= i q / n; ties are rejected together. Counts by value of p before the ranking."""
    ranked = value_ranks(df, [], p)
    cut = ranked.agg(F.max(F.when(F.col("_v") <= F.col("_upto") * q / F.col("_total"), F.col("_v"))).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")  # one row


def rank_metrics(df: DataFrame, score: Column, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, auroc, u, z, n_pos, n_neg): area under the curve, rank-sum statistic of the positives and its tie-corrected normal deviate."""
    keys = keys or []
    x = df.select(*keys, score.alias("_s"), positive.cast("int").alias("_y")).where("_y is not null")
    ranked = value_ranks(x, keys, "_s", {"y": F.col("_y")})
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    n1, n = F.sum("y"), F.sum("_n")
    n0 = n - n1
    u = F.sum(F.col("y") * rank) - n1 * (n1 + 1) / 2
    k = F.col("_n").cast("double")
    ties = F.sum(k * k * k - k)
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - ties / F.when(n > 1, n * (n - 1))))
    return ranked.groupBy(*keys).agg(F.try_divide(u, n1 * n0).alias("auroc"), u.alias("u"), F.try_divide(u - n1 * n0 / 2, sd).alias("z"), n1.alias("n_pos"), n0.alias("n_neg"))


def precision_at_k(df: DataFrame, score: Column, positive: Column, tie: list[Column], k: int) -> DataFrame:
    top = df.select(positive.cast("int").alias("_y"), score.alias("_s"), *[t.alias(f"_t{i}") for i, t in enumerate(tie)]).orderBy(F.desc("_s"), *[f"_t{i}" for i in range(len(tie))]).limit(k)
    return top.agg(F.avg("_y").alias("precision_at_k")).withColumn("k", F.lit(k))


def discovery_rates(df: DataFrame, rejected: Column, positive: Column) -> DataFrame:
    """One row: false discovery rate (nought without rejections) and power (null without positives)."""
    r, p = rejected.cast("int"), positive.cast("int")
    return df.agg(F.coalesce(F.try_divide(F.sum(r * (1 - p)), F.sum(r)), F.lit(0.0)).alias("fdr"), F.try_divide(F.sum(r * p), F.sum(p)).alias("power"))


def classification(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    t, p = truth.cast("int"), predicted.cast("int")
    x = df.select(t.alias("t"), p.alias("p")).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum((1 - F.col("t")) * F.col("p")).alias("fp"), F.sum(F.col("t") * (1 - F.col("p"))).alias("fn"), F.sum((1 - F.col("t")) * (1 - F.col("p"))).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, precision = F.try_divide(tp, tp + fn), F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    return x.select(*x.columns, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ((recall + F.try_divide(tn, tn + fp)) / 2).alias("balanced"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def regression_metrics(df: DataFrame, truth: str, predicted: str, keys: list[str]) -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * F.count(truth))).alias("r2"), F.count("*").alias("n"))


def t_test(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, t, p, n): one-sample test against nought."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    t = F.try_divide("mean", F.col("sd") / F.sqrt("n"))

    @F.pandas_udf("double")
    def p(t, n):
        import pandas as pd

        return pd.Series([None if a is None or a != a or b < 2 else student_p(a, int(b) - 1) for a, b in zip(t, n)], dtype=float)

    import pandas as pd

    p.func.__annotations__ = {"t": pd.Series, "n": pd.Series, "return": pd.Series}
    return m.select(*keys, "mean", t.alias("t"), "n").withColumn("p", p("t", "n"))


def student_p(t: float, df: int) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * fraction(1 - x, b, a) / b


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def diebold_mariano(df: DataFrame, loss_a: Column, loss_b: Column, order: str, h: int) -> DataFrame:
    """One row (dm, p, n): mean loss difference over its long-run deviation with Bartlett weights over h - 1 lags (variance with divisor n, autocovariances with
    divisor n - 1 over the overlapping part). One series in order of a timestamp without ties; its lags are taken in time shards."""
    x = df.select(F.col(order).alias("o"), (loss_a - loss_b).alias("d"))
    x = with_frames(x, [], "o", ["o"], h, 0, lambda w: {f"l{k}": F.lag("d", k).over(w) for k in range(1, h)})
    s = x.agg(F.avg("d").alias("m"), F.var_pop("d").alias("g0"), F.count("d").alias("n"), *[F.covar_samp("d", f"l{k}").alias(f"g{k}") for k in range(1, h)])
    lrv = F.col("g0")
    for k in range(1, h):
        lrv = lrv + 2 * (1 - k / h) * F.coalesce(f"g{k}", F.lit(0.0))
    out = s.select(F.try_divide("m", F.sqrt(F.when(lrv > 0, lrv) / F.col("n"))).alias("dm"), "n")
    z = F.abs("dm") / F.sqrt(F.lit(2.0))
    # complementary error function by a rational approximation with an error below 1.2e-7
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = F.lit(c) + t * poly
    return out.select("dm", (t * F.exp(-z * z + poly)).alias("p"), "n")


def ecod(df: DataFrame, features: list[str]) -> DataFrame:
    """df with `score`: sum over features of minus the log of the smaller tail share (share of rows at most, and at least, as large)."""
    out = df
    for i, f in enumerate(features):
        n, below = F.col("_total"), F.col("_upto")
        tails = value_ranks(df, [], f).select("_v", F.greatest(-F.log(below / n), -F.log((n - below + F.col("_n")) / n)).alias(f"_e{i}"))
        out = out.join(small(tails), out[f].cast("double") == tails["_v"], "left").drop("_v")
    total = F.coalesce("_e0", F.lit(0.0))
    for i in range(1, len(features)):
        total = total + F.coalesce(f"_e{i}", F.lit(0.0))
    return out.withColumn("score", total).select(*df.columns, "score")


