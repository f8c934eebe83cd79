"""Transforms of paths (array<array<double>>, points in order), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column, scale: list[float]) -> Column:
    """Each channel divided by its scale, without centring; a scale below 1e-12 counts as one."""
    s = F.array(*[F.lit(1.0 if x < 1e-12 else float(x)) for x in scale])
    return F.transform(path, lambda p: F.zip_with(p, s, lambda a, b: a / b))


def add_basepoint(path: Column) -> Column:
    """With the origin put before the first point."""
    return F.concat(F.array(F.transform(F.get(path, F.lit(0)), lambda _: F.lit(0.0))), path)


def invisibility_reset(path: Column) -> Column:
    """A further channel that is one along the path, then drops to nought before the path returns to the origin."""
    seen = F.transform(path, lambda p: F.array_append(p, F.lit(1.0)))
    last = F.element_at(path, -1)
    return F.concat(seen, F.array(F.array_append(last, F.lit(0.0)), F.array_append(F.transform(last, lambda _: F.lit(0.0)), F.lit(0.0))))


def lead_lag(path: Column, convention: str = "lag_lead") -> Column:
    """2 n - 1 points. lag_lead: channels (lag, lead); leads_lags: all leads, then all lags. The lead moves first, the lag follows."""
    n = F.size(path)
    at = lambda i: F.get(path, i.cast("int"))
    lead = lambda k: at(F.ceil(k / 2))
    lag = lambda k: at(F.floor(k / 2))
    ks = F.sequence(F.lit(0), 2 * (n - 1))
    if convention == "lag_lead":
        return F.transform(ks, lambda k: F.concat(lag(k), lead(k)))
    if convention == "leads_lags":
        return F.transform(ks, lambda k: F.concat(lead(k), lag(k)))
    if convention == "interleaved":
        return F.transform(ks, lambda k: F.flatten(F.zip_with(lead(k), lag(k), lambda a, b: F.array(a, b))))
    raise ValueError(f"unknown convention {convention}")


def time_augment(path: Column) -> Column:
    """A first channel from nought to one in equal steps."""
    n = F.size(path)
    return F.transform(path, lambda p, i: F.concat(F.array(i / F.greatest(n - 1, F.lit(1)).cast("double")), p))


def resampled(path: Column, points: int) -> Column:
    """Linear interpolation to `points` equally spaced positions."""
    n = F.size(path)

    def at(k: Column) -> Column:
        x = k * (n - 1) / F.lit(max(points - 1, 1)).cast("double")
        i = F.least(F.floor(x), n - 2).cast("int")
        i = F.greatest(i, F.lit(0))
        return F.zip_with(F.get(path, i), F.get(path, F.least(i + 1, n - 1)), lambda a, b: a + (b - a) * (x - i))

    return F.when(n == 1, F.array_repeat(F.get(path, F.lit(0)), points)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def recency_weighted(path: Column, halflife: float) -> Column:
    """Increments weighted by 2^(-age / halflife), the newest with weight one, and summed up again; the first point stays."""
    n = F.size(path)
    idx = F.sequence(F.lit(1), n - 1)
    step = lambda i: F.transform(F.zip_with(F.get(path, i), F.get(path, i - 1), lambda a, b: a - b), lambda d: d * F.pow(F.lit(2.0), -(n - 1 - i) / F.lit(float(halflife))))
    first = F.array(F.get(path, F.lit(0)))
    grow = lambda acc, i: F.array_append(acc, F.zip_with(F.element_at(acc, -1), step(i), lambda a, b: a + b))
    return F.when(n < 2, path).otherwise(F.aggregate(idx, first, grow))


def z_scored(path: Column, channel: int = 0, eps: float = 1e-8) -> Column:
    """(linear time, z-score of one channel by the window's own mean and population deviation)."""
    xs = F.transform(path, lambda p: F.get(p, F.lit(channel)))
    n = F.size(path).cast("double")
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.transform(xs, lambda x, i: F.array(i / F.greatest(n - 1, F.lit(1.0)), (x - mean) / (F.sqrt(var) + eps)))
