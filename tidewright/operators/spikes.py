"""Implausible spikes, stuck values and impossible bars, measured by each instrument's own behaviour.

A bar's excursion is how far one of its prices lies, on one side, from closes both before and after it. Its residual is the excursion over the usual move of
that hour of the day (the average, moves cut at four usual ones). A generalised Pareto tail, fitted to each instrument's residuals, sets a cutoff at a fixed risk; only bars beyond it are candidates, and
only those are judged by the exact rule, which needs to know which neighbours are sound.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.shards import time_halo
from tidewright.session import checkpointed, micros, real, small, stored

SHARD_US = 30 * 86_400_000_000
SHARD_BARS = 4096
REACH = 12  # neighbouring bars that the windows need on each side
SETTLE_REACH = 64  # and the settling of candidates; longer chains of them take another round
DAY_US = 86_400_000_000


def exact_median(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) of positive values, exact, without gathering the values of a key: counts by narrow logarithmic classes first, then only
    the values of the class or two that hold the middle, counted by value."""
    classed = values.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.floor(F.log(value) * 4096).alias("_c")).where("_v > 0")
    w = W.partitionBy("_k").orderBy("_c")
    total = F.sum("n").over(W.partitionBy("_k"))
    hist = classed.groupBy("_k", "_c").agg(F.count("*").alias("n"))
    hist = hist.select("_k", "_c", "n", (F.sum("n").over(w) - F.col("n")).alias("below"), total.alias("total"))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = hist.where(((F.col("below") < low) & (low <= F.col("below") + F.col("n"))) | ((F.col("below") < high) & (high <= F.col("below") + F.col("n"))))
    near = classed.join(small(middle.drop("n")), ["_k", "_c"]).groupBy("_k", "_c", "_v", "below", "total").agg(F.count("*").alias("n"))
    near = near.withColumn("upto", F.col("below") + F.sum("n").over(W.partitionBy("_k", "_c").orderBy("_v")))
    hit = lambda r: F.max(F.when((F.col("upto") - F.col("n") < r) & (r <= F.col("upto")), F.col("_v")))
    return near.groupBy("_k").agg(((hit(low) + hit(high)) / 2).alias("median")).withColumnRenamed("_k", key)


def tail_cutoffs(residuals: DataFrame, risk: float, tail: float) -> DataFrame:
    """(_s, cutoff): peaks over threshold. The excesses of the residuals z > 0 over the quantile of tail probability 4 `tail` get a generalised Pareto tail whose shape
    (held to half on either side) and scale come from the spacings of the quantiles at 4, 2 and 1 `tail`, so that wild values, which are rarer than `tail`, do not set the
    cutoff that is to find them. The cutoff is the residual that a sound bar passes with probability `risk`, and not below the last of those quantiles. Everything
    is counts by symbol and logarithmic classes of a 64th; within a class values are taken as spread evenly. Null where there are too few residuals for a quantile."""
    hist = residuals.where("z > 0").groupBy("_s", F.floor(F.log("z") * 64).alias("c")).agg(F.count("*").alias("n"))
    hist = hist.select("_s", "c", "n", F.sum("n").over(W.partitionBy("_s").orderBy(F.desc("c"))).alias("above"), F.sum("n").over(W.partitionBy("_s")).alias("total"))

    def level(k: int) -> Column:
        """The residual of tail probability k `tail`."""
        want = F.col("total") * (k * tail)
        inside = (F.col("above") >= want) & (F.col("above") - F.col("n") < want)
        return F.max(F.when(inside, F.exp((F.col("c") + (F.col("above") - want) / F.col("n")) / 64)))

    q = hist.groupBy("_s").agg(level(1).alias("q1"), level(2).alias("q2"), level(4).alias("q4"))
    ratio = F.try_divide(F.col("q1") - F.col("q2"), F.col("q2") - F.col("q4"))
    shape = F.greatest(F.least(F.log(F.when(ratio > 0, ratio)) / math.log(2), F.lit(0.5)), F.lit(-0.5))
    shape = F.when(F.abs(shape) < 1e-6, F.lit(1e-6)).otherwise(F.coalesce(shape, F.lit(1e-6)))
    sigma = (F.col("q2") - F.col("q4")) * shape / (F.pow(F.lit(2.0), shape) - 1)
    cutoff = F.col("q4") + sigma / shape * (F.pow(F.lit(4 * tail / risk), shape) - 1)
    return q.select("_s", F.greatest(cutoff, F.col("q1")).alias("cutoff"))


def _positions(placed: DataFrame, values: list[str]) -> DataFrame:
    """placed, rows repeated whole once, with `pos`: 0, 1, 2, ... within _s in the order of (_t, _id)."""
    order = ["_t", "_id", *values]
    w = W.partitionBy("_s", "_shard").orderBy(*order)
    same = functools.reduce(lambda p, c: p & F.col(c).eqNullSafe(F.lag(c).over(w)), order, F.row_number().over(w) > 1)
    rows = placed.withColumn("_same", same).where(~F.col("_same")).drop("_same").withColumn("_n", F.row_number().over(w).cast("bigint"))
    counts = rows.groupBy("_s", "_shard").agg(F.count("*").alias("_c"))
    earlier = F.coalesce(F.sum("_c").over(W.partitionBy("_s").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("_s", "_shard", earlier.alias("_earlier")), ["_s", "_shard"]).withColumn("pos", F.col("_n") - 1 + F.col("_earlier")).drop("_n", "_earlier", "_shard")


def excursion(w, top: str, bottom: str, ref: str, apart: int) -> Column:
    """The largest d such that top (or bottom) lies d above (below) the reference of a row before and of a row after, at most `apart` rows from each other; null without
    such a pair. Nulls are no reference."""
    before = [F.lag(ref, i).over(w) for i in range(1, apart)]
    after = [F.lead(ref, i).over(w) for i in range(1, apart)]
    pairs = []
    for i, b in enumerate(before):
        lows, highs = (after[0], after[0]) if apart - 1 - i == 1 else (F.least(*after[: apart - 1 - i]), F.greatest(*after[: apart - 1 - i]))
        both = b.isNotNull() & lows.isNotNull()
        pairs.append((F.when(both, F.greatest(b, lows)), F.when(both, F.least(b, highs))))
    return F.greatest(F.col(top) - F.least(*[p[0] for p in pairs]), F.greatest(*[p[1] for p in pairs]) - F.col(bottom))


def settle_dense(hi: np.ndarray, lo: np.ndarray, ref: np.ndarray, level: np.ndarray, open_: np.ndarray, sure: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(cases, still open) of consecutive bars. Of the open bars whose excursion from sound closes passes their level, the one with the largest excursion (of equals the
    first) is a case and its close no longer sound; then excursions are measured again, until none passes. As excursions only shrink and reach apart - 1 bars, every bar
    that is the largest within its reach can be settled at once. Bars that are not `sure` (near a border) stay open and hold back what depends on them."""
    ref, open_ = np.where(np.isnan(ref), np.nan, ref).copy(), open_.copy()
    cases, reach, n = np.zeros(len(hi), bool), apart - 1, len(hi)

    def shifted(a: np.ndarray, k: int, fill: float) -> np.ndarray:
        """The value k places later (earlier for negative k)."""
        out = np.full(n, fill)
        if k > 0:
            out[: n - k] = a[k:]
        else:
            out[-k:] = a[: n + k]
        return out

    while open_.any():
        gain = np.full(n, -np.inf)
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        of = []
        for j in range(1, apart):
            a = shifted(ref, j, np.nan)
            low, high = np.fmin(low, a), np.fmax(high, a)
            of.append((low, high))
        for i in range(1, apart):
            b = shifted(ref, -i, np.nan)
            low, high = of[apart - i - 1]
            there = ~np.isnan(b) & np.isfinite(low)
            gain = np.where(there, np.fmax(gain, np.fmax(hi - np.maximum(b, low), np.minimum(b, high) - lo)), gain)
        open_ &= ~sure | (gain > level)
        rank = np.where(open_, np.where(sure, gain, np.inf), -np.inf)
        best = open_ & sure
        for k in range(1, reach + 1):
            if k < n:
                best &= (rank > shifted(rank, -k, -np.inf)) & (rank >= shifted(rank, k, -np.inf))
        if not best.any():
            break
        cases |= best
        open_ &= ~best
        ref[best] = np.nan
    return cases, open_


def settled(near: DataFrame, apart: int) -> DataFrame:
    """(_s, pos) of the cases among `near` (_s, pos, lc, hi, lo, sound, level, open): bars around candidates. Bars are sharded by position; each round settles what does not
    depend on bars beyond its halo, and the rounds end when nothing is open, so the outcome is that of one pass over the whole series, most extreme bar first."""
    fields = f"_s {dict(near.dtypes)['_s']}, pos bigint, lc double, hi double, lo double, sound boolean, level double, open boolean, found boolean"
    margin = apart - 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["_shard"].iloc[0])
        start, end = shard * SHARD_BARS - SETTLE_REACH, (shard + 1) * SHARD_BARS + SETTLE_REACH
        at = pdf["pos"].to_numpy() - start
        dense = {c: np.full(end - start, np.nan) for c in ("lc", "hi", "lo", "level")}
        for c, a in dense.items():
            a[at] = pdf[c].to_numpy(float)
        dense["lc"][at[~pdf["sound"].to_numpy(bool)]] = np.nan
        open_, sure = np.zeros(end - start, bool), np.zeros(end - start, bool)
        open_[at] = pdf["open"].to_numpy(bool)
        sure[margin : end - start - margin] = True
        cases, still = settle_dense(dense["hi"], dense["lo"], dense["lc"], dense["level"], open_, sure, apart)
        own = pdf["_own"].to_numpy(bool)
        out = pdf.assign(found=pdf["found"].to_numpy(bool) | cases[at], open=still[at], sound=pdf["sound"].to_numpy(bool) & ~cases[at])
        return out.loc[own, ["_s", "pos", "lc", "hi", "lo", "sound", "level", "open", "found"]]

    state = near.withColumn("found", F.lit(False))
    while True:
        wide = time_halo(state, "pos", SHARD_BARS, SETTLE_REACH, SETTLE_REACH)
        state = checkpointed(wide.groupBy("_s", "_shard").applyInPandas(run, fields))
        if state.where("open").isEmpty():
            return state.where("found").select("_s", "pos")


def flag_bars(
    df: DataFrame, symbol: str, at: str, bar_id: str, prices: tuple[str, str, str, str] = ("open_px", "high_px", "low_px", "close_px"),
    moves_away: float = 20.0, apart: int = 5, stuck: int = 6, liveliness: float = 0.1, risk: float = 3e-3, tail: float = 0.04,
) -> DataFrame:
    """One row for each bar: bar_id, symbol, at, `impossible`, `spike`, `stuck`, `tail` (its residual passes the fitted cutoff), `residual`, `cutoff`.

    impossible: a price not above zero, or high or low contradict another price. spike: its residual passes the instrument's fitted cutoff (peaks over threshold, see
    tail_cutoffs), and a price lies on the same side more than `moves_away` usual moves (median non-zero absolute log change of consecutive closes) from the closes
    of a sound bar before and a sound one after, at most `apart` bars from each other; so a move that lasts is none. Sound are bars that are neither impossible nor a spike: the
    most extreme candidate is settled first and its close no longer counts, then its neighbours are measured again, until nothing changes. A bar that the rule
    alone would name, in an hour so wild that its residual is usual there, is none; an instrument without a fit (too few bars) has every bar for a candidate.
    stuck: the close repeats the previous one within an unbroken series of at least `stuck` repeats, at an instrument whose closes repeat in less than
    `liveliness` of its bars.

    Nulls and NaN are no case by themselves and break a series; bars with null symbol or time can only be impossible. Rows repeated whole count once; missing bars are
    skipped. Order is (at, bar_id). Instruments are cut into shards of time for numbering their bars and then into shards of 4,096 bars with halos."""
    if apart > REACH // 2 or stuck > REACH // 2:
        raise ValueError(f"apart and stuck may be {REACH // 2} at most")
    o, h, low, c = (real(F.col(x).cast("double")) for x in prices)
    rows = df.select(F.col(symbol).alias("_s"), micros(at).alias("_t"), F.col(bar_id).alias("_id"), F.col(at).alias("_at"), o.alias("o"), h.alias("h"), low.alias("l"), c.alias("c"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    top, bottom = F.greatest("o", "h", "l", "c"), F.least("o", "h", "l", "c")
    wrong = yes(bottom <= 0) | yes(F.col("h") < top) | yes(F.col("l") > bottom)
    placed = rows.where("_s is not null and _t is not null").withColumn("_shard", F.floor(F.col("_t") / SHARD_US).cast("bigint"))
    lc = F.when(F.col("c") > 0, F.log("c"))
    bars = _positions(placed, ["o", "h", "l", "c"]).select(
        "_s", "_t", "_id", "_at", "pos", "c", wrong.alias("impossible"), lc.alias("lc"), F.when(bottom > 0, F.log(top)).alias("hi"), F.when(bottom > 0, F.log(bottom)).alias("lo"), F.when(~wrong, lc).alias("ref")
    )
    bars = time_halo(bars, "pos", SHARD_BARS, REACH, REACH)
    w = W.partitionBy("_s", "_shard").orderBy("pos")
    bars = bars.withColumns({"move": F.abs(F.col("lc") - F.lag("lc").over(w)), "repeat": yes(F.col("c") == F.lag("c").over(w)), "far": excursion(w, "hi", "lo", "ref", apart)})
    bars = bars.withColumn("run", F.sum(F.col("repeat").cast("int")).over(w.rowsBetween(-(stuck - 1), 0)) == stuck)
    bars = bars.withColumn("run", F.max("run").over(w.rowsBetween(0, stuck - 1)))
    slot = F.floor(F.pmod("_t", F.lit(DAY_US)) / 3_600_000_000).cast("int")
    own = stored(bars.where("_own").select("_s", "_id", "_at", "pos", slot.alias("slot"), "impossible", "lc", "hi", "lo", "move", "far", "repeat", "run"), "bars")

    usual = exact_median(own.where("move > 0"), "_s", "move")
    share = own.groupBy("_s").agg(F.avg(F.col("repeat").cast("int")).alias("repeats"))
    norm = share.join(usual, "_s", "left").withColumnRenamed("median", "usual")
    scale = own.join(small(norm), "_s").groupBy("_s", "slot").agg(F.avg(F.when(F.col("move").isNotNull(), F.least("move", 4 * F.col("usual")))).alias("scale"), F.first("usual").alias("usual"), F.first("repeats").alias("repeats"))
    scale = small(scale)
    cut = tail_cutoffs(own.join(scale, ["_s", "slot"]).where("scale > 0").select("_s", (F.col("far") / F.col("scale")).alias("z")), risk, tail)
    norms = small(scale.join(small(cut), "_s", "left"))
    x = own.join(norms, ["_s", "slot"]).withColumn("level", F.greatest(moves_away * F.col("usual"), F.coalesce(F.col("cutoff"), F.lit(0.0)) * F.col("scale")))
    candidates = x.where(F.col("far") > F.col("level")).select("_s", "pos", F.lit(True).alias("open"))
    candidates = small(candidates)
    around = candidates.select("_s", F.explode(F.sequence(F.col("pos") - (apart - 1), F.col("pos") + (apart - 1))).alias("pos")).distinct()
    near = x.join(small(around), ["_s", "pos"], "left_semi").join(candidates, ["_s", "pos"], "left")
    spikes = settled(near.select("_s", "pos", "lc", "hi", "lo", (~F.col("impossible")).alias("sound"), "level", yes(F.col("open")).alias("open")), apart)
    residual = F.col("far") / F.when(F.col("scale") > 0, F.col("scale"))
    done = x.join(small(spikes.withColumn("spike", F.lit(True))), ["_s", "pos"], "left")
    done = done.select("_id", "_s", "_at", "impossible", yes(F.col("spike")).alias("spike"), (F.col("run") & (F.col("repeats") < liveliness)).alias("stuck"), yes(residual > F.col("cutoff")).alias("tail"), residual.alias("residual"), "cutoff")
    no = F.lit(False)
    loose = rows.where("_s is null or _t is null").distinct().select("_id", "_s", "_at", wrong.alias("impossible"), no.alias("spike"), no.alias("stuck"), no.alias("tail"), F.lit(None).cast("double").alias("residual"), F.lit(None).cast("double").alias("cutoff"))
    return done.unionByName(loose).withColumnsRenamed({"_id": bar_id, "_s": symbol, "_at": at})
