"""Irregular readings onto a regular grid, with shape-preserving cubic interpolation of short gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.shards import count_halo
from tidewright.session import micros

OBSERVED, FILLED, GAP = "observed", "filled", "gap"


def cells(df: DataFrame, source: Column, at: str, value: str, amount: str, order: list[str], width_s: int) -> DataFrame:
    """(source, cell, value, amount, readings) of the cells that have a reading: the last value by (time, order) and the sum of amounts.

    A reading has non-null source, time, value and amount, the last two above zero (NaN is not). Partial sums are made before the shuffle, so
    a cell may hold any share of the rows. `cell` is the number of the cell since 1970."""
    v, a = F.col(value).cast("double"), F.col(amount).cast("double")
    rows = df.select(source.alias("source"), micros(at).alias("t"), v.alias("v"), a.alias("a"), F.struct(*order).alias("o"))
    rows = rows.where((F.col("v") > 0) & ~F.isnan("v") & (F.col("a") > 0) & ~F.isnan("a") & F.col("source").isNotNull() & F.col("t").isNotNull())
    cell = F.floor(F.col("t") / (width_s * 1_000_000)).cast("bigint").alias("cell")
    return rows.groupBy("source", cell).agg(F.max(F.struct("t", "o", "v"))["v"].alias("value"), F.sum("a").alias("amount"), F.count("*").alias("readings"))


def _slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Slope at an inner reading: weighted harmonic mean of the neighbouring secants, nought where they turn."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, 0.0).otherwise((w0 + w1) / (w0 / F.when(d0 != 0, d0) + w1 / F.when(d1 != 0, d1)))


def _end_slope(h: Column, d: Column, h1: Column, d1: Column) -> Column:
    """Slope at the end of a segment: three-point formula, limited so that the curve keeps the shape of the first secant d."""
    s = ((2 * h + h1) * d - h * d1) / (h + h1)
    return F.when(s * d <= 0, 0.0).when((d * d1 <= 0) & (F.abs(s) > 3 * F.abs(d)), 3 * d).otherwise(s)


def regular_grid(observed: DataFrame, width_s: int = 300, longest_gap: int = 12, shard_cells: int = 288) -> DataFrame:
    """Every cell from the first to the last observed one of each source: `source, cell, cell_start_s, status, value, amount, readings, previous_cell,
    next_cell` (the observed cells around it, itself if observed).

    status is `observed`; `filled` where at most `longest_gap` cells lie from one observed cell to the next: value is then the monotone cubic
    through the segment's readings and amount is nought; or `gap`: a longer gap stays marked with null value and amount. Segments end at gaps; an
    end takes its slope from its own side only. The curve never leaves the range of the two readings around it.

    `observed` comes from cells(): at most one row a cell. Sources are cut into shards of `shard_cells`; each shard gets the neighbouring readings
    that its slopes need (one before, two after), however far away they are."""
    here = observed.withColumn("_shard", F.floor(F.col("cell") / shard_cells).cast("bigint"))
    knots = count_halo(here, ["source"], "_shard", ["cell"], 1, 2)
    w = W.partitionBy("source", "_shard").orderBy("cell")
    x = F.col("cell")
    k = knots.select(
        "source", "cell", "value", "amount", "readings", "_own",
        F.lag(F.struct("cell", "value"), 1).over(w).alias("p"), F.lead(F.struct("cell", "value"), 1).over(w).alias("n"), F.lead(F.struct("cell", "value"), 2).over(w).alias("nn"),
    ).where("_own")
    near = lambda a, b: F.coalesce(b - a <= longest_gap, F.lit(False))
    h, h0, h1 = (F.col("n.cell") - x).cast("double"), (x - F.col("p.cell")).cast("double"), (F.col("nn.cell") - F.col("n.cell")).cast("double")
    d, d0, d1 = (F.col("n.value") - F.col("value")) / h, (F.col("value") - F.col("p.value")) / h0, (F.col("nn.value") - F.col("n.value")) / h1
    before, after = near(F.col("p.cell"), x), near(F.col("n.cell"), F.col("nn.cell"))
    m0 = F.when(before, _slope(h0, d0, h, d)).when(after, _end_slope(h, d, h1, d1)).otherwise(d)
    m1 = F.when(after, _slope(h, d, h1, d1)).when(before, _end_slope(h, d, h0, d0)).otherwise(d)
    k = k.select("source", "cell", "value", "amount", "readings", F.col("n.cell").alias("next"), F.col("n.value").alias("next_value"), m0.alias("m0"), m1.alias("m1"))
    steps = F.sequence(x, F.coalesce(F.col("next") - 1, x))
    out = k.withColumn("c", F.explode(steps))
    length, t = (F.col("next") - x).cast("double"), (F.col("c") - x) / (F.col("next") - x).cast("double")
    curve = (
        (1 + 2 * t) * (1 - t) * (1 - t) * F.col("value")
        + t * (1 - t) * (1 - t) * length * F.col("m0")
        + t * t * (3 - 2 * t) * F.col("next_value")
        + t * t * (t - 1) * length * F.col("m1")
    )
    status = F.when(F.col("c") == x, OBSERVED).when(F.col("next") - x <= longest_gap, FILLED).otherwise(GAP)
    out = out.withColumn("status", status)
    seen = F.col("status") == OBSERVED
    return out.select(
        "source", F.col("c").alias("cell"), (F.col("c") * width_s).alias("cell_start_s"), "status",
        F.when(seen, F.col("value")).when(F.col("status") == FILLED, curve).alias("value"),
        F.when(seen, F.col("amount")).when(F.col("status") == FILLED, F.lit(0.0)).alias("amount"),
        F.when(seen, F.col("readings")).otherwise(F.lit(0)).alias("readings"),
        x.alias("previous_cell"), F.when(seen, x).otherwise(F.col("next")).alias("next_cell"),
    )
