"""Time shards with halos: how ordered operators stay distributed when one entity holds a large part of all rows.

A window over an entity alone puts all its rows into one task. Here each entity is cut into shards of time, and every shard is given the
neighbouring rows it needs: those within a fixed time (time_halo), or a fixed number of rows however far away they are (count_halo).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.session import join_on


def time_halo(df: DataFrame, at: str, width: int, before: int, after: int) -> DataFrame:
    """Adds `_shard` (at div width) and `_own`; a row is repeated, with _own false, in each other shard whose range, widened by `before`
    units on its early side and `after` on its late side, contains it. Rows with null `at` are dropped. Only narrow work, no shuffle."""
    t = F.col(at)
    first, last = F.floor((t - after) / width), F.floor((t + before) / width)
    spread = df.where(t.isNotNull()).withColumn("_shard", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    return spread.withColumn("_own", F.col("_shard") == F.floor(t / width).cast("bigint"))


def count_halo(df: DataFrame, keys: list[str], shard: str, order: list[str], before: int, after: int) -> DataFrame:
    """Each (keys, shard) with the `before` rows that precede it and the `after` rows that follow it in the order of (shard, order), however
    many empty or thin shards lie between; `_own` is false for those. `order` must be a total order within keys and agree with `shard`.

    Running row counts of the shards (one small row a shard) tell which later and earlier shards still reach a row near its shard's ends; only those
    rows are copied, and only to them."""
    if not before and not after:
        return df.withColumn("_own", F.lit(True))
    inside = W.partitionBy(*keys, shard)
    marked = df.withColumn("_first", F.row_number().over(inside.orderBy(*order))).withColumn("_last", F.row_number().over(inside.orderBy(*[F.desc(c) for c in order])))
    along = W.partitionBy(*keys).orderBy(shard)
    counts = marked.where("_last = 1").select(*keys, shard, F.col("_first").cast("bigint").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    place = F.struct(F.col(shard).alias("s"), (F.col("_upto") - F.col("_n")).alias("below"), F.col("_upto").alias("upto"))
    none = F.array().cast(f"array<struct<s:{dict(df.dtypes)[shard]},below:bigint,upto:bigint>>")
    counts = counts.select(
        *keys, shard, "_n", "_upto",
        (F.collect_list(place).over(along.rowsBetween(1, before)) if before else none).alias("_later"),
        (F.collect_list(place).over(along.rowsBetween(-after, -1)) if after else none).alias("_earlier"),
    )
    edges = marked.where((F.col("_first") <= after) | (F.col("_last") <= before))
    edges = join_on(edges, counts, [*keys, shard])
    later = F.filter("_later", lambda t: F.col("_last") + t["below"] - F.col("_upto") <= before)
    earlier = F.filter("_earlier", lambda t: F.col("_first") + F.col("_upto") - F.col("_n") - t["upto"] <= after)
    targets = F.transform(F.concat(later, earlier), lambda t: t["s"])
    halo = edges.withColumn("_target", F.explode(targets)).select(*[F.col("_target").alias(shard) if c == shard else F.col(c) for c in df.columns], F.lit(False).alias("_own"))
    return df.withColumn("_own", F.lit(True)).unionByName(halo)

