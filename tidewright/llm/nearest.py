"""Matching records of two tables by nearest time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators.shards import time_halo
from tidewright.session import micros

#: Width of a time shard, in tolerances.
SHARD_TOLERANCES = 24


def nearest_in_time(
    left: DataFrame, right: DataFrame, entity: str, left_at: str, right_at: str, left_id: str, right_id: str, carry: list[str], tolerance_s: float
) -> DataFrame:
    """Each left record, once, with the nearest right record of the same entity at most `tolerance_s` seconds before or after (inclusive):
    columns left_id, entity, left_at, right_id, `right_at`, the `carry` columns of right, and `gap_us` (right minus left).

    At equal distance the earlier right record counts, at one instant the one with the smallest right_id. Left rows with null entity, time or
    id, and right rows with null entity or time, take no part; a left record without a partner comes out with nulls. Rows repeated whole
    count once. Columns of the same name in both tables cannot clash, as only the named ones are taken.

    Both tables are united and sorted once per (entity, time shard) in each direction; the last right record so far and the next one are
    carried onto each left row. Shards are a fixed number of tolerances wide and right records near a border are repeated on its other side,
    so neither an entity nor a busy hour puts all its rows into one task, and no pairs are formed."""
    tolerance = int(tolerance_s * 1_000_000)
    width = max(tolerance, 1) * SHARD_TOLERANCES
    r = right.select(F.col(entity).alias("_e"), micros(right_at).alias("_t"), F.col(right_id).alias("_id"), F.struct(F.col(right_at).alias("_at"), *carry).alias("_c"))
    r = r.where("_e is not null and _t is not null and _id is not null").groupBy("_e", "_t").agg(F.min(F.struct("_id", "_c")).alias("_r"))
    r = time_halo(r, "_t", width, tolerance, tolerance).select("_e", "_shard", "_t", F.struct(F.col("_t").alias("t"), F.col("_r._id").alias("id"), F.col("_r._c").alias("c")).alias("_r"))
    q = left.select(F.col(entity).alias("_e"), micros(left_at).alias("_t"), F.col(left_id).alias("_q"), F.col(left_at).alias("_qat"))
    q = q.where("_e is not null and _t is not null and _q is not null").groupBy("_e", "_t", "_q").agg(F.first("_qat").alias("_qat"))
    q = q.withColumn("_shard", F.floor(F.col("_t") / width).cast("bigint"))
    both = q.unionByName(r, allowMissingColumns=True).repartition("_e", "_shard")
    inside = W.partitionBy("_e", "_shard")
    so_far = W.unboundedPreceding, W.currentRow
    # right records sort before left ones of the same instant, so `last` may have distance nought
    last = F.last("_r", ignorenulls=True).over(inside.orderBy("_t", F.col("_q").isNotNull()).rowsBetween(*so_far))
    following = F.last("_r", ignorenulls=True).over(inside.orderBy(F.desc("_t"), F.col("_q").isNotNull()).rowsBetween(*so_far))
    near = both.withColumn("_last", last).withColumn("_next", following).where("_q is not null")
    back, ahead = F.col("_t") - F.col("_last.t"), F.col("_next.t") - F.col("_t")
    take_next = F.col("_last").isNull() | (back > ahead)
    best = F.when(F.coalesce(take_next, F.lit(False)), F.col("_next")).otherwise(F.col("_last"))
    best = F.when(F.abs(best["t"] - F.col("_t")) <= tolerance, best)
    out = near.select("_q", "_e", "_qat", "_t", best.alias("_b"))
    return out.select(
        F.col("_q").alias(left_id), F.col("_e").alias(entity), F.col("_qat").alias(left_at), F.col("_b.id").alias(right_id),
        F.col("_b.c._at").alias(right_at), *[F.col(f"_b.c.{c}").alias(c) for c in carry], (F.col("_b.t") - F.col("_t")).alias("gap_us"),
    )
