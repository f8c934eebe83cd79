"""Session, table access, materialisation and size-checked broadcasts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest table, in bytes of its values, that an operator may broadcast; it is measured first, and beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; a local one only where that is unset and the master is local."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"tidewright-{sc.applicationId}")
    os.makedirs(path, exist_ok=True)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder, with the lineage cut; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidewright/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written as Parquet to the shared folder and read from there: lineage is cut, and each reader takes only its columns. Gone when the application ends."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(there)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Plans that are already held: reading them again computes nothing.
HELD = ("LogicalRDD", "LocalRelation")


def _size(field: T.StructField) -> Column:
    """Bytes of a value, and a few for its slot."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
    return F.lit(16 if isinstance(field.dataType, T.DecimalType) else 8)


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """(df computed once and held in the shared folder, whether its values have at most `limit` bytes)."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() not in HELD:
        df = checkpointed(df)
    each = F.lit(16)
    for field in df.schema.fields:
        each = each + _size(field)
    return df, (df.agg(F.sum(each.cast("bigint"))).first()[0] or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, computed once and held, with a broadcast hint if it has been measured to have at most `limit` bytes; with more it is joined by a shuffle."""
    df, fits = measured(df, limit)
    return F.broadcast(df) if fits else df


def hash_sample(df: DataFrame, keys: list[str], rows: int, total: int | None = None) -> DataFrame:
    """At most `rows` rows, those with the smallest hash of the keys; the same in every run. Rows are thinned by the hash to little more than that number first, so
    that the tasks of the top-k send little."""
    n = df.count() if total is None else total
    spread = F.pmod(F.xxhash64(F.lit(11), *keys), F.lit(1 << 40))
    share = min(1.0, (1.1 * rows + 50) / max(n, 1))
    return df.where(spread < int(share * (1 << 40))).orderBy(spread, *keys).limit(rows)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys match each other; the keys and then the other columns of both sides, none of which may clash."""
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_on_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_on_{k}" for k in keys])


def micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone; zone-less time means UTC (the session zone must be UTC)."""
    return F.unix_micros(F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp"))


def real(col: Column | str) -> Column:
    """The value, or null where it is null or NaN."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)
