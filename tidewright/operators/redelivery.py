"""Messages delivered more than once: exactly one copy of each is kept.

Identifiers (entity, number) are dictionary-encoded exactly: the entity gets a code from a stored dictionary, the number is its own code (an
identifier that is no number gets one from the dictionary too). The upper bits of the code name a container of 32,768 bits, the lower bits
a bit in it. Containers are sorted arrays while sparse and bitsets when dense, and are stored compressed.

1. Every input partition, in arrival order, claims bits in containers of its own and rejects what finds its bit taken. A message that holds
   a third of all rows shrinks to one row a partition here, before anything is shuffled.
2. What is left is shuffled by container; each container claims again, in arrival order, after the bits known from earlier batches.
   Rejected rows travel by a hash of their arrival and spread evenly.
3. DeliveryLedger writes accepted rows and the united bits of the containers that a batch reaches, and moves to them by renaming one pointer file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.session import checkpointed, scratch, small

LOW_BITS = 15
WORDS = 1 << (LOW_BITS - 3)
STATE, CANDIDATE, SETTLED = 0, 1, 2


class Container:
    """The seen bits of one container."""

    __slots__ = ("bits", "few")

    def __init__(self, packed: bytes | None = None):
        self.few: np.ndarray | None = np.empty(0, np.int64)
        self.bits: np.ndarray | None = None
        if packed is not None:
            self.bits, self.few = np.frombuffer(zlib.decompress(packed), np.uint8).copy(), None

    def claim(self, low: np.ndarray) -> np.ndarray:
        """True where the bit was free; of several rows with the same bit, for the first of them."""
        unique, first = np.unique(low, return_index=True)
        if self.bits is not None:
            fresh = (self.bits[unique >> 3] >> (unique & 7).astype(np.uint8)) & 1 == 0
        elif len(self.few):
            fresh = ~np.isin(unique, self.few, assume_unique=True)
        else:
            fresh = np.ones(len(unique), bool)
        new = unique[fresh]
        if self.bits is None and len(self.few) + len(new) > WORDS // 8:
            self.bits, self.few = np.packbits(np.bincount(self.few, minlength=8 * WORDS).astype(bool), bitorder="little"), None
        if self.bits is None:
            self.few = np.union1d(self.few, new)
        else:
            np.bitwise_or.at(self.bits, new >> 3, (1 << (new & 7)).astype(np.uint8))
        out = np.zeros(len(low), bool)
        out[first[fresh]] = True
        return out

    def packed(self) -> bytes:
        bits = self.bits if self.bits is not None else np.packbits(np.bincount(self.few, minlength=8 * WORDS).astype(bool), bitorder="little")
        return zlib.compress(bits.tobytes(), 1)


def _claims(final: bool, keep_bits: bool):
    """Over rows sorted by (code, high, kind, arrival), so that one container is open at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        box = Container()

        def closing(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            if keep_bits and at is not None:
                held = {"_kind": [STATE], "_code": [at[0]], "_high": [at[1]], "_bits": [box.packed()], "_repeat": [False]}
                yield pa.RecordBatch.from_arrays([pa.array(held.get(f.name, [None]), f.type) for f in schema], schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            n = batch.num_rows
            if not n:
                continue
            kind = batch.column("_kind").to_numpy(zero_copy_only=False)
            code = batch.column("_code").fill_null(-1).to_numpy(zero_copy_only=False)
            high = batch.column("_high").fill_null(-1).to_numpy(zero_copy_only=False)
            low = batch.column("_low").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            won = np.zeros(n, bool)
            cuts = np.flatnonzero((code[1:] != code[:-1]) | (high[1:] != high[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, n]):
                if kind[a] == SETTLED:
                    continue
                here = (int(code[a]), int(high[a]))
                if here != at:
                    yield from closing(schema)
                    at, box = here, Container()
                if kind[a] == STATE:
                    for packed in batch.column("_bits").slice(a, b - a).to_pylist():
                        box = Container(packed)
                else:
                    won[a:b] = box.claim(low[a:b])
            lost = (kind == CANDIDATE) & ~won
            columns = {f.name: batch.column(i) for i, f in enumerate(schema)}
            columns["_repeat"] = pa.array(lost | batch.column("_repeat").to_numpy(zero_copy_only=False))
            columns["_kind"] = pa.array(np.where(lost | ((kind == CANDIDATE) & final), SETTLED, kind).astype(np.int8))
            out = pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)
            yield out.filter(pa.array(kind != STATE)) if keep_bits or final else out
        if schema is not None:
            yield from closing(schema)

    return run


def dictionary(df: DataFrame, entity: Column) -> DataFrame:
    """(_entity, _code) of each distinct non-null entity; exact, and stored, as codes come from row positions."""
    return checkpointed(df.select(entity.alias("_entity")).where(F.col("_entity").isNotNull()).distinct().withColumn("_code", F.monotonically_increasing_id()))


def _coded(df: DataFrame, entity: Column, number: Column, order: list[Column], codes: DataFrame) -> DataFrame:
    number = number.cast("bigint")
    rows = df.select(
        entity.alias("_entity"),
        F.shiftright(number, LOW_BITS).alias("_high"),
        number.bitwiseAND((1 << LOW_BITS) - 1).cast("int").alias("_low"),
        F.struct(*[c.alias(f"o{i}") for i, x in enumerate(order) for c in (x,)]).alias("_order"),
        F.struct(*df.columns).alias("_row"),
    )
    coded = rows.join(small(codes), "_entity", "left")
    known = F.col("_code").isNotNull() & F.col("_high").isNotNull()
    return coded.select(
        F.when(known, F.lit(CANDIDATE)).otherwise(F.lit(SETTLED)).cast("tinyint").alias("_kind"),
        "_code", "_high", "_low", "_order", F.lit(None).cast("binary").alias("_bits"), F.lit(False).alias("_repeat"), "_row",
    )


def _pass(coded: DataFrame, state: DataFrame | None, keep_bits: bool, repeats: bool = True) -> DataFrame:
    """Both claims. Without `repeats`, what the first claim rejects is dropped before the shuffle."""
    by = ["_code", "_high", "_kind", "_order"]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in coded.schema])
    local = coded.sortWithinPartitions(*by).mapInArrow(_claims(False, False), schema)
    if not repeats:
        local = local.where(~F.col("_repeat"))
    if state is not None:
        local = local.unionByName(state, allowMissingColumns=True)
    route = F.when(F.col("_kind") == SETTLED, F.xxhash64("_order")).otherwise(F.xxhash64("_code", "_high"))
    routed = local.withColumn("_route", route).repartition("_route").drop("_route")
    return routed.sortWithinPartitions(*by).mapInArrow(_claims(True, keep_bits), schema)


def mark_repeats(df: DataFrame, entity: Column, number: Column, order: list[Column]) -> DataFrame:
    """`_row` (struct of df's columns) and `_repeat` for every row of df.

    Of the rows with the same entity and number all but the first by `order` are repeats; order is a list of ascending keys (nulls first, so
    put isNull() before a key whose nulls come last) and should end with a unique one: between rows equal in all of it any one is kept, but
    only one. Rows with null entity or number are no repeats. Original columns are nested, so their names cannot clash."""
    codes = dictionary(df, entity)
    return _pass(_coded(df, entity, number, order, codes), None, False).select("_row", "_repeat")


def keep_one(df: DataFrame, entity: Column, number: Column, order: list[Column]) -> DataFrame:
    """df without repeats (see mark_repeats); an empty df gives an empty df."""
    once = _pass(_coded(df, entity, number, order, dictionary(df, entity)), None, False, repeats=False)
    return once.where(~F.col("_repeat")).select("_row.*")


class DeliveryLedger:
    """Seen-bitmaps that outlive a batch, below `path` (a folder that all executors reach).

    ingest(batch) returns the rows of the batch that no earlier batch had, one per identifier. Containers live in `shards` shard files. A batch reads and writes again only
    the shards that its containers fall into, and unpacks only the containers it reaches; its accepted rows, new dictionary entries and shard files go to a folder of
    its own, named by no other writer. A version is a manifest that says in which folder each shard is; the pointer file with it is renamed into place after all is
    written. A batch that dies leaves the old version in force and can be ingested again with the same result; of two writers only one moves the pointer, the other
    fails and leaves nothing in force. With a batch number, a batch that is already in force is not ingested again: its accepted rows are returned."""

    def __init__(self, spark: SparkSession, path: str, entity: Column, number: Column, order: list[Column], shards: int = 256):
        self.spark, self.path, self.entity, self.number, self.order, self.shards = spark, path.rstrip("/"), entity, number, order, shards
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The version in force: the highest one with a pointer file; 0 before the first batch."""
        at = self._path(f"{self.path}/pointers")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max([0, *(int(x) for x in names if x.isdigit())])

    def manifest(self, version: int) -> dict:
        """batch, folder, codes (folders with dictionary entries), top (greatest code), bits (folder of each shard)."""
        if not version:
            return {"batch": None, "folder": None, "codes": [], "top": -1, "bits": {}}
        return json.loads(self.spark.read.text(f"{self.path}/pointers/{version}", wholetext=True).first()[0])

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _committed(self, batch_id: int) -> int | None:
        version = self.version()
        while version:
            batch = self.manifest(version)["batch"]
            if batch is not None and batch <= batch_id:
                return version if batch == batch_id else None
            version -= 1
        return None

    def ingest(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        done = self._committed(batch_id) if batch_id is not None else None
        if done:
            return self.accepted(done)
        old = self.version()
        now = self.manifest(old)
        own = f"{self.path}/runs/{uuid.uuid4().hex}"
        names = batch.select(self.entity.alias("_entity")).where("_entity is not null").distinct()
        kind = dict(names.dtypes)["_entity"]
        codes = self._read(now["codes"], f"_entity {kind}, _code bigint")
        names.join(codes, "_entity", "left_anti").withColumn("_code", F.monotonically_increasing_id() + F.lit(now["top"] + 1)).write.parquet(f"{own}/codes")
        folders = [*now["codes"], f"{own}/codes"]
        codes = self._read(folders, f"_entity {kind}, _code bigint")
        shard = F.pmod(F.xxhash64("_code", "_high"), F.lit(self.shards)).cast("int")
        coded = _coded(batch, self.entity, self.number, self.order, codes)
        reached = small(coded.where(F.col("_kind") == CANDIDATE).select("_code", "_high").distinct().withColumn("_shard", shard))
        touched = [r[0] for r in reached.select("_shard").distinct().collect()]  # at most `shards` numbers
        state = self._read([now["bits"][str(k)] for k in touched if str(k) in now["bits"]], "_code bigint, _high bigint, _bits binary")
        keys = ["_code", "_high"]
        open_ = state.join(reached.select(*keys), keys, "left_semi").withColumn("_kind", F.lit(STATE).cast("tinyint")).withColumn("_repeat", F.lit(False))
        passed = _pass(coded, open_, True, repeats=False).where(~F.col("_repeat"))
        bits, row = F.col("_kind") == STATE, passed.schema["_row"].dataType
        passed = passed.select(bits.alias("bits"), F.when(bits, shard).otherwise(0).alias("shard"), *keys, "_bits", "_row")
        closed = state.join(reached.select(*keys), keys, "left_anti").select(F.lit(True).alias("bits"), shard.alias("shard"), *keys, "_bits", F.lit(None).cast(row).alias("_row"))
        passed.unionByName(closed).write.partitionBy("bits", "shard").parquet(f"{own}/pass")
        top = self._read([f"{own}/codes"], f"_entity {kind}, _code bigint").agg(F.coalesce(F.max("_code"), F.lit(now["top"]))).first()[0]
        there = {str(k): f"{own}/pass/bits=true/shard={k}" for k in touched}
        after = {"batch": batch_id, "folder": own, "codes": folders, "top": top, "bits": now["bits"] | there}
        self._commit(old + 1, own, after)
        return self.accepted(old + 1)

    def _commit(self, version: int, own: str, manifest: dict) -> None:
        temporary, pointer = self._path(f"{own}/manifest"), self._path(f"{self.path}/pointers/{version}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(pointer.getParent())
        if self._fs.exists(pointer) or not self._fs.rename(temporary, pointer):
            raise RuntimeError(f"version {version} was committed by another writer")

    def accepted(self, version: int) -> DataFrame:
        """The rows that a version's batch added."""
        rows = self.spark.read.parquet(f"{self.manifest(version)['folder']}/pass")
        return rows.where(~F.col("bits")).select("_row.*")

    def remove_old(self, keep: int = 2) -> None:
        """Deletes the folders that none of the `keep` newest versions names, those of dead batches too; no batch may be running."""
        newest = [self.manifest(v) for v in range(self.version(), max(0, self.version() - keep), -1)]
        named = {f.split("/runs/")[1].split("/")[0] for m in newest for f in [m["folder"], *m["codes"], *m["bits"].values()]}
        at = self._path(f"{self.path}/runs")
        for status in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if status.getPath().getName() not in named:
                self._fs.delete(status.getPath(), True)


def coded_identifier(df: DataFrame, identifier: Column, name: str = "_number") -> DataFrame:
    """df with a bigint column of exact codes for an identifier of any type, for use as `number`; null where the identifier is null. Codes
    are dense within each partition of the dictionary, so containers stay dense."""
    codes = dictionary(df, identifier).select(F.col("_entity").alias("_identifier"), F.col("_code").alias(name))
    return df.withColumn("_identifier", identifier).join(small(codes), "_identifier", "left").drop("_identifier")


def ledger_path(spark: SparkSession) -> str:
    return scratch(spark, "ledger")


