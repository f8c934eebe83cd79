import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions.symbols import instrument
from tidewright.operators.redelivery import Container, DeliveryLedger, coded_identifier, keep_one, mark_repeats

SCHEMA = "delivery_id bigint, received_at timestamp_ntz, symbol string, trade_id bigint, price double"


def order():
    return [F.col("received_at").isNull(), F.col("received_at"), F.col("delivery_id")]


def rows(n=3000, seed=1):
    import datetime as dt

    r = random.Random(seed)
    out = []
    for i in range(n):
        hot = r.random() < 0.35  # one message holds a third of all rows
        s = "AB" if hot else r.choice(["ab", "A-B", "CD", None, "e/f"])
        t = 7 if hot else r.choice([None, r.randrange(-50, 50), r.randrange(10**12, 10**12 + 40)])
        at = None if r.random() < 0.2 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(100))
        out.append((i, at, s, t, float(i)))
    r.shuffle(out)
    return out


def expected(data):
    kept = {}
    for i, at, s, t, _ in data:
        if s is None or t is None:
            continue
        k = ("".join(c for c in s.upper() if c.isalnum()), t)
        o = (at is None, str(at), i)
        kept[k] = min(kept.get(k, o), o)
    keep = {o[2] for o in kept.values()}
    return {i for i, at, s, t, _ in data if s is not None and t is not None and i not in keep}


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    marked = mark_repeats(df, instrument("symbol"), F.col("trade_id"), order())
    assert {r[0] for r in marked.where("_repeat").select("_row.delivery_id").collect()} == expected(data)
    assert marked.count() == len(data)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert keep_one(df, F.col("symbol"), F.col("trade_id"), order()).count() == 0
    df = spark.createDataFrame([(1, "x", 5, True), (1, "x", 5, False)], "_code bigint, _entity string, _kind bigint, _repeat boolean")
    out = keep_one(df, F.col("_entity"), F.col("_kind"), [F.col("_repeat")])
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "x", 5, False)]


def test_rows_repeated_whole_keep_one(spark):
    df = spark.createDataFrame([(1, None, "A", 1, 1.0)] * 5, SCHEMA)
    assert keep_one(df, F.col("symbol"), F.col("trade_id"), order()).count() == 1


def test_identifier_that_is_no_number(spark):
    df = coded_identifier(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string"), F.col("k"))
    assert keep_one(df, F.lit("one"), F.col("_number"), [F.col("k")]).count() == 3


def test_ledger_over_batches_and_a_batch_run_again(spark, tmp_path):
    data = rows(1500, 3)
    df = spark.createDataFrame(data, SCHEMA)
    ledger = DeliveryLedger(spark, str(tmp_path / "l"), instrument("symbol"), F.col("trade_id"), order())
    kept = []
    for k in range(3):
        kept += ledger.ingest(df.where(F.col("delivery_id") % 3 == k)).collect()
        assert ledger.version() == k + 1
    known = [("".join(c for c in r.symbol.upper() if c.isalnum()), r.trade_id) for r in kept if r.symbol is not None and r.trade_id is not None]
    assert len(known) == len(set(known))
    assert set(known) == {("".join(c for c in s.upper() if c.isalnum()), t) for _, _, s, t, _ in data if s is not None and t is not None}
    assert ledger.ingest(df.where("symbol is not null and trade_id is not null")).count() == 0
    assert ledger.accepted(1).count() > 0


def test_unfinished_version_is_not_in_force(spark, tmp_path):
    ledger = DeliveryLedger(spark, str(tmp_path / "l"), F.col("symbol"), F.col("trade_id"), order())
    df = spark.createDataFrame([(1, None, "A", 1, 1.0)], SCHEMA)
    commit, ledger._commit = ledger._commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        ledger.ingest(df)
    assert ledger.version() == 0
    ledger._commit = commit
    assert ledger.ingest(df).count() == 1 and ledger.ingest(df).count() == 0
    ledger.remove_old(1)
    assert ledger.ingest(df).count() == 0 and ledger.ingest(df.withColumn("trade_id", F.lit(2))).count() == 1


def test_of_two_writers_one_commits(spark, tmp_path):
    make = lambda: DeliveryLedger(spark, str(tmp_path / "l"), F.col("symbol"), F.col("trade_id"), order())
    one, two = make(), make()
    df = spark.createDataFrame([(1, None, "A", 1, 1.0), (2, None, "A", 2, 1.0)], SCHEMA)
    version, two.version = two.version, lambda: 0  # the second writer began before the first one committed
    one.ingest(df.where("trade_id = 1"))
    with pytest.raises(RuntimeError):
        two.ingest(df)
    two.version = version
    assert [r.trade_id for r in two.accepted(1).collect()] == [1] and [r.trade_id for r in two.ingest(df).collect()] == [2]


def test_only_reached_shards_are_written(spark, tmp_path):
    ledger = DeliveryLedger(spark, str(tmp_path / "l"), F.col("symbol"), F.col("trade_id"), order())
    many = spark.createDataFrame([(i, None, "A", i << 15, 1.0) for i in range(60)], SCHEMA)
    ledger.ingest(many)
    before = ledger.manifest(1)["bits"]
    ledger.ingest(spark.createDataFrame([(99, None, "A", 5, 1.0)], SCHEMA))
    after = ledger.manifest(2)["bits"]
    assert len(before) > 30 and sum(before[k] != after[k] for k in before) == 1
    assert ledger.ingest(many).count() == 0


def test_container_sparse_and_dense():
    import numpy as np

    box, seen = Container(), set()
    r = random.Random(0)
    for _ in range(60):
        low = np.array([r.randrange(2**15) for _ in range(200)])
        won = box.claim(low)
        for x, w in zip(low.tolist(), won):
            assert w == (x not in seen)
            seen.add(x)
    again = Container(box.packed())
    assert not again.claim(np.array(sorted(seen))).any()


@pytest.mark.parametrize("value", [-1, -(2**40), 2**62, 0, 32767, 32768])
def test_any_number(spark, value):
    df = spark.createDataFrame([(1, None, "A", value, 1.0), (2, None, "A", value, 1.0)], SCHEMA)
    assert [r.delivery_id for r in keep_one(df, F.col("symbol"), F.col("trade_id"), order()).collect()] == [1]
