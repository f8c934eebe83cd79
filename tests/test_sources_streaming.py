import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewright.operators.redelivery import DeliveryLedger
from tidewright.plans.memo import Memo
from tidewright.sources import market_files as S
from tidewright.streaming.live import stream_bars, stream_once, stream_two_sigma


def test_files_of_both_units_and_headers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("id,price,qty,quote,time,m,b\n1,2.5,1,2.5,1704067200000,True,true\n")
    (tmp_path / "t" / "b.csv").write_text("2,x,1,2.5,1704067200000001,false,TRUE\n3,1,1,1,,false,true\n")
    t = {r.trade_id: r for r in S.read(spark, "trades", str(tmp_path / "t")).collect()}
    assert t[1].ts == dt.datetime(2024, 1, 1) and t[2].ts == dt.datetime(2024, 1, 1, 0, 0, 0, 1) and t[2].price is None and t[3].ts is None and t[1].is_buyer_maker is True
    with zipfile.ZipFile(tmp_path / "k.zip", "w") as z:
        z.writestr("k.csv", "open_time,o,h,l,c,v,ct,q,n,tb,tq,i\n1704067200000,1,2,0.5,1.5,10,0,0,5,4,0,0\n")
    k = S.read(spark, "klines", str(tmp_path / "k.zip")).collect()
    assert len(k) == 1 and (k[0].taker_sell_base, k[0].imbalance) == (6.0, -2.0)
    (tmp_path / "broken.zip").write_text("no archive")
    with pytest.raises(Exception):
        S.read(spark, "klines", str(tmp_path / "broken.zip")).collect()
    with pytest.raises(ValueError):
        S.read(spark, "nothing", "x")


def test_daily_index_scores(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,1,2,10\n2024-01-01,1,2,1,1.5,10\n2024-01-03,1,2,1,,10\n")
    d = S.read_daily(spark, str(tmp_path / "d.csv")).collect()
    assert [r.ts.day for r in d] == [1, 2] and d[1].dollar_volume == 20.0
    (tmp_path / "i.json").write_text('{"ts_ms": 1704067200000, "close": 50.0}\n{"ts_ms": 1704067200000, "close": 50.0}\n{"ts_ms": 1704070800000, "close": 51.0}\n')
    assert S.read_volatility_index(spark, str(tmp_path / "i.json")).count() == 2
    (tmp_path / "s.csv").write_text("date,anomaly_score,flag\n2024-01-01T00:00:00+00:00,1.5,1\n2024-01-02,x,\n")
    s = S.read_scores(spark, str(tmp_path / "s.csv")).collect()
    assert s[0].flag == 1 and s[0].ts == dt.datetime(2024, 1, 1) and s[1].anomaly_score is None


def test_day_partitions_are_pruned_and_replaced(spark, tmp_path):
    root = str(tmp_path / "days")
    rows = spark.createDataFrame([(dt.datetime(2024, 1, i, h), i) for i in (1, 2, 3) for h in (1, 2)], "ts timestamp_ntz, x int")
    S.write_days(rows, root)
    S.write_days(rows.where("x = 2").withColumn("x", F.lit(9)), root)
    got = S.read_days(spark, root, "2024-01-02", "2024-01-05")
    assert sorted(r.x for r in got.collect()) == [3, 3, 9, 9]
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()
    S.write_csv(rows, str(tmp_path / "c"))
    assert any(f.endswith(".csv") for f in os.listdir(tmp_path / "c"))


def test_stream_of_bars_and_flags(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", i, t0 + dt.timedelta(seconds=60 * i), 100.0 + (50 if i == 200 else i % 3), 1.0) for i in range(240)]
    spark.createDataFrame(rows, "series string, tick_id bigint, ts timestamp, price double, qty double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("series string, tick_id bigint, ts timestamp, price double, qty double").parquet(str(tmp_path / "in"))
    q = stream_bars(source()).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bars_out").where("trades = 5").count() >= 40
    q = stream_two_sigma(source().select("series", "ts", F.col("price").alias("close"))).writeStream.format("memory").queryName("flags_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("flags_out").collect()
    assert len(out) == 240 and any(r.flagged and r.ts == rows[200][2] for r in out)


def test_stream_through_the_ledger(spark, tmp_path):
    schema = "delivery_id bigint, symbol string, trade_id bigint"
    for k in range(3):
        spark.createDataFrame([(10 * k + i, "a", i + k) for i in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger = DeliveryLedger(spark, str(tmp_path / "ledger"), F.col("symbol"), F.col("trade_id"), [F.col("delivery_id")])
    got = []
    q = stream_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ledger, lambda df, v: got.extend((v, r.trade_id) for r in df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted(t for _, t in got) == list(range(7)) and {v for v, _ in got} == {0, 1, 2}


def test_a_crash_between_commit_and_sink_loses_nothing(spark, tmp_path):
    schema = "delivery_id bigint, symbol string, trade_id bigint"
    spark.createDataFrame([(i, "a", i % 4) for i in range(9)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    ledger = DeliveryLedger(spark, str(tmp_path / "ledger"), F.col("symbol"), F.col("trade_id"), [F.col("delivery_id")])
    got = []

    def run(sink):
        q = stream_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ledger, sink, str(tmp_path / "c"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="sink is down"):
        run(lambda df, v: (_ for _ in ()).throw(OSError("sink is down")))
    assert ledger.version() == 1
    run(lambda df, v: got.extend((v, r.trade_id) for r in df.collect()))
    assert sorted(got) == [(0, t) for t in range(4)] and ledger.version() == 1


def test_memo_releases_the_oldest(spark):
    m, built = Memo(2), []

    def make(k):
        built.append(k)
        return spark.range(3)

    for k in ("a", "b", "a", "c", "b"):
        m.get(k, lambda k=k: make(k))
    assert built == ["a", "b", "c", "b"]
