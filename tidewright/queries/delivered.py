"""Queries p1, p2 and p4: redelivered messages, trailing totals, regular grid."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.symbols import instrument
from tidewright.operators.redelivery import DeliveryLedger, keep_one, ledger_path, mark_repeats
from tidewright.operators.regular_grid import OBSERVED, cells, regular_grid
from tidewright.operators.trailing import trailing_totals
from tidewright.session import table


def _arrival() -> list:
    return [F.col("received_at").isNull(), F.col("received_at"), F.col("delivery_id")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "trades").select("delivery_id", "received_at", "symbol", "trade_id")
    marked = mark_repeats(trades, instrument("symbol"), F.col("trade_id"), _arrival())
    return marked.where("_repeat").select(F.col("_row.delivery_id").alias("delivery_id"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "trades")
    return keep_one(trades, instrument("symbol"), F.col("trade_id"), _arrival())


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries that enter the ledger when the batches come in four parts one after the other, and the part they came with."""
    trades = table(spark, d, "trades").select("delivery_id", "batch_id", "received_at", "symbol", "trade_id")
    lo, hi = trades.agg(F.min("batch_id"), F.max("batch_id")).first()
    part = F.coalesce(F.floor((F.col("batch_id") - F.lit(lo)) * 4 / F.lit((hi or 0) - (lo or 0) + 1)), F.lit(3)).cast("int")
    ledger = DeliveryLedger(spark, ledger_path(spark), instrument("symbol"), F.col("trade_id"), _arrival())
    kept = [ledger.ingest(trades.where(part == k), k).select("delivery_id", F.lit(k).alias("part")) for k in range(4)]
    return functools.reduce(DataFrame.unionByName, kept)


P1_RANK = """select *, row_number() over (partition by regexp_replace(upper(symbol), '[^A-Z0-9]', '', 'g'), trade_id
             order by received_at nulls last, delivery_id) as rn from trades"""

MEASURES = ["log_return", "realized_vol", "realized_var"]


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    env = table(spark, d, "daily_env").select("symbol", "obs_date", *MEASURES, "loaded_at")
    out = trailing_totals(env, "symbol", "obs_date", MEASURES, [7, 30], F.col("loaded_at"))
    return out.select("symbol", "obs_date", *[(F.round(c, 9) if "_n_" not in c else F.col(c)).alias(c) for c in out.columns[2:]])


def _p2_sql() -> str:
    cols = []
    for m in MEASURES:
        for w in (7, 30):
            frame = f"over (partition by s.symbol order by s.d range between interval {w - 1} days preceding and current row)"
            cols += [f"round(sum({m}) {frame}, 9) as {m}_sum_{w}", f"round(avg({m}) {frame}, 9) as {m}_avg_{w}", f"count({m}) {frame} as {m}_n_{w}"]
    clean = ", ".join(f"case when isnan({m}) then null else {m} end as {m}" for m in MEASURES)
    return f"""with r as (select symbol, obs_date, {clean}, row_number() over (partition by symbol, obs_date order by loaded_at desc nulls last,
        log_return desc nulls last, realized_vol desc nulls last, realized_var desc nulls last) as rn
        from daily_env where symbol is not null and obs_date is not null),
      b as (select symbol, min(obs_date) as lo, max(obs_date) as hi from r group by symbol),
      s as (select symbol, cast(unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day)) as date) as d from b)
      select s.symbol as symbol, s.d as obs_date, {", ".join(cols)} from s left join (select * from r where rn = 1) r on r.symbol = s.symbol and r.obs_date = s.d"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "trades")
    return regular_grid(cells(trades, instrument("symbol"), "ts", "price", "qty", ["delivery_id"], 300))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    empty = _grid(spark, d).where((F.col("status") != OBSERVED) & (F.floor(F.col("previous_cell") / 288) == F.floor(F.col("next_cell") / 288)))
    return empty.select(F.col("source").alias("instrument"), "cell_start_s")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select(F.col("source").alias("instrument"), "cell_start_s", "status", F.round("value", 8).alias("last_price"), F.round("amount", 6).alias("size"), "readings")


P4_CELLS = """c as (select regexp_replace(upper(symbol), '[^A-Z0-9]', '', 'g') as instrument, epoch_us(ts) // 300000000 as cell, arg_max(price, (ts, delivery_id)) as price,
  sum(qty) as size, count(*) as readings from trades where symbol is not null and ts is not null and price > 0 and qty > 0 and not isnan(price) and not isnan(qty) group by 1, 2)"""
P4_FOUND_SQL = f"""with {P4_CELLS}, n as (select *, lead(cell) over (partition by instrument order by cell) as next from c)
  select instrument, unnest(generate_series(cell + 1, next - 1)) * 300 as cell_start_s from n where next > cell + 1 and next // 288 = cell // 288"""
P4_MARKS_SQL = f"""with {P4_CELLS}, n as (select *, lead(cell) over (partition by instrument order by cell) as next from c),
  g as (select *, unnest(generate_series(cell, coalesce(next - 1, cell))) as x from n)
  select instrument, x * 300 as cell_start_s, case when x = cell then 'observed' when next - cell <= 12 then 'filled' else 'gap' end as status,
  case when x = cell then round(price, 8) end as last_price, case when x = cell then round(size, 6) when next - cell <= 12 then 0.0 end as size, case when x = cell then readings else 0 end as readings from g"""


def _slope(h0: str, d0: str, h1: str, d1: str) -> str:
    return f"(case when {d0} * {d1} <= 0 then 0 else (3 * ({h0} + {h1})) / ((2 * {h1} + {h0}) / nullif({d0}, 0) + ({h1} + 2 * {h0}) / nullif({d1}, 0)) end)"


def _end(h: str, d: str, h1: str, d1: str) -> str:
    s = f"(((2 * {h} + {h1}) * {d} - {h} * {d1}) / ({h} + {h1}))"
    return f"(case when {s} * {d} <= 0 then 0 when {d} * {d1} <= 0 and abs({s}) > 3 * abs({d}) then 3 * {d} else {s} end)"


P4_GRID_SQL = f"""with {P4_CELLS},
  k as (select *, lag(cell) over w as pc, lag(price) over w as pv, lead(cell) over w as nc, lead(price) over w as nv, lead(cell, 2) over w as nnc, lead(price, 2) over w as nnv from c window w as (partition by instrument order by cell)),
  s as (select *, (nc - cell)::double as h, (cell - pc)::double as h0, (nnc - nc)::double as h1, (nv - price) / (nc - cell) as d, (price - pv) / (cell - pc) as d0, (nnv - nv) / (nnc - nc) as d1, coalesce(cell - pc <= 12, false) as before, coalesce(nnc - nc <= 12, false) as after from k),
  m as (select *, case when before then {_slope("h0", "d0", "h", "d")} when after then {_end("h", "d", "h1", "d1")} else d end as m0, case when after then {_slope("h", "d", "h1", "d1")} when before then {_end("h", "d", "h0", "d0")} else d end as m1 from s),
  g as (select *, unnest(generate_series(cell, coalesce(nc - 1, cell))) as x from m), t as (select *, (x - cell) / nullif(h, 0) as t from g)
  select instrument, x * 300 as cell_start_s, case when x = cell then 'observed' when h <= 12 then 'filled' else 'gap' end as status,
  round(case when x = cell then price when h <= 12 then (1 + 2 * t) * (1 - t) * (1 - t) * price + t * (1 - t) * (1 - t) * h * m0 + t * t * (3 - 2 * t) * nv + t * t * (t - 1) * h * m1 end, 8) as last_price,
  case when x = cell then round(size, 6) when h <= 12 then 0.0 end as size, case when x = cell then readings else 0 end as readings from t"""


def p4_marks(spark: SparkSession, d: str) -> DataFrame:
    grid = p4_grid(spark, d)
    return grid.withColumn("last_price", F.when(F.col("status") == OBSERVED, F.col("last_price")))


QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept, "p1_ledger": p1_ledger, "p2_rolling": p2_rolling, "p4_found": p4_found, "p4_marks": p4_marks, "p4_grid": p4_grid}
SQL = {
    "p1_found": f"select delivery_id from ({P1_RANK}) where rn > 1 and symbol is not null and trade_id is not null",
    "p1_kept": f"select * exclude (rn) from ({P1_RANK}) where rn = 1 or symbol is null or trade_id is null",
    "p1_ledger": """with b as (select *, coalesce(floor((batch_id - min(batch_id) over ()) * 4 / (max(batch_id) over () - min(batch_id) over () + 1)), 3)::int as part, regexp_replace(upper(symbol), '[^A-Z0-9]', '', 'g') as i from trades),
      r as (select *, row_number() over (partition by i, trade_id order by part, received_at nulls last, delivery_id) as rn from b)
      select delivery_id, part from r where rn = 1 or symbol is null or trade_id is null""",
    "p2_rolling": _p2_sql(),
    "p4_found": P4_FOUND_SQL,
    "p4_marks": P4_MARKS_SQL,
    "p4_grid": P4_GRID_SQL,
}
