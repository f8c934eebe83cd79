"""Paths, signatures, models, calibration and metrics: queries g*, m*, and f9, f10."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import paths as P
from tidewright.functions.safe import log_ratio
from tidewright.functions.signature import level_slice, signature_dim, with_signature
from tidewright.models import oneclass, sequential, synthetic
from tidewright.operators import scores as M
from tidewright.operators.bars import valid_bars
from tidewright.operators.frames import with_frames
from tidewright.operators.windows import channels, collect_paths
from tidewright.plans import forecast, novelty
from tidewright.queries.base import DAILY, DAY, TICKS, daily, r, tick_bars, ticks
from tidewright.queries.market import SQL_WINDOWS, hourly_windows
from tidewright.queries.rolling import HOURLY, YEAR, in_periods
from tidewright.session import hash_sample, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# paths
#: Channels of the window's path as SQL over wp: c0 time, c1 running log return, c2 volume.
SQL_PATH = f"""{SQL_WINDOWS}, p as (select window_id, pos, (epoch(ts) - min(epoch(ts)) over g) / (max(epoch(ts)) over g - min(epoch(ts)) over g) as c0, ln(close) - first_value(ln(close)) over o as c1, volume as c2
  from wp window g as (partition by window_id), o as (partition by window_id order by pos))"""


def hourly_paths(spark: SparkSession, d: str, wanted: list[str] | None = None) -> DataFrame:
    return channels(hourly_windows(spark, d), ["series"], "ts", wanted or ["time", "log_return", "volume"])


def points(df: DataFrame, path: str = "path", digits: int = 8) -> DataFrame:
    """(window_id, pos, channel, v)."""
    return df.select("window_id", F.posexplode(path).alias("pos", "p")).select("window_id", "pos", F.posexplode("p").alias("channel", "v")).withColumn("v", r("v", digits))


def sql_points(cte: str, n: int, digits: int = 8) -> str:
    return " union all ".join(f"select window_id, pos, {i} as channel, round(c{i}, {digits}) as v from {cte}" for i in range(n))


@query(f"with {SQL_PATH} {sql_points('p', 3)}")
def g1_channels(spark: SparkSession, d: str) -> DataFrame:
    return points(hourly_paths(spark, d))


@query(f"""with {SQL_WINDOWS}, x as (select *, ln(close) - lag(ln(close)) over o as dl, sign(close - lag(close) over o) as up, ln(1 + volume) - lag(ln(1 + volume)) over o as dv, coalesce(ln(open / lag(close) over o), 0) as gap from wp window o as (partition by window_id order by pos)),
  p as (select window_id, pos, ln(close) as c0, sum(coalesce(up, 0) * volume) over o as c1, ln(1 + volume) as c2, sum(coalesce(dv, 0)) over o as c3, ln(high / low) as c4, gap as c5 from x window o as (partition by window_id order by pos)) {sql_points('p', 6)}""")
def g1_other_channels(spark: SparkSession, d: str) -> DataFrame:
    return points(hourly_paths(spark, d, ["log_price", "signed_volume", "log_volume", "log_volume_change", "log_range", "overnight_gap"]))


@query(f"""with {SQL_WINDOWS}, p as (select window_id, pos, ln(close / first_value(close) over o) as c0, ln(1 + sum(volume) over o) as c1, sum(signed_flow) over o / sum(dollar_volume) over (partition by window_id) as c2, ln(high / low) as c3 from wp window o as (partition by window_id order by pos)) {sql_points('p', 4)}""")
def g2_base_path(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("series", "window_id").orderBy("pos")
    run, whole = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("series", "window_id")
    x = hourly_windows(spark, d).withColumns({"c0": log_ratio(F.col("close"), F.first("close").over(run)), "c1": F.log1p(F.sum("volume").over(run)), "c2": F.try_divide(F.sum("signed_flow").over(run), F.sum("dollar_volume").over(whole)), "c3": log_ratio(F.col("high"), F.col("low"))})
    return points(collect_paths(x, ["series"], "ts", [F.col(f"c{i}") for i in range(4)]))


@query(f"""with {TICKS}, x as (select time_bucket(interval 1 day, ts) as b, ts, tick_id, price, price * qty * sign as s, price * qty as n from ticks where price > 0), y as (select b, row_number() over o - 1 as i, count(*) over (partition by b) as cnt,
  100 * ln(price / first_value(price) over o) as c0, sum(s) over o / sum(n) over (partition by b) as c1 from x window o as (partition by b order by ts, tick_id)), g as (select b, cnt, k, k * (cnt - 1) / 7.0 as x from (select distinct b, cnt from y where cnt >= 50), (select unnest(range(8)) as k)),
  z as (select g.b, g.k, lo.c0 + (hi.c0 - lo.c0) * (g.x - lo.i) as c0, lo.c1 + (hi.c1 - lo.c1) * (g.x - lo.i) as c1 from g join y lo on lo.b = g.b and lo.i = least(floor(g.x), g.cnt - 2) join y hi on hi.b = g.b and hi.i = lo.i + 1)
  select b as ts, k as pos, round(c0, 8) as price, round(c1, 8) as imbalance from z""")
def g3_tick_windows(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    t = ticks(spark, d).where("price > 0").withColumn("window_id", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    w = W.partitionBy("series", "window_id").orderBy("ts", "tick_id")
    run, whole = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("series", "window_id")
    x = t.withColumns({"pos": F.row_number().over(w) - 1, "c0": 100 * log_ratio(F.col("price"), F.first("price").over(run)), "c1": F.try_divide(F.sum("signed_notional").over(run), F.sum("notional").over(whole))})
    p = collect_paths(x, ["series"], "ts", [F.col("c0"), F.col("c1")]).where(F.size("path") >= 50)
    p = p.select("window_id", F.posexplode(P.resampled(F.col("path"), 8)).alias("pos", "p"))
    return p.select(F.col("window_id").alias("ts"), "pos", r(F.get("p", F.lit(0))).alias("price"), r(F.get("p", F.lit(1))).alias("imbalance"))


@query(f"with {SQL_WINDOWS}, p as (select window_id, pos, pos / 11.0 as c0, (close - avg(close) over g) / (stddev_pop(close) over g + 1e-8) as c1 from wp window g as (partition by window_id)) {sql_points('p', 2)}")
def g4_z_scored(spark: SparkSession, d: str) -> DataFrame:
    x = collect_paths(hourly_windows(spark, d), ["series"], "ts", [F.col("close")])
    return points(x.withColumn("path", P.z_scored(F.col("path"))))


@query(f"with {SQL_PATH}, q as (select window_id, pos, c0 / 2.0 as c0, c1 as c1, c2 / 10.0 as c2 from p), z as (select distinct window_id, 0 as pos, 0.0 as c0, 0.0 as c1, 0.0 as c2 from p union all select window_id, pos + 1, c0, c1, c2 from q) {sql_points('z', 3)}")
def g5_g6_normalized(spark: SparkSession, d: str) -> DataFrame:
    p = hourly_paths(spark, d)
    return points(p.withColumn("path", P.add_basepoint(P.normalize(F.col("path"), [2.0, 1e-13, 10.0]))))


@query(f"with {SQL_PATH}, z as (select window_id, pos, c1 as c0, 1.0 as c1 from p union all select window_id, 12, c1, 0.0 from p where pos = 11 union all select window_id, 13, 0.0, 0.0 from p where pos = 11) {sql_points('z', 2)}")
def g7_invisibility_reset(spark: SparkSession, d: str) -> DataFrame:
    p = hourly_paths(spark, d, ["log_return"])
    return points(p.withColumn("path", P.invisibility_reset(F.col("path"))))


@query(f"with {SQL_PATH}, k as (select unnest(range(23)) as k), z as (select a.window_id, k as pos, a.c1 as c0, a.c2 as c1, b.c1 as c2, b.c2 as c3 from k join p a on a.pos = ceil(k / 2.0) join p b on b.pos = k // 2 and b.window_id = a.window_id) {sql_points('z', 4)}")
def g8_lead_lag(spark: SparkSession, d: str) -> DataFrame:
    p = hourly_paths(spark, d, ["log_return", "volume"])
    return points(p.withColumn("path", P.lead_lag(F.col("path"), "leads_lags")))


@query(f"with {SQL_PATH}, s as (select window_id, pos, c1, (c1 - lag(c1) over (partition by window_id order by pos)) * power(2, -(11 - pos) / 3.0) as dx from p), z as (select window_id, pos, first_value(c1) over o + sum(coalesce(dx, 0)) over o as c0 from s window o as (partition by window_id order by pos)) {sql_points('z', 1)}")
def f9_g9_recency(spark: SparkSession, d: str) -> DataFrame:
    p = hourly_paths(spark, d, ["log_return"])
    return points(p.withColumn("path", P.recency_weighted(F.col("path"), 3.0)))


@query(f"with {SQL_PATH}, k as (select k, k * 11 / 4.0 as x from (select unnest(range(5)) as k)), z as (select a.window_id, k as pos, k / 4.0 as c0, a.c2 + (b.c2 - a.c2) * (x - a.pos) as c1 from k join p a on a.pos = least(floor(x), 10) join p b on b.pos = a.pos + 1 and b.window_id = a.window_id) {sql_points('z', 2)}")
def f10_g10_g11_resampled(spark: SparkSession, d: str) -> DataFrame:
    p = hourly_paths(spark, d, ["volume"])
    return points(p.withColumn("path", P.time_augment(P.resampled(F.col("path"), 5))))


# signatures
def sql_signature(cte: str, d: int, depth: int, digits: int = 5) -> str:
    """CTEs after `cte` (window_id, pos, c0, ...), and a select of (window_id, term, value) by running sums."""
    ix = range(d)
    steps = ", ".join([f"c{i} - lag(c{i}) over o as d{i}, lag(c{i}) over o - first_value(c{i}) over o as p{i}" for i in ix])
    second = ", ".join([f"coalesce(sum(p{i} * d{j} + d{i} * d{j} / 2) over (partition by window_id order by pos rows between unbounded preceding and 1 preceding), 0) as q{i}{j}" for i in ix for j in ix])
    out, n = [], 0
    for i in ix:
        out.append((n, f"sum(d{i})"))
        n += 1
    for i, j in itertools.product(ix, ix):
        out.append((n, f"sum(p{i} * d{j} + d{i} * d{j} / 2)"))
        n += 1
    if depth > 2:
        for i, j, k in itertools.product(ix, ix, ix):
            out.append((n, f"sum(q{i}{j} * d{k} + p{i} * d{j} * d{k} / 2 + d{i} * d{j} * d{k} / 6)"))
            n += 1
    terms = " union all ".join(f"select window_id, {n} as term, round({e}, {digits}) as value from s3 group by window_id" for n, e in out)
    return f"s1 as (select window_id, pos, {steps} from {cte} window o as (partition by window_id order by pos)), s2 as (select * from s1 where pos > 0), s3 as (select *, {second} from s2) {terms}"


def terms(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select("window_id", F.posexplode("sig").alias("term", "value")).withColumn("value", r("value", digits))


@query(f"with {SQL_PATH}, {sql_signature('p', 3, 2)}")
def g12_signature_2(spark: SparkSession, d: str) -> DataFrame:
    return terms(with_signature(hourly_paths(spark, d), 2))


@query(f"with {SQL_PATH}, {sql_signature('p', 3, 3)}")
def g12_signature_3(spark: SparkSession, d: str) -> DataFrame:
    return terms(with_signature(hourly_paths(spark, d), 3))


@query("select 3 as d, 4 as depth, 120 as terms union all select 5, 4, 780 union all select 7, 3, 399")
def g13_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c, n, signature_dim(c, n)) for c, n in ((3, 4), (5, 4), (7, 3))], "d int, depth int, terms int")


@query(f"with {SQL_PATH}, {sql_signature('p', 3, 2)}")
def g14_level_slice(spark: SparkSession, d: str) -> DataFrame:
    s = with_signature(hourly_paths(spark, d), 3)
    return terms(s.withColumn("sig", level_slice(F.col("sig"), 3, 2)))


@query()
def g15_chunk_signatures(spark: SparkSession, d: str) -> DataFrame:
    """A sequence of signatures of four-row chunks for each window; chunks of one row are skipped."""
    w = hourly_windows(spark, d).withColumns({"chunk": F.floor(F.col("pos") / 4).cast("int"), "_w": F.col("window_id")})
    p = channels(w.withColumn("pos", F.col("pos") % 4), ["series", "chunk"], "ts", ["time", "log_return"]).where(F.size("path") > 1)
    s = with_signature(p, 2)
    return s.groupBy("series", "window_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "sig"))), lambda x: x["sig"]).alias("sequence"))


CFG = novelty.HorizonConfig("one_hour", 12, 4, 3, ("time", "log_return", "volume", "log_range"), 3.0)


@query()
def g17_novelty(spark: SparkSession, d: str) -> DataFrame:
    return novelty.novelty(valid_bars(tick_bars(spark, d)), valid_bars(in_periods(spark, d)), CFG)


SPEC = forecast.ForecastSpec("7d", 30, 7, (1, 7, 30), ("log_return", "volume", "log_range"))


@query()
def g18_dataset(spark: SparkSession, d: str) -> DataFrame:
    return forecast.dataset(daily(spark, d), SPEC)


# distances and detectors
def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


SQL_V = "e as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings)"


@query(f"with {SQL_V}, m as (select i, avg(v) as m from e where label = 0 group by 1) select vec_id, round(sqrt(sum((v - m) * (v - m))), 8) as score from e join m using (i) group by 1")
def m1_expected_distance(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return M.expected_distance(v, v.where("label = 0"), "v").select("vec_id", r("score").alias("score"))


@query()
def m2_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return M.mahalanobis(v, v.where("label <> 1"), "v").select("vec_id", "label", "score")


@query()
def m3_tail_risk_machine(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.models.cvar import tail_risk_scores

    cfg = novelty.HorizonConfig("one_hour", 12, 4, 2, ("time", "log_return"))
    ref = novelty.raw_paths(valid_bars(in_periods(spark, d)), cfg, ["series", "period"])
    scale = novelty.scale_of(ref)
    prepared = lambda p: p.withColumn("path", P.add_basepoint(P.normalize(F.col("path"), scale)))
    return tail_risk_scores(prepared(novelty.raw_paths(valid_bars(tick_bars(spark, d)), cfg)), prepared(ref), 2).select("window_id", "end", "score")


@query(f"""with {SQL_V}, x as (select i, sum(v) as s from e where label = 0 group by 1), y as (select i, sum(v) as s from e where label = 1 group by 1), q as (select count(distinct vec_id) filter (label = 0) as m, count(distinct vec_id) filter (label = 1) as n, sum(v * v) filter (label = 0) as xq, sum(v * v) filter (label = 1) as yq from e)
  select round((sum(x.s * x.s) - any_value(xq)) / (any_value(m) * (any_value(m) - 1)) + (sum(y.s * y.s) - any_value(yq)) / (any_value(n) * (any_value(n) - 1)) - 2 * sum(x.s * y.s) / (any_value(m) * any_value(n)), 8) as mmd2, any_value(m) as m, any_value(n) as n from x join y using (i), q""")
def m4_mmd(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return M.mmd_squared(v.where("label = 0"), v.where("label = 1"), "v").select(r("mmd2").alias("mmd2"), "m", "n")


@query()
def m4_w22_trailing_mmd(spark: SparkSession, d: str) -> DataFrame:
    s = with_signature(hourly_paths(spark, d, ["time", "log_return"]), 2)
    return M.trailing_mmd(s, s.where("window_id < 50"), "sig", ["series"], ["window_id"], 5).select("window_id", "end", "mmd2")


@query()
def m5_one_class(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return oneclass.scored(v, v.where("label = 0"), "v", "vec_id").drop("v")


@query(f"""with {SQL_WINDOWS}, x as (select window_id, ln(close) - lag(ln(close)) over (partition by window_id order by pos) as dx from wp), v as (select window_id, stddev_pop(dx) as v from x group by 1), f as (select avg(v) as m, stddev_pop(v) as s from v where window_id < 100)
  select window_id, round(abs(v - m) / s, 6) as score from v, f""")
def m6_volatility_z(spark: SparkSession, d: str) -> DataFrame:
    from tidewright.operators.summaries import window_features

    v = window_features(hourly_windows(spark, d), ["series"]).select("window_id", "vol")
    f = v.where("window_id < 100").agg(F.avg("vol").alias("m"), F.stddev_pop("vol").alias("s"))
    return v.crossJoin(F.broadcast(f)).select("window_id", r(F.try_divide(F.abs(F.col("vol") - F.col("m")), F.col("s")), 6).alias("score"))  # one row


def hourly_returns(spark: SparkSession, d: str) -> DataFrame:
    x = with_frames(valid_bars(tick_bars(spark, d)), ["series"], "ts", ["ts"], 1, 0, lambda w: {"ret": F.log("close") - F.lag(F.log("close")).over(w)}, 5 * DAY)
    return x.withColumn("range", log_ratio(F.col("high"), F.col("low"))).where("ret is not null")


@query()
def m7_hidden_markov(spark: SparkSession, d: str) -> DataFrame:
    return sequential.hmm_scores(hourly_returns(spark, d), ["series"], "ts", ["ret", "range"])


@query()
def m8_garch(spark: SparkSession, d: str) -> DataFrame:
    return sequential.garch_scores(hourly_returns(spark, d), ["series"], "ts", "ret", 5)


@query(f"""with recursive {HOURLY}, x as (select row_number() over (order by ts) as i, ts, ln(close) - lag(ln(close)) over (order by ts) as ret from b where least(open, high, low, close) > 0), g(i, h) as (select 2::bigint, 0.5::double union all select g.i + 1, 0.1 + 0.1 * power(x.ret, 2) + 0.8 * g.h from g join x on x.i = g.i) select ts, round(h, 8) as h from g join x using (i)""")
def m8_garch_recursion(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["ts"]].assign(h=sequential.garch_variance(pdf["ret"].to_numpy(float), 0.1, 0.1, 0.8, 0.5))

    return sequential.along(hourly_returns(spark, d), ["series"], ["ts"], fn, "ts timestamp_ntz, h double").select("ts", r("h").alias("h"))


@query()
def m9_rolling_signature_machine(spark: SparkSession, d: str) -> DataFrame:
    p = collect_paths(hourly_windows(spark, d, 24, 1), ["series"], "ts", [F.col("close")])
    s = with_signature(p.withColumn("path", P.z_scored(F.col("path"))), 2)
    out = oneclass.scored(s.select("window_id", "end", "sig"), s, "sig", "window_id", ["ocsvm"])
    return out.select("window_id", "end", "ocsvm", (F.col("ocsvm") > 0).alias("anomaly"))


@query(f"with {TICKS}, x as (select tick_id, greatest(-ln(count(*) over (order by price) / count(*) over ()), -ln(count(*) over (order by price desc) / count(*) over ())) + greatest(-ln(count(*) over (order by qty) / count(*) over ()), -ln(count(*) over (order by qty desc) / count(*) over ())) as s from ticks) select tick_id, round(s, 8) as score from x")
def m10_ecod(spark: SparkSession, d: str) -> DataFrame:
    return M.ecod(ticks(spark, d).select("tick_id", "price", "qty"), ["price", "qty"]).select("tick_id", r("score").alias("score"))


@query()
def m11_matrix_profile(spark: SparkSession, d: str) -> DataFrame:
    return sequential.profile_scores(hourly_returns(spark, d), ["series"], "ts", "ret", 30)


@query()
def m12_changepoints(spark: SparkSession, d: str) -> DataFrame:
    return sequential.changepoint_times(hourly_returns(spark, d), ["series"], "ts", "range", [1.0, 3.0, 10.0])


@query()
def m13_scaled_components(spark: SparkSession, d: str) -> DataFrame:
    """First three centred principal components of the scaled vectors, from summed moments."""
    import numpy as np

    v = vectors(spark, d)
    n, s, q = M.moments(v, "v")
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov))
    values, axes = np.linalg.eigh(cov / np.outer(sd, sd))
    axes = axes[:, np.argsort(values)[::-1][:3]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    z = F.zip_with("v", F.array(*[F.struct(F.lit(float(a)).alias("m"), F.lit(float(b)).alias("s")) for a, b in zip(mean, sd)]), lambda x, p: (x - p["m"]) / p["s"])
    return v.select("vec_id", *[M.dot(z, F.array(*[F.lit(float(x)) for x in axes[:, i]])).alias(f"pc{i + 1}") for i in range(3)])


# forecasts
@query()
def m14_m16_x25_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return forecast.compare(forecast.dataset(daily(spark, d), SPEC), SPEC)


@query()
def m31_ranking(spark: SparkSession, d: str) -> DataFrame:
    return forecast.ranking(forecast.compare(forecast.dataset(daily(spark, d), SPEC), SPEC), SPEC.horizon)


@query()
def m17_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    x = forecast.checkpointed(forecast.dataset(daily(spark, d), SPEC).withColumn("features", array_to_vector("x_stats")))
    cut = x.agg(F.expr("percentile_approx(ts, 0.8)")).first()[0]
    model = GBTRegressor(featuresCol="features", labelCol="y", maxDepth=3, maxIter=500, stepSize=0.03, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42).fit(x.where(F.col("target_end") < F.lit(cut)))
    return model.transform(x.where(F.col("ts") >= F.lit(cut))).select("ts", "y", "prediction")


@query()
def m18_networks(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    from tidewright.models.neural import FIT_ROWS, MLP

    x = forecast.checkpointed(forecast.dataset(daily(spark, d), SPEC))
    cut = x.agg(F.expr("percentile_approx(ts, 0.8)")).first()[0]
    rows = hash_sample(x.where(F.col("target_end") < F.lit(cut)).select("x_stats", "y", "ts"), ["ts"], FIT_ROWS).collect()
    model = MLP().fit(np.array([a[0] for a in rows], float), np.array([a[1] for a in rows], float))

    def run(batches):
        for pdf in batches:
            yield pdf[["ts", "y"]].assign(prediction=model.predict(np.array(pdf["x_stats"].tolist(), float)))

    return x.where(F.col("ts") >= F.lit(cut)).select("ts", "y", "x_stats").mapInPandas(run, "ts timestamp_ntz, y double, prediction double")


@query()
def m19_shape_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Multinomial logistic model on signatures of 200 synthetic paths a shape: each of five folds is predicted from the other four."""
    from tidewright.models.linear import shape_folds

    s = with_signature(synthetic.synthetic_paths(spark), 3)
    y = F.array_position(F.array(*[F.lit(x) for x in synthetic.SHAPES]), F.col("label")).cast("int") - 1
    return shape_folds(s.select("id", y.alias("y"), "sig"), 5)


# calibration and metrics
@query("""with e as (select event_id, event_id % 2 as h, value from events), n as (select h, count(*) as n from e group by 1)
  select a.event_id, round((1 + (select count(*) from e c where c.h <> a.h and c.value >= a.value)) / ((select n from n where n.h <> a.h) + 1.0), 8) as p_value from e a""")
def m20_empirical_p(spark: SparkSession, d: str) -> DataFrame:
    """Every event against the events of the other half."""
    e = table(spark, d, "events").select("event_id", "value")
    halves = [M.calibrated(e.where(f"event_id % 2 = {k}"), e.where(f"event_id % 2 = {1 - k}"), "value") for k in (0, 1)]
    return halves[0].unionByName(halves[1]).select("event_id", r("p_value").alias("p_value"))


@query("with s as (select value, row_number() over (order by value) as i, count(*) over () as n from events where value > 0), t as (select ln(1 - i / (n + 1.0)) as y, power(value, 2.0 / 4) as x, n from s where i > floor(0.7 * n)) select round(exp(regr_intercept(y, x)), 8) as a, round(-regr_slope(y, x), 8) as b, max(n) as n from t")
def m21_weibull(spark: SparkSession, d: str) -> DataFrame:
    return M.weibull_tail(table(spark, d, "events").where("value > 0"), "value", 4).select(r("a").alias("a"), r("b").alias("b"), "n")


@query("""with p as (select event_id, exp(-value / 20.0) as p from events), r as (select event_id, p, count(*) over (order by p) as i, count(*) over () as n from p), c as (select max(p) as cut from r where p <= i * 0.1 / n) select event_id, coalesce(p <= cut, false) as rejected from p, c""")
def m22_false_discoveries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.exp(-F.col("value") / 20.0).alias("p"))
    return M.benjamini_hochberg(e, "p", 0.1).select("event_id", "rejected")


@query("""with x as (select event_type = 'error' as y, value, user_id % 3 as k, rank() over (partition by user_id % 3 order by value) + (count(*) over (partition by user_id % 3, value) - 1) / 2.0 as r from events), s as (select k, sum(y::int) as n1, count(*) - sum(y::int) as n0, sum(r) filter (y) as rs from x group by 1),
  t as (select k, sum(c * c * c - c) as ties from (select k, value, count(*)::double as c from x group by 1, 2) group by 1)
  select k, round((rs - n1 * (n1 + 1) / 2.0) / (n1 * n0), 8) as auroc, rs - n1 * (n1 + 1) / 2.0 as u, round((rs - n1 * (n1 + 1) / 2.0 - n1 * n0 / 2.0) / sqrt(n1 * n0 / 12.0 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))), 8) as z, n1 as n_pos, n0 as n_neg from s join t using (k)""")
def m23_m26_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.col("user_id") % 3)
    return M.rank_metrics(e, F.col("value"), F.col("event_type") == "error", ["k"]).select("k", r("auroc").alias("auroc"), "u", r("z").alias("z"), "n_pos", "n_neg")


@query("with x as (select (value > 60)::int as r, (event_type = 'error')::int as p from events) select round(coalesce(sum(r * (1 - p)) / nullif(sum(r), 0), 0), 8) as fdr, round(sum(r * p) / nullif(sum(p), 0), 8) as power from x")
def m24_discovery_rates(spark: SparkSession, d: str) -> DataFrame:
    return M.discovery_rates(table(spark, d, "events"), F.col("value") > 60, F.col("event_type") == "error").select(r("fdr").alias("fdr"), r("power").alias("power"))


@query()
def m25_spike_curve(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of the expected-signature distance by magnitude of an injected spike."""
    ref = hourly_paths(spark, d, ["time", "log_return"])
    scale = novelty.scale_of(ref)
    ref = forecast.checkpointed(ref.withColumn("path", P.add_basepoint(P.normalize(F.col("path"), scale))).select("window_id", "path"))
    trials = synthetic.spike_trials(ref, "window_id", 1, [0.0, 2.0, 4.0, 8.0], 100)
    scored = M.expected_distance(with_signature(trials, 3), with_signature(ref, 3), "sig")
    return M.rank_metrics(scored, F.col("score"), F.col("positive"), ["magnitude"]).select("magnitude", "auroc", "n_pos", "n_neg")


@query("select event_type, round(avg(value - 20), 8) as mean, round(avg(value - 20) / (stddev_samp(value) / sqrt(count(*))), 6) as t, count(*) as n from events group by 1")
def m27_t_test(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", (F.col("value") - 20).alias("x"))
    return M.t_test(e, "x", ["event_type"]).select("event_type", r("mean").alias("mean"), r("t", 6).alias("t"), "n")


@query()
def m28_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    observed, n = e.where("event_type = 'error'").select(F.avg("value"), F.count("value")).first()
    return synthetic.bootstrap_p(e, "value", observed, n, 1000)


@query(f"""with {DAILY}, x as (select ts, power(ln(close) - lag(ln(close)) over (order by ts), 2) as a, power(ln(close / open), 2) as b from d), e as (select ts, a - b as v from x where a is not null),
  l as (select v, lag(v) over (order by ts) as l1, lag(v, 2) over (order by ts) as l2 from e) select round(avg(v) / sqrt((var_pop(v) + 2 * (2.0 / 3) * covar_samp(v, l1) + 2 * (1.0 / 3) * covar_samp(v, l2)) / count(v)), 6) as dm, count(v) as n from l""")
def m29_forecast_comparison(spark: SparkSession, d: str) -> DataFrame:
    x = with_frames(daily(spark, d), ["series"], "ts", ["ts"], 1, 0, lambda w: {"a": F.pow(F.log("close") - F.lag(F.log("close")).over(w), F.lit(2.0))}, YEAR).where("a is not null")
    return M.diebold_mariano(x, F.col("a"), F.pow(log_ratio(F.col("close"), F.col("open")), F.lit(2.0)), "ts", 3).select(r("dm", 6).alias("dm"), "n")


@query("""with c as (select sum(t * p) as tp, sum((1 - t) * p) as fp, sum(t * (1 - p)) as fn, sum((1 - t) * (1 - p)) as tn from (select (event_type = 'error')::int as t, (value > 30)::int as p from events))
  select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 8) as accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 8) as balanced, round(tp / (tp + fp), 8) as "precision", round(tp / (tp + fn), 8) as recall, round(2 * tp / (2 * tp + fp + fn), 8) as f1 from c""")
def m30_classification(spark: SparkSession, d: str) -> DataFrame:
    c = M.classification(table(spark, d, "events"), F.col("event_type") == "error", F.col("value") > 30)
    return c.select("tp", "fp", "fn", "tn", *[r(x).alias(x) for x in ("accuracy", "balanced", "precision", "recall", "f1")])


@query(f"with {TICKS} select sign, round(sqrt(avg(power(price - qty, 2))), 8) as rmse, round(avg(abs(price - qty)), 8) as mae, round(1 - sum(power(price - qty, 2)) / (var_pop(price) * count(price)), 6) as r2, count(*) as n from ticks group by 1")
def m31_regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = M.regression_metrics(ticks(spark, d), "price", "qty", ["sign"])
    return m.select("sign", r("rmse").alias("rmse"), r("mae").alias("mae"), r("r2", 6).alias("r2"), "n")


@query(f"""with recursive {HOURLY}, e as (select ts from b where trades >= 20), k as (select min(ts) as ts from e union all select (select min(e.ts) from e where e.ts >= k.ts + interval 6 hours) from k where k.ts is not null),
  x as (select ts, abs(lead(close, 1) over (order by ts) / close - 1) as ret_1, abs(lead(close, 5) over (order by ts) / close - 1) as ret_5, case when count(*) over f1 = 1 then greatest(max(high) over f1 / close - 1, 1 - min(low) over f1 / close) end as exc_1,
    case when count(*) over f5 = 5 then greatest(max(high) over f5 / close - 1, 1 - min(low) over f5 / close) end as exc_5 from b window f1 as (order by ts rows between 1 following and 1 following), f5 as (order by ts rows between 1 following and 5 following)),
  s as (select ts, 1 as lag, ret_1 as ret, exc_1 as exc from x union all select ts, 5, ret_5, exc_5 from x) select lag, count(ret) filter (h) as n, round(avg(ret) filter (h), 8) as mean_ret, round(avg(ret) filter (h) / avg(ret), 8) as multiple, round(avg(exc) filter (h), 8) as mean_exc from (select s.*, ts in (select ts from k where ts is not null) as h from s) group by 1""")
def m32_detection_evaluation(spark: SparkSession, d: str) -> DataFrame:
    b = tick_bars(spark, d)
    out = novelty.evaluate_detections(b, b.where("trades >= 20"), [1, 5], 6 * 3600, replicates=0)
    return out.select("lag", "n", r("mean_ret").alias("mean_ret"), r("multiple").alias("multiple"), r("mean_exc").alias("mean_exc"))


@query()
def m32_bootstrap_p(spark: SparkSession, d: str) -> DataFrame:
    """The part of M32 that SQL does not express."""
    b = tick_bars(spark, d)
    return novelty.evaluate_detections(b, b.where("trades >= 20"), [1, 5], 6 * 3600)


@query()
def m33_synthetic_paths(spark: SparkSession, d: str) -> DataFrame:
    return synthetic.synthetic_paths(spark)


@query()
def x22_random_periods(spark: SparkSession, d: str) -> DataFrame:
    return novelty.random_period_runs(tick_bars(spark, d), "trades", 10, 7 * DAY, [0.9, 0.95, 0.975, 0.99], [1, 5], 6 * 3600)


@query()
def x25_ablation(spark: SparkSession, d: str) -> DataFrame:
    v = {"price": {"dims": ("log_return",)}, "price_activity": {"dims": ("log_return", "volume")}}
    return forecast.ablation(daily(spark, d), SPEC, v).select("setting", "fold", "rmse", "mae", "r2", "n")
