"""Queries p3 and p7 to p9. SQL expresses p3 and the shares of p8; tests hold the others against round trips, brute force and held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.mixing import mix
from tidewright.llm.nearest import nearest_in_time
from tidewright.llm.sentences import sentences
from tidewright.llm.tokens import round_trip, token_ids
from tidewright.session import table


def _matched(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "var_quotes").select("quote_id", "symbol", "quoted_at", "strike_var")
    scores = table(spark, d, "anomaly_scores").where(F.col("anomaly_score").isNotNull() & ~F.isnan("anomaly_score"))
    return nearest_in_time(quotes, scores, "symbol", "quoted_at", "scored_at", "quote_id", "score_id", ["anomaly_score", "flag"], 300)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).where("score_id is not null").select("quote_id", "score_id")


def p3_matched(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("quote_id", "symbol", "score_id", "anomaly_score", "flag", "gap_us")


P3_SQL = """with q as (select distinct quote_id, symbol, quoted_at from var_quotes where symbol is not null and quoted_at is not null and quote_id is not null),
  s as (select distinct score_id, symbol, scored_at, anomaly_score, flag from anomaly_scores
        where symbol is not null and scored_at is not null and anomaly_score is not null and not isnan(anomaly_score)),
  j as (select q.quote_id, q.symbol, s.score_id, s.anomaly_score, s.flag, epoch_us(s.scored_at) - epoch_us(q.quoted_at) as gap_us,
        row_number() over (partition by q.quote_id order by abs(epoch_us(s.scored_at) - epoch_us(q.quoted_at)), s.scored_at, s.score_id) as rn
        from q join s on s.symbol = q.symbol and s.scored_at between q.quoted_at - interval 300 seconds and q.quoted_at + interval 300 seconds)"""


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return round_trip(table(spark, d, "documents"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences(table(spark, d, "documents"))


QUERIES = {"p3_found": p3_found, "p3_matched": p3_matched, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_selection": p8_selection, "p8_shares": p8_shares, "p9_found": p9_found}
SQL: dict[str, str] = {
    "p3_found": P3_SQL + " select quote_id, score_id from j where rn = 1",
    "p3_matched": P3_SQL + " select q.quote_id, q.symbol, j.score_id, j.anomaly_score, j.flag, j.gap_us from q left join (select * from j where rn = 1) j on j.quote_id = q.quote_id",
}
