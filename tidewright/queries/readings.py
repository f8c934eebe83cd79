"""Queries p5 and p6: instants from texts, implausible bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.instants import FIRST_US, FIXED_ZONES, LAST_US, MONTHS, WEEKDAYS, declared_instants, to_instants
from tidewright.operators.spikes import flag_bars
from tidewright.session import small, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    ticks = table(spark, d, "tick_feed").select("rec_id", "venue_id", F.col("ts_raw").alias("raw"))
    scores = table(spark, d, "score_log").select("rec_id", "venue_id", F.col("date_raw").alias("raw"))
    venues = table(spark, d, "venues").select("venue_id", "tz_name", "date_order")
    return ticks.unionByName(scores).join(small(venues), "venue_id", "left")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Slashed dates in the order their venue declares, as the definition has it, so that no mixture is fitted; p5_learned fits one."""
    return declared_instants(_texts(spark, d), "raw", F.col("tz_name"), F.col("date_order")).select("rec_id", "utc_us").distinct()


def p5_readings(spark: SparkSession, d: str) -> DataFrame:
    """The order of slashed dates learned per venue from the texts alone, and how sure each reading is."""
    out = to_instants(_texts(spark, d), "raw", F.col("venue_id"), F.col("tz_name"), None)
    return out.select("rec_id", "venue_id", "date_order", "raw", "utc_us", "format", "posterior", "status").distinct()


def p5_learned(spark: SparkSession, d: str) -> DataFrame:
    return p5_readings(spark, d).where("utc_us is not null").select("rec_id", "utc_us").distinct()


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return flag_bars(table(spark, d, "price_bars"), "symbol", "bar_start", "bar_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).where("impossible or spike or stuck").select("bar_id").distinct()


def p6_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


QUERIES = {"p5_found": p5_found, "p5_learned": p5_learned, "p5_readings": p5_readings, "p6_found": p6_found, "p6_flags": p6_flags}


def _p5_sql() -> str:
    """The definition: one branch a form of text, then one conversion of wall time by offset or zone."""
    tail = r"(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp][Mm]))?(?: ?([Zz]|[+-]\d{2}:?\d{2}|\[[A-Za-z0-9_/+-]+\])| ([A-Za-z]{3,5}|[A-Z][A-Za-z]+/[A-Za-z0-9_/+-]+))?)?$"
    month = "case " + " ".join(f"when lower(x.{{0}}) in ('{m}', '{m[:3]}'{{1}}) then {i + 1}".replace("{1}", ", 'sept'" if m == "september" else "") for i, m in enumerate(MONTHS)) + " end"
    full = "case when x.y::int < 100 then 2000 + x.y::int else x.y::int end"
    order = lambda d, m, y: f"case date_order when 'dmy' then {d} when 'mdy' then {m} when 'ymd' then {y} end"
    short = "case when length(x.y) = 2 then {0} end"
    forms = [
        (r"(\d{4})-(\d{1,2})-(\d{1,2})", "yab", "x.y::int", "x.a::int", "x.b::int"),
        (r"(\d{4})/(\d{1,2})/(\d{1,2})", "yab", "x.y::int", "x.a::int", "x.b::int"),
        (r"(\d{4})-(\d{3})", "yb", "case when x.b::int > 0 and (x.b::int < 366 or (x.b::int = 366 and x.y::int % 4 = 0 and (x.y::int % 100 <> 0 or x.y::int % 400 = 0))) then x.y::int end", "1", "x.b::int"),
        (r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})", "aby", full, "x.b::int", "x.a::int"),
        (r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", "aby", order(full, full, short.format("2000 + x.a::int")), order("x.b::int", "x.a::int", "x.b::int"), order("x.a::int", "x.b::int", short.format("x.y::int"))),
        (rf"(?:(?i:{WEEKDAYS}), )?(\d{{1,2}})-([A-Za-z]{{3,9}})-(\d{{4}})", "aby", "x.y::int", month.format("b"), "x.a::int"),
        (rf"(?:(?i:{WEEKDAYS}), )?(\d{{1,2}}) ([A-Za-z]{{3,9}}) (\d{{4}})", "aby", "x.y::int", month.format("b"), "x.a::int"),
        (r"([A-Za-z]{3,9}) (\d{1,2}), (\d{4})", "bay", "x.y::int", month.format("b"), "x.a::int"),
    ]
    parts = []
    for k, (head, groups, y, m, d) in enumerate(forms):
        names = ", ".join(f"'{g}'" for g in [*groups, "hh", "mi", "ss", "fr", "half", "z", "zn"])
        days = f"try_cast(({y})::varchar || '-01-01' as date) + ({d}) - 1" if head == r"(\d{4})-(\d{3})" else f"try_cast(({y})::varchar || '-' || ({m})::varchar || '-' || ({d})::varchar as date)"
        parts.append(f"select rec_id, tz_name, {days} as day, x.hh as hh, x.mi as mi, x.ss as ss, x.fr as fr, lower(x.half) as half, replace(replace(x.z || x.zn, '[', ''), ']', '') as z from (select *, regexp_extract(s, '^{head}{tail}', [{names}]) as x from t where regexp_matches(s, '^{head}{tail}'))")
    unit = " ".join(f"when {e} >= {FIRST_US} and {e} < {LAST_US} then {e}" for e in ("n * 1000000", "n * 1000", "n", "n // 1000"))
    digits = "select rec_id, tz_name, try_cast(s[1:4] || '-' || s[5:6] || '-' || s[7:8] as date) as day, s[9:10] as hh, s[11:12] as mi, s[13:14] as ss, '' as fr, '' as half, '' as z from t where regexp_matches(s, '^(\\d{8}|\\d{12}|\\d{14})$') and rec_id not in (select rec_id from n where us is not null)".replace("\\\\", "\\")
    fixed = " ".join(f"when upper(z) = '{name}' then {60 * minutes}" for name, minutes in FIXED_ZONES.items())
    hour = "case when half = '' then hh::int when hh::int between 1 and 12 then hh::int % 12 + case half when 'pm' then 12 else 0 end end"
    off = lambda u: f"(epoch(timezone(zone, to_timestamp({u})))::bigint - ({u}))"
    return f"""with r as (select rec_id, venue_id, ts_raw as raw from tick_feed union select rec_id, venue_id, date_raw from score_log),
  t as (select rec_id, tz_name, date_order, regexp_replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '^(\\d{{4}})(\\d{{2}})(\\d{{2}})T(\\d{{2}})(\\d{{2}})(\\d{{2}})(\\D|$)', '\\1-\\2-\\3T\\4:\\5:\\6\\7') as s from r left join venues using (venue_id)),
  i as (select rec_id, try_cast(s as hugeint) as n from t where regexp_matches(s, '^\\d{{1,19}}$')), n as (select rec_id, case {unit} end as us from i),
  w as ({" union all ".join([*parts, digits])}),
  c as (select rec_id, tz_name, z, case when hh = '' then 0 else {hour} end as h, coalesce(try_cast(mi as int), 0) as mi, coalesce(try_cast(ss as int), 0) as ss, coalesce(try_cast(rpad(fr[1:6], 6, '0') as bigint), 0) as fr, day from w where day is not null),
  l as (select rec_id, epoch(day)::bigint + h * 3600 + mi * 60 + ss as wall, fr, case when regexp_matches(z, '^[+-]') then (case when z[1] = '-' then -60 else 60 end) * (z[2:3]::int * 60 + z[-2:]::int) {fixed} end as offset_s, case when z = '' then tz_name else z end as zone from c where h <= 23 and mi <= 59 and ss <= 59),
  g as (select *, {off("wall - 86400")} as before, {off("wall + 86400")} as after from l where offset_s is null and zone in (select name from pg_timezone_names()))
  select rec_id, us::bigint as utc_us from n where us is not null
  union select rec_id, (wall - offset_s) * 1000000 + fr from l where offset_s is not null
  union select rec_id, (case when {off("wall - before")} <> before and {off("wall - after")} = after then wall - after else wall - before end) * 1000000 + fr from g"""


def _p6_sql() -> str:
    """The rule as it is defined, without the tail fit: the most extreme bars settled first, by recursion over the whole table."""
    yes = lambda e: f"coalesce({e}, false)"
    low, high = ([f"{f}({', '.join(f'lead(ref, {j}) over w' for j in range(1, k + 1))})" if k > 1 else "lead(ref) over w" for k in range(1, 5)] for f in ("least", "greatest"))
    both = [f"case when lag(ref, {i}) over w is not null and {low[4 - i]} is not null then" for i in range(1, 5)]
    under = ", ".join(f"{both[i - 1]} greatest(lag(ref, {i}) over w, {low[4 - i]}) end" for i in range(1, 5))
    over = ", ".join(f"{both[i - 1]} least(lag(ref, {i}) over w, {high[4 - i]}) end" for i in range(1, 5))
    return f"""with recursive b as (select distinct bar_id, symbol, bar_start, open_px as o, high_px as h, low_px as l, close_px as c from price_bars),
  a as (select *, {yes("least(o, h, l, c) <= 0")} or {yes("h < greatest(o, h, l, c)")} or {yes("l > least(o, h, l, c)")} as wrong from b),
  x as (select *, row_number() over w as pos, case when c > 0 then ln(c) end as lc, case when least(o, h, l, c) > 0 then ln(greatest(o, h, l, c)) end as hi, case when least(o, h, l, c) > 0 then ln(least(o, h, l, c)) end as lo,
    {yes("c = lag(c) over w")} as rep from a where symbol is not null and bar_start is not null window w as (partition by symbol order by bar_start, bar_id)),
  y as (select *, abs(lc - lag(lc) over w) as move, row_number() over w - row_number() over (partition by symbol, rep order by pos) as island from x window w as (partition by symbol order by pos)),
  u as (select symbol, 20 * median(move) filter (move > 0) as far, avg(rep::int) as repeats from y group by 1),
  r as (select 0 as i, bar_id, symbol, pos, hi, lo, case when not wrong then lc end as ref, far, false as found, true as more from y join u using (symbol)
    union all
    select i + 1, bar_id, symbol, pos, hi, lo, case when not hit then ref end, far, found or hit, max(hit::int) over () = 1 from (
      select *, gain is not null and gain > coalesce(max(gain) over (partition by symbol order by pos rows between 4 preceding and 1 preceding), 0) and gain >= coalesce(max(gain) over (partition by symbol order by pos rows between 1 following and 4 following), 0) as hit from (
        select *, case when not found and size > far then size end as gain from (
          select *, greatest(hi - least({under}), greatest({over}) - lo) as size from r where more window w as (partition by symbol order by pos))))),
  s as (select *, rep and repeats < 0.1 and count(*) over (partition by symbol, rep, island) >= 6 as stuck from y join u using (symbol))
  select bar_id from s where wrong or stuck union select bar_id from a where wrong union select bar_id from r where found"""


SQL = {"p5_found": _p5_sql(), "p5_learned": _p5_sql(), "p6_found": _p6_sql()}
