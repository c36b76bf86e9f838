"""Named queries over metric samples and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import metrics as M
from opsloom.plans import bindings as B

c = F.col
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 200.0]


def counter_values(spark, d):
    return B.counters(spark, d).select("event_type", "event_id", "counter")


def counter_totals(spark, d):
    """Labelled counters: rows and value sums by type and user group."""
    return B.events(spark, d).groupBy("event_type", (c("user_id") % 10).alias("grp")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def counter_rate(spark, d):
    return M.rate(B.counters(spark, d), ["event_type"], ["ts", "event_id"], "counter", 300).select(
        "event_type", "event_id", "increase", F.round("rate", 6).alias("rate"))


RATE_SQL = f"""with {B.DELTAS} select event_type, event_id, cast(sum(delta) over w as bigint) as increase,
  round(sum(delta) over w / 300.0, 6) as rate from v_delta window w as (partition by event_type order by ts
  range between interval 300 seconds preceding and current row)"""


def hourly_increase(spark, d):
    """Largest one-hour increase per type, summed over types by status."""
    inc = M.rate(B.counters(spark, d), ["event_type"], ["ts", "event_id"], "counter", 3600)
    top = inc.groupBy("event_type").agg(F.max("increase").alias("top"), F.sum("resets").alias("reset_samples"))
    status = F.when(c("event_type") == "error", "error").otherwise("ok")
    return top.groupBy(status.alias("status")).agg(F.sum("top").alias("increase"), F.sum("reset_samples").alias("reset_samples"))


HOURLY_SQL = f"""with {B.DELTAS}, r as (select event_type, sum(delta) over w as i, sum(reset) over w as r from v_delta
  window w as (partition by event_type order by ts range between interval 1 hour preceding and current row)),
t as (select event_type, max(i) as top, sum(r) as rs from r group by 1)
select case when event_type = 'error' then 'error' else 'ok' end as status, cast(sum(top) as bigint) as increase,
  cast(sum(rs) as bigint) as reset_samples from t group by 1"""


def counter_resets(spark, d):
    out = M.rate(B.counters(spark, d), ["event_type"], ["ts", "event_id"], "counter", 3600)
    return out.filter("resets > 0").select("event_type", "event_id", "resets")


def value_histogram(spark, d):
    hist = M.histogram(B.events(spark, d), ["event_type"], "value", BOUNDS)
    return M.bucket_rows(hist, ["event_type"]).filter("le < double('infinity')")


def histogram_quantiles(spark, d):
    hist = M.histogram(B.events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["event_type", "day"], "value", BOUNDS)
    return hist.select("event_type", "day", F.round(M.quantile(c("bounds"), c("buckets"), 0.95), 6).alias("q95"),
                       F.round(M.quantile(c("bounds"), c("buckets"), 0.5), 6).alias("q50"))


def _quantile_sql():
    counts = ", ".join(f"sum((value <= {b})::int)" for b in BOUNDS)
    def q(p):
        return f"""(select case when {p} * total > n[7] then 200.0 else (select lo + (hi - lo) * ({p} * total - below) / (cnt - below)
          from (select unnest(bs) as hi, unnest(n) as cnt, unnest(list_concat([0.0], bs[1:6])) as lo,
          unnest(list_concat([0], n[1:6])) as below) b where cnt >= {p} * total order by hi limit 1) end)"""
    return f"""with h as (select event_type, strftime(ts, '%Y-%m-%d') as day, [{counts}] as n, count(*) as total,
      {BOUNDS} as bs from events group by 1, 2) select event_type, day, round({q(0.95)}, 6) as q95, round({q(0.5)}, 6) as q50 from h"""


def gauges(spark, d):
    return M.last_value(B.events(spark, d), ["event_type", "user_id"], "value", ["ts", "event_id"])


def label_sums(spark, d):
    """Sums by label with label filters (not equal, pattern) and a unit change."""
    e = B.events(spark, d).filter((c("event_type") != "view") & c("event_type").rlike("^(click|error|sign.*)$"))
    return e.groupBy("event_type").agg(F.round(F.sum(c("value") / 1024), 6).alias("kilo"), F.count("*").alias("n"))


def _blocks(spark, d):
    e = B.events(spark, d)
    end = F.timestamp_micros(F.unix_micros("ts") + F.round(c("value") * 1_000_000).cast("bigint"))
    return e.select("event_id", "event_type", c("ts").alias("start"), end.alias("end"),
                    F.when(c("event_type") == "error", "error").otherwise("success").alias("status"))


_BLOCKS = """v_block as (select event_id, event_type, ts as start, ts + to_microseconds(cast(round(value * 1000000) as bigint))
  as fin, case when event_type = 'error' then 'error' else 'success' end as status from events)"""


def timed_blocks(spark, d):
    out = M.block_summary(_blocks(spark, d), ["event_type"])
    return out.select("event_type", "calls", "errors", F.round("seconds", 3).alias("seconds"), F.round("longest", 4).alias("longest"))


def blocks_in_progress(spark, d):
    out = M.in_progress(_blocks(spark, d), ["event_type"], "event_id")
    return out.groupBy("event_type").agg(F.max("open_blocks").alias("most_open"), F.min("open_blocks").alias("least_open"),
                                         F.sum("open_blocks").alias("sum_open"))


def up_per_job(spark, d):
    up = B.events(spark, d).select("user_id", "ts", "event_id", F.when(c("event_type") == "error", 0).otherwise(1).alias("up"))
    return M.last_value(up, ["user_id"], "up", ["ts", "event_id"])


_RULES = [("click", "click high", ">", 150.0, "warning", True), ("error", "error high", ">=", 100.0, "critical", True),
          ("view", "view low", "<", 1.0, "info", True), ("signup", "off", ">", 0.0, "info", False)]


def _firing(spark, d):
    rules = spark.createDataFrame(_RULES, "metric string, rule string, condition string, threshold double, severity string, enabled boolean")
    samples = B.events(spark, d).select(c("event_type").alias("metric"), "ts", "event_id", "value")
    return M.firing(samples, rules)


_FIRE = ("r(metric, rule, condition, threshold, severity, enabled) as (values " + ", ".join(
    f"('{a}', '{b}', '{o}', {t}::double, '{s}', {str(e).lower()})" for a, b, o, t, s, e in _RULES) + """),
fire as (select e.event_type as metric, ts, event_id, value, rule, severity, case condition when '>' then value > threshold
  when '>=' then value >= threshold when '<' then value < threshold else false end as firing
  from events e join r on e.event_type = r.metric where enabled)""")


def alert_spans(spark, d):
    spans = M.alert_spans(_firing(spark, d), ["metric", "rule", "severity"], ["ts", "event_id"])
    fmt = "yyyy-MM-dd HH:mm:ss.SSS"
    return spans.select("metric", "rule", "severity", F.date_format("triggered_at", fmt).alias("triggered_at"),
                        F.date_format("last_at", fmt).alias("last_at"), "samples")


SPAN_SQL = f"""with {_FIRE}, p as (select *, lag(firing, 1, false) over (partition by metric, rule order by ts, event_id) as b
  from fire), s as (select *, sum((firing and not b)::int) over (partition by metric, rule order by ts, event_id
  rows unbounded preceding) as span from p)
select metric, rule, severity, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') as triggered_at,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') as last_at, count(*) as samples from s where firing
group by metric, rule, severity, span"""


def held_alerts(spark, d):
    """Error ratio per hour over 5 percent, without a break for two hours at least."""
    e = B.events(spark, d)
    hour = F.date_trunc("hour", "ts")
    ratio = e.groupBy(hour.alias("ts")).agg(F.avg(F.when(c("event_type") == "error", 1.0).otherwise(0.0)).alias("ratio"))
    states = ratio.withColumns({"rule": F.lit("error ratio"), "firing": c("ratio") > 0.05})
    return M.held(states, ["rule"], 7200).select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"),
                                                F.round("ratio", 6).alias("ratio"), "alert")


HELD_SQL = """with m as (select date_trunc('hour', ts) as h, avg((event_type = 'error')::int::double) as ratio from events group by 1),
q as (select *, coalesce(max(case when ratio <= 0.05 then h end) over (order by h), timestamp '1900-01-01') as quiet from m),
s as (select *, min(h) over (partition by quiet, ratio > 0.05) as since from q)
select strftime(h, '%Y-%m-%d %H') as hour, round(ratio, 6) as ratio, ratio > 0.05 and h - since >= interval 2 hours as alert from s"""


def sliding_monitors(spark, d):
    """Six-hour windows every two hours against the overall mean."""
    e = B.events(spark, d)
    base = e.agg(F.avg("value")).scalar()
    out = M.sliding_monitor(e, "6 hours", "2 hours", failed=c("event_type") == "error")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("error_ratio", 6).alias("error_ratio"),
                      F.round("p95", 6).alias("p95"), F.round(c("mean") / base, 6).alias("resource_ratio"),
                      (c("mean") / base > 1.5).alias("resource_alert"))


SLIDING_SQL = """with w as (select time_bucket(interval 2 hours, ts) - k * interval 2 hours as start, value, event_type
  from events, (values (0), (1), (2)) t(k))
select strftime(start, '%Y-%m-%d %H:%M') as start, count(*) as n, round(avg((event_type = 'error')::int::double), 6) as error_ratio,
  round(quantile_cont(value, 0.95), 6) as p95, round(avg(value) / (select avg(value) from events), 6) as resource_ratio,
  avg(value) / (select avg(value) from events) > 1.5 as resource_alert from w group by 1"""


def volume_anomalies(spark, d):
    daily = B.events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("volume"))
    return M.volume_anomalies(daily).select("day", "volume", F.round("baseline", 6).alias("baseline"), "severity",
                                            F.round("deviation", 6).alias("deviation"))


VOLUME_SQL = """with d as (select strftime(ts, '%Y-%m-%d') as day, count(*) as volume from events group by 1),
b as (select *, avg(volume) over w as baseline, coalesce(stddev_samp(volume) over w, 0) as s, count(*) over w as n from d
  window w as (order by day rows between 6 preceding and 1 preceding))
select day, volume, round(baseline, 6) as baseline, case when abs(volume - baseline) > 3 * s then 'high' when
  abs(volume - baseline) > 2 * s then 'medium' else 'normal' end as severity,
  round(case when s > 0 then abs(volume - baseline) / s end, 6) as deviation from b where n >= 2"""


def value_drift(spark, d):
    e = B.events(spark, d)
    day = F.lit("2024-01-16").cast("timestamp")
    out = M.ks_statistic(e.filter(c("ts") < day), e.filter(c("ts") >= day), "value", 1.0)
    return out.select("n", "m", F.round("statistic", 9).alias("statistic"), F.round("p_value", 6).alias("p_value"), "drift")


DRIFT_SQL = """with v as (select value, sum((ts < timestamp '2024-01-16')::int) as r, sum((ts >= timestamp '2024-01-16')::int) as c
  from events group by 1), t as (select sum(r) as n, sum(c) as m from v),
g as (select abs(sum(r) over (order by value) / (select n from t) - sum(c) over (order by value) / (select m from t)) as gap from v),
s as (select cast(n as bigint) as n, cast(m as bigint) as m, (select max(gap) from g) as d from t),
l as (select *, sqrt(n * m / (n + m)) * d as lam from s),
p as (select *, least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda k:
  (case when k % 2 = 1 then 2.0 else -2.0 end) * exp(-2.0 * k * k * lam * lam))))) as p from l)
select n, m, round(d, 9) as statistic, round(p, 6) as p_value, p < 0.05 as drift from p"""


QUERIES = {
    "counter_values": (counter_values, f"with {B.COUNTERS} select event_type, event_id, counter from v_counter"),
    "counter_totals": (counter_totals, """select event_type, user_id % 10 as grp, count(*) as n, round(sum(value), 4) as total
      from events group by 1, 2"""),
    "counter_rate": (counter_rate, RATE_SQL),
    "hourly_increase": (hourly_increase, HOURLY_SQL),
    "counter_resets": (counter_resets, f"""with {B.DELTAS}, r as (select event_type, event_id, sum(reset) over (partition by
      event_type order by ts range between interval 1 hour preceding and current row) as resets from v_delta)
      select event_type, event_id, cast(resets as bigint) as resets from r where resets > 0"""),
    "value_histogram": (value_histogram, " union all ".join(
        f"select event_type, {b}::double as le, cast(sum((value <= {b})::int) as bigint) as n from events group by 1" for b in BOUNDS)),
    "histogram_quantiles": (histogram_quantiles, _quantile_sql()),
    "gauge_values": (gauges, "select event_type, user_id, last(value order by ts, event_id) as value from events group by 1, 2"),
    "label_sums": (label_sums, """select event_type, round(sum(value / 1024), 6) as kilo, count(*) as n from events
      where event_type <> 'view' and regexp_matches(event_type, '^(click|error|sign.*)$') group by 1"""),
    "timed_blocks": (timed_blocks, f"""with {_BLOCKS} select event_type, count(*) as calls, cast(sum((status = 'error')::int)
      as bigint) as errors, round(sum(epoch_us(fin) - epoch_us(start)) / 1e6, 3) as seconds,
      round(max(epoch_us(fin) - epoch_us(start)) / 1e6, 4) as longest from v_block group by 1"""),
    "blocks_in_progress": (blocks_in_progress, f"""with {_BLOCKS}, m as (select event_type, event_id, start as t, 1 as s from v_block
      union all select event_type, event_id, fin, -1 from v_block), o as (select event_type, sum(s) over (partition by event_type
      order by t, s, event_id rows unbounded preceding) as o from m)
      select event_type, cast(max(o) as bigint) as most_open, cast(min(o) as bigint) as least_open,
      cast(sum(o) as bigint) as sum_open from o group by 1"""),
    "up_per_job": (up_per_job, """select user_id, last((event_type <> 'error')::int order by ts, event_id) as up
      from events group by 1"""),
    "alert_spans": (alert_spans, SPAN_SQL),
    "held_alerts": (held_alerts, HELD_SQL),
    "sliding_monitors": (sliding_monitors, SLIDING_SQL),
    "volume_anomalies": (volume_anomalies, VOLUME_SQL),
    "value_drift": (value_drift, DRIFT_SQL),
}
