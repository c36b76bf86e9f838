"""Metrics over a table of samples: counters, histograms, gauges, rates, quantiles, alerts.

``rate`` and ``increase`` add the reset-aware differences of the samples in the
window (both ends included) and do not extrapolate to the window edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom import rules as R
from opsloom.operators import series as T
from opsloom.operators.quantiles import exact_quantile

HOUR = 3600


def counter_series(events: DataFrame, labels: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """Running count per label set."""
    return T.running_sum(events, labels, T.time_bucket(ts, HOUR), [F.col(o) for o in order], F.lit(1), "counter")


def deltas(samples: DataFrame, keys: list[str], order: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Adds ``delta`` and ``reset``: a value under the one before means the counter started again at zero."""
    out = T.previous(samples, keys, T.time_bucket(ts, HOUR), order, value, "_prev")
    v, p = F.col(value), F.col("_prev")
    return out.withColumns({
        "delta": F.when(p.isNull(), 0).when(v < p, v).otherwise(v - p),
        "reset": F.when(v < p, 1).otherwise(0)}).drop("_prev")


def rate(samples: DataFrame, keys: list[str], order: list[str], value: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Adds ``increase``, ``rate`` per second and ``resets`` over the last ``seconds``."""
    out = T.sums_over_last(deltas(samples, keys, order, value, ts), keys, ts, seconds,
                           increase=F.col("delta"), resets=F.col("reset"))
    return out.withColumn("rate", F.col("increase") / float(seconds))


def histogram(observations: DataFrame, keys: list[str], value: str, bounds: list[float] | None = None) -> DataFrame:
    """Per label set: bounds, cumulative bucket counts, sum and count, in one aggregation."""
    bounds = bounds or R.HISTOGRAM_BOUNDS
    counts = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)) for b in bounds] + [F.count(value)]
    return observations.groupBy(*keys).agg(
        F.array(*counts).alias("buckets"), F.sum(value).alias("sum"), F.count(value).alias("count")
    ).withColumn("bounds", F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf"))))


def bucket_rows(hist: DataFrame, keys: list[str]) -> DataFrame:
    zipped = F.arrays_zip(F.col("bounds").alias("le"), F.col("buckets").alias("n"))
    return hist.select(*keys, F.inline(zipped))


def quantile(bounds: Column, buckets: Column, q: float) -> Column:
    """Linear inside the first bucket that reaches the rank; the last finite bound beyond it."""
    total = F.element_at(buckets, -1)
    want = total * q
    at = F.array_position(F.transform(buckets, lambda n: n >= want), F.lit(True)).cast("int")
    finite = F.size(bounds) - 1
    low = F.when(at > 1, F.try_element_at(bounds, at - 1)).otherwise(0.0)
    below = F.when(at > 1, F.try_element_at(buckets, at - 1)).otherwise(0)
    inside = F.try_element_at(buckets, at) - below
    value = low + (F.try_element_at(bounds, at) - low) * (want - below) / inside
    return F.when(total == 0, F.lit(None)).when(at > finite, F.element_at(bounds, -2)).otherwise(
        F.when(inside == 0, low).otherwise(value))


def last_value(samples: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Gauges: the last value wins."""
    return samples.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def in_progress(blocks: DataFrame, keys: list[str], block_id: str, start: str = "start", end: str = "end") -> DataFrame:
    """Number of open blocks after each start and end."""
    marks = blocks.select(*keys, block_id, F.inline(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))))
    return T.running_sum(marks, keys, T.time_bucket("at", HOUR), [F.col("at"), F.col("step"), F.col(block_id)],
                         F.col("step"), "open_blocks")


def block_summary(blocks: DataFrame, keys: list[str], start: str = "start", end: str = "end", status: str = "status") -> DataFrame:
    took = F.col(end).cast("double") - F.col(start).cast("double")
    return blocks.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum(F.when(F.col(status) == "error", 1).otherwise(0)).alias("errors"),
        F.sum(took).alias("seconds"), F.max(took).alias("longest"))


# ------------------------------------------------------------------ alerts
def firing(values: DataFrame, rules: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Samples against enabled rules (metric, rule, condition, threshold, severity, enabled)."""
    v, t, op = F.col(value), F.col("threshold"), F.col("condition")
    test = (F.when(op == ">", v > t).when(op == ">=", v >= t).when(op == "<", v < t).when(op == "<=", v <= t)
            .when(op == "==", v == t).otherwise(F.lit(False)))
    return values.join(rules.filter("enabled"), metric).withColumn("firing", test)


def _firing_spans(states: DataFrame, keys: list[str], order: list[str], ts: str) -> DataFrame:
    """Adds ``span``, the number of the unbroken stretch of firing."""
    flagged = T.previous(states, keys, T.time_bucket(ts, HOUR), order, "firing", "_before")
    opens = F.when(F.col("firing") & ~F.coalesce("_before", F.lit(False)), 1).otherwise(0)
    return T.running_sum(flagged, keys, T.time_bucket(ts, HOUR), [F.col(o) for o in order], opens, "span").drop("_before")


def alert_spans(states: DataFrame, keys: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """Spans of unbroken firing: trigger time, last time, number of samples."""
    spans = _firing_spans(states, keys, order, ts)
    return spans.filter("firing").groupBy(*keys, "span").agg(
        F.min(ts).alias("triggered_at"), F.max(ts).alias("last_at"), F.count("*").alias("samples"))


def held(states: DataFrame, keys: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """Adds ``alert``: the rule fires, and has done so without a break for ``seconds`` at least.

    A single firing sample is no alert. The streaming form follows the same rule.
    """
    spans = _firing_spans(states, keys, [ts], ts)
    since = spans.filter("firing").groupBy(*keys, "span").agg(F.min(ts).alias("_since"))
    long = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_since").cast("timestamp")) >= seconds * 1_000_000
    return spans.join(since, [*keys, "span"], "left").withColumn("alert", F.col("firing") & F.coalesce(long, F.lit(False))).drop("span", "_since")


def sliding_monitor(samples: DataFrame, size: str, slide: str, value: str = "value", failed: Column | None = None,
                    ts: str = "ts", quantile: float | None = 0.95) -> DataFrame:
    """Per sliding window: rows, error ratio, mean and exact 95th percentile (``p95``; left out where ``quantile`` is None).

    ``size`` is a multiple of ``slide``. Values are counted per pane of
    ``slide`` first, so that a sample is read once and not once per window;
    the percentile's rank is found by counts, and no window is gathered.
    """
    bad = F.sum(F.when(failed if failed is not None else F.lit(False), 1).otherwise(0))
    panes = samples.groupBy(F.window(F.col(ts), slide).alias("p"), F.col(value).alias("v")).agg(F.count("*").alias("n"), bad.alias("bad"))
    start = F.window(F.col("p.start"), size, slide)
    sums = panes.groupBy(F.col("p.start").alias("at")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("v") * F.col("n")).alias("sum"))
    out = sums.groupBy(F.window("at", size, slide).alias("w")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("sum").alias("sum")).select(
        F.col("w.start").alias("start"), "n", (F.col("bad") / F.col("n")).alias("error_ratio"), (F.col("sum") / F.col("n")).alias("mean"))
    if quantile is None:
        return out
    counted = panes.groupBy(start.alias("w"), "v").agg(F.sum("n").alias("n")).select(F.col("w.start").alias("start"), "v", "n")
    return out.join(exact_quantile(counted, ["start"], quantile), "start", "left").withColumnRenamed("quantile", "p95")


def volume_anomalies(daily: DataFrame, day: str = "day", volume: str = "volume") -> DataFrame:
    """Each day against mean and sample deviation of the six before; 2 and 3 sigma. One row per day comes in."""
    from pyspark.sql import Window

    w = Window.orderBy(day).rowsBetween(-6, -1)
    out = daily.withColumns({"baseline": F.avg(volume).over(w), "sigma": F.coalesce(F.stddev_samp(volume).over(w), F.lit(0.0)),
                             "days": F.count("*").over(w)}).filter("days >= 2")
    off = F.abs(F.col(volume) - F.col("baseline"))
    level = F.when(off > 3 * F.col("sigma"), "high").when(off > 2 * F.col("sigma"), "medium").otherwise("normal")
    return out.withColumn("severity", level).withColumn(
        "deviation", F.when(F.col("sigma") > 0, off / F.col("sigma")))


def ks_statistic(reference: DataFrame, current: DataFrame, value: str, width: float) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: largest gap of the two running shares, with the asymptotic p-value.

    Rows are counted per distinct value and summed up in buckets of ``width``.
    """
    both = reference.select(F.col(value).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(
        current.select(F.col(value).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    per_value = both.groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).withColumn("g", F.lit(0))
    bucket = F.floor(F.col("v") / width)
    run = T.running_sum(per_value, ["g"], bucket, [F.col("v")], F.col("r"), "nr")
    run = T.running_sum(run, ["g"], bucket, [F.col("v")], F.col("c"), "nc")
    size = per_value.agg(F.sum("r").alias("n"), F.sum("c").alias("m"))
    n, m = size.select("n").scalar(), size.select("m").scalar()
    top = run.agg(F.max(F.abs(F.col("nr") / n - F.col("nc") / m)).alias("statistic"), F.max("nr").alias("n"),
                  F.max("nc").alias("m"))
    scale = F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    lam = scale * F.col("statistic")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0)
                        * F.exp(k * k * lam * lam * -2.0))
    series = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    p = F.when(F.col("statistic") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return top.withColumn("p_value", p).withColumn("drift", F.col("p_value") < 0.05)
