"""Ordered work per group that never puts a whole group into one task.

A group (a series, a session) is cut into buckets of its order column. Work
inside a bucket is a window over (group, bucket); what crosses buckets is
carried by a small table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def time_bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))


def _within(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys, "_bucket").orderBy(*order)


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` from the start of the group to the row; a running count for ``value = 1``."""
    cut = df.withColumn("_bucket", bucket).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
               .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total"))
    local = F.sum("_value").over(_within(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return (cut.withColumn("_local", local).join(offsets, [*keys, "_bucket"])
            .withColumn(out, F.col("_local") + F.col("_offset")).drop("_bucket", "_value", "_local", "_offset"))


def previous(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Value of the row before in the group, also across empty buckets; null for the first row."""
    cut = df.withColumn("_bucket", bucket)
    last = cut.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    inside = F.lag(value).over(_within(keys, [F.col(o) for o in order]))
    first = F.row_number().over(_within(keys, [F.col(o) for o in order])) == 1
    return (cut.withColumn("_in", inside).withColumn("_first", first).join(carried, [*keys, "_bucket"])
            .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in")))
            .drop("_bucket", "_in", "_first", "_carry"))


def over_last(df: DataFrame, keys: list[str], ts: str, seconds: int, **aggs: Column) -> DataFrame:
    """Aggregates over the rows of the last ``seconds`` up to each row, both ends included.

    Buckets are as long as the window, so a row needs its own bucket and the
    one before: every row goes to its bucket and, as context, to the next.
    """
    own = time_bucket(ts, seconds)
    twice = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(
        "_b", F.explode(F.array(F.struct(own.alias("_bucket"), F.lit(True).alias("_own")),
                                F.struct((own + 1).alias("_bucket"), F.lit(False).alias("_own"))))).select("*", "_b.*")
    frame = Window.partitionBy(*keys, "_bucket").orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return twice.withColumns({k: v.over(frame) for k, v in aggs.items()}).filter("_own").drop("_t", "_b", "_bucket", "_own")


def _passing(df: DataFrame, keys: list[str], ts: str, seconds: int, marks: list[tuple]) -> tuple[DataFrame, WindowSpec]:
    """Every row in its own bucket and, as ``marks`` (kind, time) say, in the next; and the frame up to a row's time."""
    own, t = time_bucket(ts, seconds), F.unix_micros(F.col(ts).cast("timestamp"))
    rows = [F.struct(own.alias("_bucket"), t.alias("_t"), F.lit("own").alias("_kind"))]
    rows += [F.struct((own + 1).alias("_bucket"), at(own, t, seconds * 1_000_000).alias("_t"), F.lit(kind).alias("_kind")) for kind, at in marks]
    spread = df.withColumn("_m", F.explode(F.array(*rows))).select("*", "_m.*").drop("_m")
    return spread, Window.partitionBy(*keys, "_bucket").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)


def sums_over_last(df: DataFrame, keys: list[str], ts: str, seconds: int, **values: Column) -> DataFrame:
    """Sums of whole numbers as by ``over_last``; null counts as zero.

    A row of the bucket before is added once and taken off once it is too old,
    so the cost does not depend on the number of rows in a window.
    """
    rows, frame = _passing(df, keys, ts, seconds, [("in", lambda own, t, span: t), ("out", lambda own, t, span: t + span + 1)])
    sign = F.when(F.col("_kind") == "out", -1).otherwise(1)
    return rows.withColumns({k: F.sum(F.coalesce(v, F.lit(0)) * sign).over(frame) for k, v in values.items()}).filter("_kind = 'own'").drop("_bucket", "_t", "_kind")


def max_over_last(df: DataFrame, keys: list[str], ts: str, seconds: int, value: str, out: str) -> DataFrame:
    """Largest value as by ``over_last``, at a cost that does not depend on the number of rows in a window.

    It is the larger of the own bucket's largest so far and of the largest that
    the bucket before still has in the window; the latter changes only when a row leaves.
    """
    cut = df.withColumn("_own", time_bucket(ts, seconds)).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    bucket = Window.partitionBy(*keys, "_own")
    later = bucket.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    told = cut.withColumns({"_all": F.max(value).over(bucket), "_later": F.max(value).over(later)})
    rows, frame = _passing(told, keys, ts, seconds, [("all", lambda own, t, span: (own + 1) * span - 1), ("later", lambda own, t, span: t + span + 1)])
    kind = F.col("_kind")
    left = F.last(F.when(kind == "all", F.struct(F.col("_all").alias("v"))).when(kind == "later", F.struct(F.col("_later").alias("v"))), True).over(frame)
    mine = F.max(F.when(kind == "own", F.col(value))).over(frame)
    return (rows.withColumns({"_left": left, "_mine": mine}).filter("_kind = 'own'").withColumn(out, F.greatest("_mine", "_left.v"))
            .drop("_bucket", "_t", "_kind", "_own", "_at", "_all", "_later", "_left", "_mine"))
