"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import random
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.llm.common import WORD, stored, table

#: Units of one flight group; the next level has two of each group left at most.
GROUP = 512


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = 3, cycle: int = 3) -> DataFrame:
    """source, source_size -> target.

    Sources in code-point order, null last, weigh 1, 2, .. ``cycle``, 1, ..
    and share the sum of all sizes. A target stops at ``cap`` times the
    source's size; the excess goes to the others by weight until none is
    above. That is the level L with sum(min(cap_s, L * w_s)) = total: sources
    are sorted by cap over weight, all up to a place are at their cap, and the
    rest share what is left. One row per source, whatever the corpus.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = (sizes.withColumn("weight", ((F.row_number().over(order) - 1) % cycle + 1).cast("double"))
              .withColumn("cap", (F.col("source_size") * cap).cast("double")))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    held = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first source that stays under its cap fixes the level of all after it
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level")).alias("x"))).over(
        W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return held.withColumn("at", first["level"]).select(
        "source", "source_size",
        F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def _flight(sizes: list[float], chances: list[float], rng: random.Random, land: bool) -> list[float]:
    """Moves the chances along the null space of (1, size) until two at most are fractional.

    Every move keeps the sum of the chances and the sum of chance times size,
    makes one chance 0 or 1, and has mean zero. With ``land`` the last ones
    are rounded so that the size total is as near as it can be.
    """
    x, eps = list(chances), 1e-9
    live: list[int] = []
    for i in range(len(x)):
        if eps < x[i] < 1 - eps:
            live.append(i)
        else:
            x[i] = float(round(x[i]))
        if len(live) == 3:
            a, b, c = live
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])  # orthogonal to ones and to sizes
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min(((1 - x[k]) / v if v > 0 else -x[k] / v) for k, v in zip(live, u) if v)
            down = min((x[k] / v if v > 0 else (x[k] - 1) / v) for k, v in zip(live, u) if v)
            step = up if rng.random() * (up + down) < down else -down
            for k, v in zip(live, u):
                x[k] = min(1.0, max(0.0, x[k] + step * v))
                if not eps < x[k] < 1 - eps:
                    x[k] = float(round(x[k]))
            live = [k for k in live if 0 < x[k] < 1]
    if land and live:
        want = sum(x[k] * sizes[k] for k in live)
        best = min(range(1 << len(live)),
                   key=lambda m: (abs(want - sum(sizes[k] for j, k in enumerate(live) if m >> j & 1)), m))
        for j, k in enumerate(live):
            x[k] = float(best >> j & 1)
    return x


def _fly(seed: int, level: int):
    def run(keys: tuple, units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["u", "doc_id", "size"], kind="stable")
        rng = random.Random(f"{seed}/{level}/{keys}")
        units["chance"] = _flight(units["size"].tolist(), units["chance"].tolist(), rng, bool(units["groups"].iloc[0] == 1))
        return units
    return run


def mix(docs: DataFrame, seed: int = 7, cap: int = 3, cycle: int = 3) -> DataFrame:
    """doc_id, source, digest, size, source_size, target, taken for every document.

    A source's ratio r = target / size gives each of its documents floor(r)
    copies, and one more with probability r - floor(r). The extra copies are
    drawn by the cube method on two constraints, words and documents, inside
    one source: flights run in groups of GROUP documents, the one or two
    documents that each group leaves open fly again on the next level, and
    the last level lands on the rounding nearest to the word target. A group
    never grows with its source, so a hot source is many groups.

    Null text: size 0. Null sources are one source, the last one. Rows that
    are equal in id, source and text are one unit and share its fate. Empty
    table: no rows. The draw depends on ``seed`` and the ids only.
    """
    small = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    units = stored(small.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("rows")), "mix-units")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    sums = stored(sums, "mix-sums")
    goal = stored(targets(sums.drop("n"), cap, cycle).withColumnRenamed("source", "s")
                  .join(sums.select(F.col("source").alias("s2"), "n"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = (units.join(goal, units["source"].eqNullSafe(goal["s"])).drop("s")
             .withColumn("ratio", ratio).withColumn("copies", F.floor("ratio"))
             .withColumn("chance", F.col("ratio") - F.col("copies")).withColumn("load", (F.col("size") * F.col("rows")).cast("double"))
             .withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "digest")))
    flying = state.select("doc_id", "source", "digest", F.col("load").alias("size"), "chance", "u",
                          F.ceil(F.col("n") / GROUP).alias("groups"))
    most, level, done = -(-(sums.agg(F.max("n")).first()[0] or 1) // GROUP), 0, None
    while True:
        keyed = flying.withColumn("g", F.pmod(F.xxhash64(F.lit(level), "u"), F.col("groups")))
        flown = stored(keyed.groupBy("source", "g").applyInPandas(_fly(seed, level), keyed.schema).drop("g"), "mix-flight")
        settled = F.col("chance").isin(0.0, 1.0)
        done = flown.where(settled) if done is None else done.unionByName(flown.where(settled))
        if most == 1:
            break
        flying = flown.where(~settled).withColumn("groups", F.ceil(2 * F.col("groups") / GROUP))
        most, level = -(-2 * most // GROUP), level + 1
    extra = done.select("doc_id", "source", "digest", F.col("chance").cast("long").alias("extra"))
    same = [state["doc_id"].eqNullSafe(extra["doc_id"]), state["source"].eqNullSafe(extra["source"]), state["digest"] == extra["digest"]]
    return state.join(extra, same).select(
        state["doc_id"], state["source"], state["digest"], "rows", "size", "source_size", "target",
        (F.col("size") * (F.col("copies") + F.col("extra"))).alias("taken"), (F.col("copies") + F.col("extra")).alias("times"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with their own columns.

    Documents without words are taken as often as the draw says; their size counts nothing.
    """
    plan = mix(docs, seed).select("doc_id", "source", "digest", F.col("times").cast("int").alias("times"))
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.xxhash64("text").alias("digest"))
    same = [keyed["doc_id"].eqNullSafe(plan["doc_id"]), keyed["source"].eqNullSafe(plan["source"]), keyed["digest"] == plan["digest"]]
    taken = keyed.join(plan.where("times > 0"), same).select("row", "times")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return (m.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
            .select("doc_id", "size", "source_size", "target", "taken"))
