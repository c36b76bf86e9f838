"""Exact quantiles of groups of any size: the rank is found by narrowing a range of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsloom.operators.search import BROADCAST_ROWS, has_at_most
from opsloom.session import cut_lineage

#: Cells that a range of values is cut into, and values of one group that one task puts in order at last.
CELLS, IN_ORDER = 1024, 50_000


def exact_quantile(counted: DataFrame, keys: list[str], q: float, cells: int = CELLS, in_order: int = IN_ORDER) -> DataFrame:
    """keys and ``quantile``: the q-quantile with linear interpolation of each group of (keys, v, n).

    ``counted`` has a row per group and different value v with its number n.
    Both ranks around the quantile start from the group's whole range. As long
    as a range holds more than ``in_order`` different values it is cut into
    cells, their counts are added up, and the cell that holds the rank is the
    next range: tasks count the values that they have, and only counts meet.
    The rounds grow with the logarithm of the values; no group is gathered.
    Null and NaN values take no part; a group of none has no row.
    """
    rows = cut_lineage(counted.where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))).select(*keys, F.col("v").cast("double").alias("v"), "n"))
    sums = rows.groupBy(*keys).agg(F.sum("n").alias("_all"), F.min("v").alias("_low"), F.max("v").alias("_high"), F.count("*").alias("_values"))
    at = F.lit(q) * (F.col("_all") - 1)
    ranks = F.array(F.struct(F.lit(0).alias("_end"), F.floor(at).alias("_rank")), F.struct(F.lit(1).alias("_end"), F.ceil(at).alias("_rank")))
    state = cut_lineage(sums.select(*keys, (at - F.floor(at)).alias("_part"), "_low", "_high", "_values", F.explode(ranks).alias("_r"))
                        .select(*keys, "_part", "_low", "_high", "_values", "_r.*"))

    def inside(state: DataFrame) -> DataFrame:
        rest = [c for c in state.columns if c not in keys]
        side = state.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *rest)
        side = F.broadcast(side) if has_at_most(side, BROADCAST_ROWS) else side
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        return rows.join(side, same).where((F.col("v") >= F.col("_low")) & (F.col("v") <= F.col("_high"))).select(*keys, "v", "n", *rest)

    while (state.agg(F.max("_values")).first()[0] or 0) > in_order:
        share = (F.col("v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        cell = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(share * cells), F.lit(cells - 1))).otherwise(0)
        group = [*keys, "_part", "_end", "_rank"]
        sums = inside(state).groupBy(*group, cell.alias("_cell")).agg(F.sum("n").alias("_n"), F.min("v").alias("_low"), F.max("v").alias("_high"), F.count("*").alias("_values"))
        upto = sums.withColumn("_upto", F.sum("_n").over(W.partitionBy(*group).orderBy("_cell")))
        state = cut_lineage(upto.where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
                            .select(*keys, "_part", "_low", "_high", "_values", "_end", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank")))
    order = W.partitionBy(*keys, "_end").orderBy("v")
    found = inside(state).withColumn("_upto", F.sum("n").over(order)).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("n") <= F.col("_rank")))
    low, high = F.max(F.when(F.col("_end") == 0, F.col("v"))), F.max(F.when(F.col("_end") == 1, F.col("v")))
    ends = found.groupBy(*keys).agg(low.alias("_a"), high.alias("_b"), F.max("_part").alias("_part"))
    return ends.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("quantile"))
