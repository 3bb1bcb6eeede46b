"""First, last and best rows, interleaving, chunks and running totals.

Windows always have a partition or run over rows that were reduced first; where an
order has ties, all columns given break them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvern.session import Stage


def best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order.  Null keys are a key of their own; an empty table gives no rows."""
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_place = 1").drop("_place")


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the greatest ``by`` of each key, by an aggregation: rows combine before the shuffle, so a hot key is none.

    Ties of ``by`` go to the row with the greatest other columns.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*by, *[c for c in rest if c not in by])
    return df.groupBy(*keys).agg(F.max(order).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their place."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.where(F.col("place") <= n)


def round_robin(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``turn``: rows of all groups take turns; sort by (turn, group) to interleave them."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def chunked(df: DataFrame, order: list[Column], size: int, parts: int = 64) -> DataFrame:
    """``chunk``: number of the block of ``size`` rows a row falls into in a total order.

    The order is cut into ranges, ranges are counted, and a row's place is its place
    in its range plus the rows of the ranges before: no task sees all rows.  The
    ranges are written first, since a second cut need not fall on the same rows.
    """
    at = F.spark_partition_id()
    ranged = Stage(df.sparkSession, "chunks").write(df.repartitionByRange(parts, *order).withColumn("_part", at), "ranges")
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    joined = placed.join(F.broadcast(before), "_part")
    return joined.withColumn("chunk", F.floor((F.col("_before") + F.col("_place") - 1) / size).cast("bigint")).drop("_part", "_place", "_before")


def running(df: DataFrame, key: str, order: list[Column], amount: Column, limit: float) -> DataFrame:
    """``total`` of the amounts up to each row of a key, and ``admitted`` while it is within the limit.  A null amount adds nothing."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.coalesce(amount, F.lit(0))).over(upto)
    return df.withColumn("total", total).withColumn("admitted", F.col("total") <= limit)


def with_context(df: DataFrame, key: str, order: list[Column], text: str, before: int) -> DataFrame:
    """``context``: a row's text after that of the ``before`` rows ahead of it, between line ends."""
    lines = Window.partitionBy(key).orderBy(*order).rowsBetween(-before, Window.currentRow)
    return df.withColumn("context", F.array_join(F.collect_list(text).over(lines), "\n"))


def nearest_percentile(df: DataFrame, column: str, share: float) -> DataFrame:
    """``value``: the sorted values' one at index ``floor(share * n)``, not interpolated; null for no values.

    Distinct values are counted and put into ranges; the ranges' totals, a row each,
    tell the range that holds the index, and only that one is summed up in order.
    Runs a job: the ranges are written, so that both readings see the same.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = Stage(df.sparkSession, "percentile").write(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), "counts")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("rows"), F.min("value").alias("lowest"))
    upto = F.sum("rows").over(Window.orderBy("lowest"))
    index = F.least(F.col("all") - 1, F.floor(F.col("all") * F.lit(share)))
    placed = totals.select("part", (upto - F.col("rows")).alias("before"), upto.alias("upto"), F.sum("rows").over(Window.partitionBy()).alias("all")).withColumn("index", index)
    held = placed.where((F.col("before") <= F.col("index")) & (F.col("index") < F.col("upto"))).select("part", "before", "index")
    inside = ranged.join(F.broadcast(held), "part").withColumn("at", F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("value")))
    return inside.where(F.col("at") > F.col("index")).agg(F.min("value").alias("value"))


def fixed_histogram(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """``(column, n)`` with a row for every value of the domain, 0 where there is none; others are not counted."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    return values.join(df.groupBy(column).count(), column, "left").select(column, F.coalesce("count", F.lit(0)).alias("n"))


def best_period(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The latest period of each key: latest end, then most rows, then earliest start."""
    counted = df.groupBy(*keys, start, end).agg(F.count("*").alias("figures"))
    return best(counted, keys, [F.col(end).desc(), F.col("figures").desc(), F.col(start).asc()])
