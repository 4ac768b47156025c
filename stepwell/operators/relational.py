"""Operators that steps of flows use on frames: positional and as-of joins, series, shares, scaling, quantiles."""

from __future__ import annotations

from functools import reduce

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwell.sources.files import cut


def numbered(df: DataFrame, order: list, name: str = "_row") -> DataFrame:
    """Row numbers from 0 in a declared order, without bringing all rows into one task: rows are sorted by range, each
    partition is counted, and numbers go on from the partition before. The sorted rows are checkpointed, so that rows and
    counts speak of the same partitions whatever is replanned or run again."""
    ranged = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id()))
    # Partition p numbers its rows from p * 2**33 on; the counts, one row a partition, give what comes before.
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in").bitwiseAND((1 << 33) - 1)).drop("_part", "_in", "_before")


def index_join(left: DataFrame, right: DataFrame, order_left: list, order_right: list, lsuffix: str = "", rsuffix: str = "") -> DataFrame:
    """Left join of rows with equal numbers in declared orders; names that both sides have get the suffixes."""
    both = set(left.columns) & set(right.columns)
    if both and not (lsuffix or rsuffix):
        raise ValueError(f"both sides have {sorted(both)}: give suffixes")
    a = numbered(left, order_left).select("_row", *[F.col(c).alias(c + lsuffix if c in both else c) for c in left.columns])
    b = numbered(right, order_right).select(F.col("_row").alias("_other"), *[F.col(c).alias(c + rsuffix if c in both else c) for c in right.columns])
    return a.join(b, F.col("_row") == F.col("_other"), "left").drop("_row", "_other")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], value: str, name: str, ties: Any = F.max) -> DataFrame:
    """For each left row the value of the last right row of the same key at or before its time, or null. Right rows of
    one key and time are reduced to one first. One shuffle: both sides are stacked and scanned once in order of time."""
    r = right.groupBy(*by, on).agg(ties(value).alias("_value")).select(*by, on, "_value", F.lit(0).alias("_side"))
    l = left.withColumn("_side", F.lit(1))  # noqa: E741
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn(name, F.last("_value", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, name)


def lag_diff(df: DataFrame, column: str, order: list, by: list, name: str) -> DataFrame:
    return df.withColumn(name, F.col(column) - F.lag(column).over(Window.partitionBy(*by).orderBy(*order)))


def pct_change(df: DataFrame, column: str, order: list, by: list, name: str) -> DataFrame:
    """Relative change to the row before; null where that is null or zero."""
    before = F.lag(column).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.when(before != 0, F.col(column) / before - 1))


def share_of_total(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """Each row's part of the sum of its group. Sums are aggregated before they meet the rows, so a hot group is no
    single task."""
    total = df.groupBy(*by).agg(F.sum(column).alias("_total"))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    joined = df.alias("l").join(total.alias("r"), keys)
    return joined.select("l.*", (F.col(f"l.{column}") / F.nullif(F.col("r._total"), F.lit(0))).alias(name))


def zscore(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Columns scaled to mean 0 and population deviation 1. The statistics are scalar subqueries, which Spark merges into
    one aggregate."""
    out = {}
    for c in columns:
        mean, deviation = df.agg(F.avg(c)).scalar(), df.agg(F.stddev_pop(c)).scalar()
        out[c + suffix] = (F.col(c) - mean) / F.nullif(deviation, F.lit(0.0))
    return df.withColumns(out)


def with_global_mean(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, df.agg(F.avg(column)).scalar())


def group_quantiles(df: DataFrame, by: list[str], column: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return df.groupBy(*by).agg(*[F.percentile(column, q).alias(n) for n, q in quantiles.items()])


def top(df: DataFrame, column: str, n: int, ties: list) -> DataFrame:
    """The n largest, nulls last."""
    return df.orderBy(F.col(column).desc_nulls_last(), *ties).limit(n)


def times(df: DataFrame, factor: Any, columns: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns times a scalar, optionally renamed by a prefix."""
    chosen = columns or df.columns
    return df.select(*[(F.col(c) * factor if c in chosen else F.col(c)).alias(prefix + c) for c in df.columns])


def apply_noise(df: DataFrame, columns: list[str], seed: int = 123, key: list[str] | None = None) -> DataFrame:
    """Columns times a factor from 0.25 to 3, evenly spread. It comes from the first 52 bits of the MD5 of seed, column name
    and the row's key (all other columns, if none is given), so it doesn't depend on how rows are partitioned."""
    key = [c for c in df.columns if c not in columns] if key is None else key
    row = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]

    def factor(column: str) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(column), *row).cast("binary"))
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52) * 2.75 + 0.25

    return df.withColumns({c: F.col(c) * factor(c) for c in columns})


def hierarchy(df: DataFrame, levels: list[str], measures: dict[str, Column]) -> dict[str, DataFrame]:
    """Sums of measures at each level of a hierarchy, from the finest up: each level is made from the one below."""
    out, current = {}, df.groupBy(*levels).agg(*[F.sum(e).alias(n) for n, e in measures.items()])
    for k in range(len(levels), 0, -1):
        out[levels[k - 1]] = current
        current = current.groupBy(*levels[: k - 1]).agg(*[F.sum(n).alias(n) for n in measures]) if k > 1 else current
    return out


def reach(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All nodes that edges lead to from the start nodes (one column), the start included. One join a level with the
    nodes that are new, each level checkpointed once; cycles end it, as nothing new is found."""
    node = start.columns[0]
    new = cut(start.distinct())
    levels = [new]
    while not new.isEmpty():
        ahead = edges.join(new, F.col(src) == F.col(node), "left_semi").select(F.col(dst).alias(node)).distinct()
        new = cut(ahead.join(reduce(DataFrame.union, levels), node, "left_anti"))
        levels.append(new)
    return reduce(DataFrame.union, levels)
