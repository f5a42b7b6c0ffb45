"""Window operators: intervals, runs, retention and running figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Microsecond-exact seconds of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def intervals(rows: DataFrame, by: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Rows with the seconds since the row before in the group."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    return rows.withColumn("gap", seconds(F.col(ts)) - F.lag(seconds(F.col(ts))).over(w))


def interval_stats(rows: DataFrame, by: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Mean, least, greatest and population deviation, in hours, of the intervals of each group."""
    gap = F.col("gap") / 3600
    return intervals(rows, by, ts, tie).where("gap is not null").groupBy(*by).agg(F.round(F.avg(gap), 6).alias("avg_h"), F.round(F.min(gap), 6).alias("min_h"), F.round(F.max(gap), 6).alias("max_h"), F.round(F.stddev_pop(gap), 6).alias("std_h"), F.count("*").alias("n"))


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def failure_runs(rows: DataFrame, by: Sequence[str], ts: str, tie: str, ok: str) -> DataFrame:
    """Each unbroken run of failures: group, start, end and length."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    island = rows.withColumn("__run", F.sum(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.where(~F.col(ok)).groupBy(*by, "__run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length")).drop("__run")


def running(rows: DataFrame, by: Sequence[str], ts: str, tie: str, value: str, last: int | None = None) -> DataFrame:
    """Rows with the running mean, least and greatest of a value, over all rows before or the last so many."""
    w = Window.partitionBy(*by).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding if last is None else 1 - last, 0)
    return rows.withColumns({"run_mean": F.round(F.avg(value).over(w), 9), "run_min": F.min(value).over(w), "run_max": F.max(value).over(w), "run_n": F.count(value).over(w)})


def trailing(rows: DataFrame, by: Sequence[str], ts: str, span: int, measures: dict[str, Column]) -> DataFrame:
    """Rows with measures over the rows of the last so many seconds, equal times included."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-span * 1_000_000, 0)
    return rows.withColumns({name: m.over(w) for name, m in measures.items()})


def cooldown(failures: Column, base: float, cap: float) -> Column:
    """Seconds of back-off after so many failures in a row: doubling from a base up to a cap; 0 without failures."""
    return F.when(failures <= 0, F.lit(0.0)).otherwise(F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), failures - 1)))
