"""Change detection over observations and prediction of the next change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import written
from sparkloom.operators.ordered import intervals


def against_previous(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Rows with the value before in their group and whether it differs; null for the first.

    Groups are cut into ranges, so one that holds most rows is spread; the first row of a range takes the last value of the range before.
    """
    dealt = written(rows.withColumn("value", value).repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    w = Window.partitionBy("__range", *by).orderBy(*order)
    placed = dealt.withColumn("before", F.lag("value").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    ends = dealt.groupBy("__range", *by).agg(F.max_by(F.struct("value"), F.struct(*order)).alias("__end"))
    # as many rows as ranges and groups, not as rows
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy(*by).orderBy("__range"))).where("__end is not null")
    ends = ends.select("__end", *[F.col(c).alias(f"__{i}") for i, c in enumerate(("__range", *by))])
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(("__range", *by))]
    firsts = placed.where("__first").join(ends, same, "left").withColumn("before", F.col("__end.value"))
    out = placed.where("not __first").select(*rows.columns, "value", "before").unionAll(firsts.select(*rows.columns, "value", "before"))
    return out.withColumn("changed", F.col("value") != F.col("before"))


def daily_pattern(changes: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Most frequent hour of changes, its share (neighbouring hours included), days seen, and whether that is a daily pattern."""
    hours = changes.groupBy(*by, F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    modal = hours.groupBy(*by).agg(F.min_by("hour", F.struct(-F.col("n"), F.col("hour"))).alias("typical"))
    seen = changes.join(modal, list(by))
    apart = F.abs(F.hour(ts) - F.col("typical"))
    near = F.least(apart, 24 - apart) <= 1
    out = seen.groupBy(*by).agg(F.max("typical").alias("typical_hour"), F.round(F.avg(near.cast("int")), 6).alias("share"), F.count_distinct(F.to_date(ts)).alias("days"))
    return out.withColumn("daily", (F.col("share") > 0.6) & (F.col("days") >= 3))


def workday_pattern(changes: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Share of changes on weekdays, and whether that is a workday pattern."""
    weekend = F.dayofweek(ts).isin(1, 7)
    out = changes.groupBy(*by).agg(F.round(F.avg((~weekend).cast("int")), 6).alias("share"), F.count_if(weekend).alias("weekend"), F.count("*").alias("n"))
    return out.withColumn("workday", (F.col("share") > 0.85) & (F.col("weekend") <= 1) & (F.col("n") >= 5))


def weekly_pattern(changes: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Share of the three most frequent weekdays, weeks seen, and whether that is a weekly pattern."""
    days = changes.groupBy(*by, F.dayofweek(ts).alias("day")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "day"))
    three = days.withColumn("r", rank).groupBy(*by).agg(F.sum(F.when(F.col("r") <= 3, F.col("n"))).alias("top"), F.sum("n").alias("all"))
    weeks = changes.groupBy(*by).agg(F.count_distinct(F.date_trunc("week", ts)).alias("weeks"))
    out = three.join(weeks, list(by)).select(*by, F.round(F.col("top") / F.col("all"), 6).alias("share"), "weeks")
    return out.withColumn("weekly", (F.col("share") > 0.7) & (F.col("weeks") >= 3))


def monthly_pattern(changes: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Number of different days of the month and of months, and whether that is a monthly pattern."""
    out = changes.groupBy(*by).agg(F.count_distinct(F.dayofmonth(ts)).alias("days"), F.count_distinct(F.date_trunc("month", ts)).alias("months"))
    return out.withColumn("monthly", (F.col("days") <= 5) & (F.col("months") >= 2))


def seasonal(changes: DataFrame, ts: str) -> DataFrame:
    """Share of changes by day of the month; high from one and a half times the even share."""
    n = changes.groupBy(F.dayofmonth(ts).alias("day")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return n.select("day", F.round(share, 6).alias("share"), (share >= 1.5 / 31).alias("high"))


def next_change(changes: DataFrame, by: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The last change, the mean interval in whole seconds, and the time one interval after the last."""
    gaps = intervals(changes, by, ts, tie).groupBy(*by).agg(F.max(ts).alias("last"), F.floor(F.avg("gap")).alias("mean_s"))
    return gaps.where("mean_s is not null").withColumn("next", F.col("last") + F.make_dt_interval(secs=F.col("mean_s").cast("decimal(18,6)")))


def interval_preset(mean_h: Column, confidence: Column, low: float = 5 / 60, high: float = 24.0, default: float = 168.0) -> Column:
    """Hours between checks: four fifths of the mean within bounds where it is trusted, else a default."""
    return F.when(confidence > 0.3, F.greatest(F.lit(low), F.least(F.lit(high), 0.8 * mean_h))).otherwise(F.lit(default))


def urgency(overdue_h: Column) -> Column:
    return F.when(overdue_h >= 24, 3).when(overdue_h >= 1, 2).when(overdue_h >= 0, 1).otherwise(0)
