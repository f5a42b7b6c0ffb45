"""Usage, cost and latency analytics over records of (ts, domain, tool, tier, success, duration_ms, cost_units)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or a fixed value where b is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def attempt_cost(tiers: str, final: str, costs: dict[str, int]) -> Column:
    """Cost of the tiers tried: the final one in full, each other at half, rounded up."""
    table = F.create_map(*[F.lit(x) for pair in costs.items() for x in pair])
    full = lambda t: F.coalesce(F.element_at(table, t), F.lit(0))
    return F.aggregate(F.col(tiers), F.lit(0).cast("long"), lambda a, t: a + F.when(t == F.col(final), full(t)).otherwise(F.ceil(full(t) * 0.5)).cast("long"))


def totals(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, successes, cost, mean duration, share of successes and the latest tier, in one aggregation."""
    n = F.count("*")
    return rows.groupBy(*by).agg(
        n.alias("requests"),
        F.count_if("success").alias("successes"),
        F.sum("cost_units").alias("cost"),
        F.round(F.avg("duration_ms"), 6).alias("avg_duration"),
        F.round(ratio(F.count_if("success"), n), 6).alias("success_rate"),
        F.max_by("tier", F.struct("ts", "id")).alias("latest_tier"),
    )


def floor_percentiles(rows: DataFrame, by: Sequence[str], value: str, levels: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per group: values at place floor(n * level) of the ascending order, least, greatest, mean and number.

    Rows are ranked by a window that spills, so no group is held in memory as an array.
    """
    known = rows.where(F.col(value).isNotNull())
    group = Window.partitionBy(*by)
    ranked = known.withColumn("__n", F.count("*").over(group)).withColumn("__at", F.row_number().over(group.orderBy(value)) - 1)
    place = lambda q: F.least(F.floor(F.col("__n") * q), F.col("__n") - 1)
    picks = [F.max(F.when(F.col("__at") == place(q), F.col(value))).alias(f"p{int(q * 100)}") for q in levels]
    return ranked.groupBy(*by).agg(*picks, F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(value), 9).alias("mean"), F.count("*").alias("n"))


def values_at(rows: DataFrame, by: Sequence[str], value: str, places: dict[str, Column], ranges: int = 64) -> DataFrame:
    """Per group, the values at places (from 0, by __n, the group's rows) of the ascending order: for few and large groups.

    Approximate quantiles cut each group into ranges; counts of the ranges say which hold a wanted place,
    and only the different values of these are put in order. So no task sorts a group.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = known.groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx("__v", cuts, 1000).alias("__b"))
    tagged = known.join(bounds, list(by)).withColumn("__range", F.size(F.filter("__b", lambda x: x < F.col("__v")))).drop("__b")
    counts = tagged.groupBy(*by, "__range").agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    before = F.sum("__c").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__c")
    wanted = F.filter(F.array(*[p.cast("long") for p in places.values()]), lambda p: (p >= F.col("__before")) & (p < F.col("__before") + F.col("__c")))
    needed = counts.withColumn("__before", before).where(F.size(wanted) > 0).select(*by, "__range", "__before")
    values = tagged.join(needed, [*by, "__range"]).groupBy(*by, "__range", "__v").agg(F.count("*").alias("__c"), F.first("__n").alias("__n"), F.first("__before").alias("__before"))
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*by, "__range").orderBy("__v"))
    placed = values.withColumn("__upto", upto)
    picks = [F.max(F.when((p < F.col("__upto")) & (p >= F.col("__upto") - F.col("__c")), F.col("__v"))).alias(name) for name, p in places.items()]
    return placed.groupBy(*by).agg(*picks)


def few_groups_percentiles(rows: DataFrame, by: Sequence[str], value: str, levels: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """As floor_percentiles, for few groups of any size."""
    n = F.col("__n")
    picks = values_at(rows, by, value, {f"p{int(q * 100)}": F.least(F.floor(n * q), n - 1) for q in levels})
    rest = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(value), 9).alias("mean"), F.count("*").alias("n"))
    return picks.join(rest, list(by))


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, levels: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Per group: nearest-rank percentiles, for few groups of any size; groups without values have nulls."""
    n = F.col("__n")
    picks = values_at(rows, by, value, {f"p{int(q * 100)}": F.greatest(F.ceil(F.round(n * q, 6)) - 1, F.lit(0)) for q in levels})
    return rows.groupBy(*by).agg(F.count(value).alias("n")).join(picks, list(by), "left")


def top(rows: DataFrame, by: str, measure: Column, name: str, n: int, descending: bool = True) -> DataFrame:
    """The n groups of largest (or smallest) measure, ties by group."""
    found = rows.groupBy(by).agg(measure.alias(name))
    return found.orderBy(F.desc(name) if descending else F.asc(name), by).limit(n)


def share_of_cost(rows: DataFrame, by: str) -> DataFrame:
    """Cost of each group, its share of all, and the cost of 720 hours at the pace of the span seen."""
    sums = rows.groupBy(by).agg(F.sum("cost_units").alias("cost"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    every = Window.partitionBy()
    hours = (F.unix_timestamp(F.max("b").over(every).cast("timestamp")) - F.unix_timestamp(F.min("a").over(every).cast("timestamp"))) / 3600.0
    total = F.sum("cost").over(every)
    return sums.select(by, "cost", F.round(ratio(F.col("cost"), total), 6).alias("share"), F.round(ratio(F.col("cost") * 720, hours), 4).alias("monthly"))


def by_period(rows: DataFrame, unit: str) -> DataFrame:
    """Requests, cost and failures by calendar hour, day, week (from Sunday) or month."""
    day = F.to_date("ts")
    start = F.date_sub(day, F.dayofweek(day) - 1).cast("timestamp_ntz") if unit == "week" else F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    return rows.groupBy(start.alias("period")).agg(F.count("*").alias("requests"), F.sum("cost_units").alias("cost"), F.count_if(~F.col("success")).alias("failures"))


def trend(rows: DataFrame, by: str, cut: Column) -> DataFrame:
    """Per group: requests and mean duration on both sides of a cut in time, and their relative changes."""
    late = F.col("ts") >= cut
    sums = rows.groupBy(by).agg(
        F.count_if(late).alias("current"),
        F.count_if(~late).alias("previous"),
        F.avg(F.when(late, F.col("duration_ms"))).alias("__now"),
        F.avg(F.when(~late, F.col("duration_ms"))).alias("__then"),
    )
    change = lambda a, b: F.round(F.try_divide(a - b, F.nullif(b, F.lit(0))), 6)
    return sums.select(by, "current", "previous", change(F.col("current").cast("double"), F.col("previous").cast("double")).alias("request_change"), change(F.col("__now"), F.col("__then")).alias("latency_change"))


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts of values up to each bound, with sum and count."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return rows.groupBy(*by).agg(*counts, F.round(F.sum(value), 4).alias("sum"), F.count(value).alias("count"))


def zero_filled(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of listed values, 0 for those that do not occur."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(listed).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def health(rate: Column, n: Column, failures: Column) -> Column:
    """Health word from success rate, number of samples and failures in a row."""
    return (
        F.when(failures >= 6, "broken")
        .when(n < 5, "unknown")
        .when((failures >= 3) | (rate < 0.5), "failing")
        .when(rate < 0.7, "degraded")
        .otherwise("healthy")
    )
