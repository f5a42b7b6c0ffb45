"""Reports over records of executions, patterns, feedback and tracked pages: counts, rates, rankings and health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From where on a system is healthy and degraded, by success rate, mean latency and share of fallbacks.
HEALTHY = {"success": 0.95, "latency": 1000.0, "fallback": 0.1}
DEGRADED = {"success": 0.85, "latency": 3000.0, "fallback": 0.3}
#: Weights of the parts of a health score.
SCORE_WEIGHTS = {"hit_rate": 20, "accuracy": 25, "optimised": 20, "reuse": 15, "coverage": 20}


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """A ratio, with a value of its own where the whole is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def zero_filled(rows: DataFrame, name: str, values: Sequence[str], out: str = "n") -> DataFrame:
    """(name, out): the rows of each of the values, those without rows included; one pass, one row a task."""
    counts = rows.agg(*[F.count_if(F.col(name) == v).alias(v) for v in values])
    return counts.unpivot([], list(values), name, out)


def ranked(rows: DataFrame, by: Sequence[str], name: str, k: int, weight: Column | None = None) -> DataFrame:
    """(by, name, n, place): the k most frequent names within each group, or those of the largest sums, ties by name."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(*by, name).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), name))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def executions(rows: DataFrame, by: str, success: Column, duration: Column, ts: str, quantile: float = 0.95) -> DataFrame:
    """(by, total, successes, failures, success_rate, mean, first, last) with p95, the value at place floor(0.95 n)."""
    counts = rows.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(success).alias("successes"),
        F.count_if(~success).alias("failures"),
        F.round(F.avg(duration), 6).alias("mean"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        F.count(duration).alias("timed"),
    )
    # the place of the quantile among the distinct values, from their counts: no group is gathered
    values = rows.where(duration.isNotNull()).groupBy(by, duration.alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("v"))
    placed = values.withColumn("upto", upto).join(counts.select(by, F.floor(F.col("timed") * quantile).alias("at")), by)
    p95 = placed.where(F.col("upto") > F.col("at")).groupBy(by).agg(F.min("v").alias("p95"))
    rate = F.round(share(F.col("successes"), F.col("total")), 6)
    return counts.join(p95, by, "left").select(by, "total", "successes", "failures", rate.alias("success_rate"), "mean", "p95", "first", "last")


def health(success: Column, latency: Column, fallback: Column) -> Column:
    """healthy, degraded or unhealthy by three measures; null measures count as good."""
    s, l, f = F.coalesce(success, F.lit(1.0)), F.coalesce(latency, F.lit(0.0)), F.coalesce(fallback, F.lit(0.0))
    within = lambda t: (s >= t["success"]) & (l <= t["latency"]) & (f <= t["fallback"])
    return F.when(within(HEALTHY), "healthy").when(within(DEGRADED), "degraded").otherwise("unhealthy")


def health_issues(success: Column, latency: Column, fallback: Column) -> Column:
    """What keeps a system from being healthy, one text a measure."""
    percent = lambda x: F.format_string("%.1f%%", x * 100)
    ms = lambda x: F.concat(F.round(x).cast("long").cast("string"), F.lit("ms"))
    return F.array_compact(
        F.array(
            F.when(success < DEGRADED["success"], F.concat(F.lit("Low success rate: "), percent(success))).when(success < HEALTHY["success"], F.concat(F.lit("Success rate below optimal: "), percent(success))),
            F.when(latency > DEGRADED["latency"], F.concat(F.lit("High average latency: "), ms(latency))).when(latency > HEALTHY["latency"], F.concat(F.lit("Latency above optimal: "), ms(latency))),
            F.when(fallback > DEGRADED["fallback"], F.concat(F.lit("High fallback rate: "), percent(fallback))).when(fallback > HEALTHY["fallback"], F.concat(F.lit("Fallback rate above optimal: "), percent(fallback))),
        )
    )


def health_score(parts: dict[str, Column]) -> Column:
    """Weighted mean of shares from 0 to 1, as a whole number from 0 to 100."""
    total = sum(SCORE_WEIGHTS.values())
    mean = sum((parts[k] * 100 * w for k, w in SCORE_WEIGHTS.items()), F.lit(0.0)) / total
    return F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), mean)) + 0.5)


def effectiveness(patterns: DataFrame, level: Column, verified: Column, failed: Column) -> DataFrame:
    """(level, patterns, used, success_rate, mean_verifications): the mean over patterns with a record of each pattern's own rate."""
    own = F.when(verified + failed > 0, verified / (verified + failed))
    return patterns.groupBy(level.alias("level")).agg(
        F.count("*").alias("patterns"),
        F.count_if(verified > 0).alias("used"),
        F.round(F.coalesce(F.avg(own), F.lit(0.0)), 6).alias("success_rate"),
        F.round(share(F.sum(F.when(verified > 0, verified)), F.count_if(verified > 0)), 6).alias("mean_verifications"),
    )


def relationships(transfers: DataFrame, a: str, b: str, success: Column, similarity: Column, ts: str) -> DataFrame:
    """(a, b, transfers, successes, rate, similarity, last) of unordered pairs.

    The running mean takes a missing similarity as the mean so far, so it is a product of factors: with
    n-th values x and counts n, mean_n = mean_{n-1} (n-1)/n + x/n, and a missing x leaves it as it is.
    """
    rows = transfers.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), success.alias("ok"), similarity.cast("double").alias("x"), ts)
    turn = F.row_number().over(Window.partitionBy("a", "b").orderBy(ts))
    # the factors (n-1)/n of later rows that have a value: summed as logarithms from the end; a first row has weight one
    numbered = rows.withColumn("n", turn)
    later = Window.partitionBy("a", "b").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    keep = F.coalesce(F.sum(F.when(F.col("x").isNotNull() & (F.col("n") > 1), F.log((F.col("n") - 1) / F.col("n")))).over(later), F.lit(0.0))
    weighted = numbered.withColumn("part", F.coalesce(F.col("x"), F.lit(0.0)) / F.col("n") * F.exp(keep))
    return weighted.groupBy("a", "b").agg(
        F.count("*").alias("transfers"),
        F.count_if("ok").alias("successes"),
        F.round(F.count_if("ok") / F.count("*"), 6).alias("rate"),
        F.round(F.sum("part"), 6).alias("similarity"),
        F.max(ts).alias("last"),
    )


def first_reason(checks: Sequence[tuple[Column, str]]) -> Column:
    """The text of the first check that fails, or null."""
    out = F.lit(None).cast("string")
    for passed, reason in reversed(checks):
        out = F.when(~F.coalesce(passed, F.lit(False)), reason).otherwise(out)
    return out
