"""Join-like operators: rules against rows, coverage, agreement across sources, tree differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rule(rows: DataFrame, rules: Sequence[tuple[str, str]], value: Column, out: str) -> DataFrame:
    """Rows with the name of the first rule whose pattern matches; a rule list is part of the plan, not a table."""
    hit = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        hit = F.when(value.rlike(pattern), F.lit(name)).otherwise(hit)
    return rows.withColumn(out, hit)


def regex_join(rows: DataFrame, rules: DataFrame, value: Column, pattern: str, most_rules: int = 10_000) -> DataFrame:
    """Rows with every rule whose pattern matches. The rules are broadcast; a table of more than most_rules is refused."""
    if rules.limit(most_rules + 1).count() > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    return rows.join(F.broadcast(rules), F.regexp(value, F.col(pattern)))


def uncovered(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def covered(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_semi")


def related(rows: DataFrame, node: str, via: str) -> DataFrame:
    """Pairs a < b of nodes with a common neighbour, and the number of common neighbours.

    Neighbours are joined on, so the rows grow with the squares of their degrees; meant for relations
    whose neighbours have few nodes each.
    """
    left, right = rows.select(F.col(node).alias("a"), via).distinct(), rows.select(F.col(node).alias("b"), via).distinct()
    return left.join(right, via).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))


def counted_above(rows: DataFrame, others: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the number n of others that have the same key and a larger value; rows without any are left out.

    No pairs are made: others are counted by key and whole number of the value, these counts are added
    up from above, and only inside a whole number are rows and others brought into one order. Null keys
    and values meet nothing; NaN is above all numbers and ties are not above each other.
    """
    whole = lambda: F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(F.floor(value).cast("long")).alias("__whole")
    known = lambda df: df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    marked = known(rows).select(F.col(key).alias("__key"), F.col(value).alias("__value"), whole(), F.struct("*").alias("__row"), F.lit(0).alias("__one"))
    both = marked.unionByName(known(others).select(F.col(key).alias("__key"), F.col(value).alias("__value"), whole(), F.lit(1).alias("__one")), allowMissingColumns=True)
    # peers have the same value, so the frame takes them in and they are taken off again
    inside = Window.partitionBy("__key", "__whole").orderBy(F.desc("__value"))
    peers = Window.partitionBy("__key", "__whole", "__value")
    near = both.withColumn("__near", F.sum("__one").over(inside) - F.sum("__one").over(peers)).where("__row is not null")
    totals = both.groupBy("__key", "__whole").agg(F.sum("__one").alias("__n"))
    above = Window.partitionBy("__key").orderBy(F.desc("__whole")).rowsBetween(Window.unboundedPreceding, -1)
    over = totals.select("__key", "__whole", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__over"))
    counted = near.join(over, ["__key", "__whole"]).withColumn("n", F.col("__near") + F.col("__over")).where("n > 0")
    return counted.select("__row.*", "n")


def agreement(rows: DataFrame, entity: Sequence[str], source: str, value: str) -> DataFrame:
    """Per entity: the value of most sources (ties to the smaller), its sources, all sources and distinct values."""
    per = rows.groupBy(*entity, value).agg(F.count_distinct(source).alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value)))
    out = per.groupBy(*entity).agg(best.alias("best"), F.count("*").alias("values"))
    sources = rows.groupBy(*entity).agg(F.count_distinct(source).alias("sources"))
    return out.join(sources, list(entity)).select(*entity, F.col("best")[value].alias("recommended"), F.col("best")["n"].alias("agreeing"), "sources", "values")


def compared(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys that differ between two tables: added, removed or modified, with both values."""
    joined = old.select(*key, F.col(value).alias("old")).join(new.select(*key, F.col(value).alias("new")), list(key), "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return joined.withColumn("change", change).where("change is not null")


def best_first(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
