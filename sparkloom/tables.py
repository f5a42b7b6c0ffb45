"""Table loaders and the views of them that the analytics queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Units that a request of each tier costs.
TIER_COST = {"intelligence": 1, "lightweight": 5, "playwright": 25}
#: Tier of each event type when events stand for requests.
EVENT_TIER = {"view": "intelligence", "click": "intelligence", "signup": "lightweight", "purchase": "playwright", "error": "playwright"}

#: The same view for SQL engines.
USAGE_SQL = """usage AS (
  SELECT event_id AS id, ts, 'd' || user_id AS domain, event_type AS tool, event_type <> 'error' AS success, value AS duration_ms,
    CASE WHEN event_type IN ('view', 'click') THEN 'intelligence' WHEN event_type = 'signup' THEN 'lightweight' ELSE 'playwright' END AS tier,
    CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'signup' THEN 5 ELSE 25 END AS cost_units
  FROM events)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows dealt over the cluster by columns: for rows that become texts of many times their size, as a small file is one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def literal_map(values: dict):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage records: id, ts, domain, tool, success, duration_ms, tier, cost_units."""
    tier = F.element_at(literal_map(EVENT_TIER), F.col("event_type"))
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("domain"),
        F.col("event_type").alias("tool"),
        (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("duration_ms"),
        tier.alias("tier"),
        F.element_at(literal_map(TIER_COST), tier).alias("cost_units"),
    )
