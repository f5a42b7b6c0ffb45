"""Sources and sinks: JSON documents, key-value logs, metrics text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema of the key-value table.
KEY_VALUE = T.StructType([T.StructField("namespace", T.StringType(), False), T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType()), T.StructField("updated_at", T.LongType())])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON documents; no rows where the path does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def latest_values(log: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The current rows of an append-only log: the last of each key, by an aggregation that combines before the shuffle."""
    rest = [c for c in log.columns if c not in key and c not in order]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest, *order), F.struct(*order)).alias("__row")).select(*key, "__row.*")


def upsert(log_path: str, rows: DataFrame) -> None:
    """Rows appended to a key-value log, by namespace; reads take the latest."""
    rows.write.mode("append").partitionBy("namespace").parquet(log_path)


def zero_filled(counts: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    listed = counts.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(listed).join(counts, column, "left").na.fill(0)


def exposition(rows: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """Metric rows as exposition text, one line each, labels by name."""
    parts = [F.concat(F.lit(f'{x}="'), F.regexp_replace(F.coalesce(F.col(x).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for x in sorted(labels)]
    return rows.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("value"))


def har_entry(request: Column, most: int = 1_048_576) -> Column:
    """A recorded request as an archive entry; bodies are cut at a size."""
    body = request["response_body"]
    return F.struct(
        request["timestamp"].alias("startedDateTime"),
        request["duration"].alias("time"),
        F.struct(request["method"].alias("method"), request["url"].alias("url")).alias("request"),
        F.struct(request["status"].alias("status"), F.struct(F.octet_length(body).alias("size"), F.left(body, F.lit(most)).alias("text")).alias("content")).alias("response"),
    )


def pack(rows: DataFrame, by: str) -> DataFrame:
    """Rows of each key as one JSON document, ordered."""
    rest = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("document"))
