"""Connected components over an edge table by alternating star contraction."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder of the session.

    A folder of its own is made only for a local session that has none; on a cluster that is an error,
    as executors do not share local folders.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b", loops: bool = True, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node reaches by edges; nodes without edges are absent.

    Each node points its larger neighbours, then itself and its smaller neighbours, at the smallest one
    known. Rounds grow with the logarithm of the size; each is written to the shared folder, so lineage
    stays short. Nulls take no part; nodes with an edge to themselves alone are left out without loops.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    pairs = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    alone = pairs.where("u = v").select("v")
    pairs, seen = pairs.where("u <> v"), None
    for _ in range(most_rounds):
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = written(_pointed(both, F.col("v") > F.col("u"), itself=False))
        pairs = written(_pointed(larger, F.lit(True), itself=True))
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select("v", "v").distinct())
    if not loops:
        return out
    lonely = alone.join(out, F.col("v") == F.col("node"), "left_anti")
    return out.unionAll(lonely.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _pointed(rows: DataFrame, chosen, itself: bool) -> DataFrame:
    """Edges from the chosen neighbours v of each u, and u itself, to the smallest of u and its neighbours; (u, v) with u > v."""
    least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = rows.join(least, "u").where(chosen & (F.col("v") > F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if itself:
        out = out.unionAll(least.where("m < u").select("u", F.col("m").alias("v")))
    return out.distinct()
