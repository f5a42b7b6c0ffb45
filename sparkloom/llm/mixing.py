"""Mixing sources to target weights by pivotal dependent rounding.

Every row's expected number of copies is its source's target over its source's size. The whole part
is taken for certain; the fractions are rounded together. Two rows at a time exchange mass at random,
so that the expected copies of both and the sum of their words stay as they were, until one of the
two is whole. Rows are dealt over small groups by a hash; each group leaves at most one fractional
row, and these meet in a tree of further groups until each source has one left, which is drawn alone.
So a source's words miss its target by less than the words of one row; within a group the longest
rows are paired first, so that this last row is short.

Defined results: null texts have size 0; a row or source of size 0 takes 0 words; a null source is
one source, ordered last; an empty table gives an empty table; rows that repeat an id are decided
one by one; extra columns do not matter; equal inputs give equal results however they are partitioned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, checkpointed, table

#: The weights that sources take in turn, and the most copies of a row.
WEIGHTS = (1, 2, 3)
MOST = 3
GROUP, FAN_IN = 2048, 64


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size): words of every row, counted where the rows lie."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_rows, target): one row a source.

    Targets share the total by weight; a source is held at `most` times its size and the rest is
    shared again. In the order of size over weight, the sources held come first, so running sums over
    the list of sources give the one level at which the others stand.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ordered = sums.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("turn") - 1) % len(weights) + 1).cast("int"))
    held = ordered.withColumn("weight", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = held.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("turn"), F.col("level").alias("level")))
    found = found.withColumn("at", F.min(fits).over(every)["level"])
    return found.select("source", "source_size", "n_rows", F.least("cap", F.col("at") * F.col("weight")).alias("target"))


def pivot(sizes: np.ndarray, shares: np.ndarray, seed: int) -> np.ndarray:
    """Shares after rows in order have exchanged words with the one still fractional; at most one stays fractional."""
    draws = np.random.Generator(np.random.PCG64(seed)).random(len(sizes))
    out, w = shares.tolist(), sizes.tolist()
    held = -1
    for j, draw in enumerate(draws.tolist()):
        if not 0.0 < out[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        rise_i, rise_j = (1 - out[i]) * w[i], out[j] * w[j]
        fall_i, fall_j = out[i] * w[i], (1 - out[j]) * w[j]
        up, down = min(rise_i, rise_j), min(fall_i, fall_j)
        if draw * (up + down) < down:
            out[i], out[j] = (1.0 if up == rise_i else out[i] + up / w[i]), (0.0 if up == rise_j else out[j] - up / w[j])
        else:
            out[i], out[j] = (0.0 if down == fall_i else out[i] - down / w[i]), (1.0 if down == fall_j else out[j] + down / w[j])
        held = next((k for k in (i, j) if 0.0 < out[k] < 1.0), -1)
    return np.array(out)


def _round(groups: DataFrame, level: int, last: bool) -> DataFrame:
    """One level of the tree: every (source, bucket) is rounded; on the last, what is left is drawn alone."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("turn", "ascending"), ("doc_id", "ascending")])
        sizes, shares = rows["size"].to_numpy(), rows["share"].to_numpy()
        seed = abs(hash_of(f"{key[0].as_py()}/{key[1].as_py()}/{level}"))
        out = pivot(sizes, shares, seed)
        if last:
            out = (out > np.random.Generator(np.random.PCG64(seed + 1)).random(len(out))).astype(float)
        return rows.set_column(rows.schema.get_field_index("share"), "share", pa.array(out))

    return groups.groupBy("source", "bucket").applyInArrow(one, groups.schema)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def decide(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """Every row of (doc_id, source, size) with source_size, target and the copies that the mix takes."""
    rows = checkpointed(rows)
    per_source = targets(rows, weights, most).withColumnRenamed("source", "of")
    joined = rows.join(per_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    wanted = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    turn = F.xxhash64("doc_id", "size", F.lit(seed))
    groups = F.ceil(F.col("n_rows") / GROUP).cast("long")
    joined = joined.select("doc_id", "source", "size", "source_size", "target", wanted.alias("wanted"), turn.alias("turn"), groups.alias("groups"))
    joined = joined.withColumn("whole", F.floor("wanted")).withColumn("share", F.when(F.col("size") > 0, F.col("wanted") - F.floor("wanted")).otherwise(0.0))
    joined = joined.withColumn("bucket", F.pmod("turn", "groups"))
    # sources are few beside rows; the depth of the tree follows the largest one
    most_groups = per_source.agg(F.max(F.ceil(F.col("n_rows") / GROUP))).first()[0] or 1
    fractional = (F.col("share") > 0) & (F.col("share") < 1)
    left, level, done = joined, 0, []
    while True:
        last = most_groups <= 1
        left = checkpointed(_round(left, level, last))
        if last:
            done.append(left)
            break
        done.append(left.where(~fractional))
        left = left.where(fractional).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        most_groups, level = -(-most_groups // FAN_IN), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("share").cast("long")).alias("copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = decide(sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
