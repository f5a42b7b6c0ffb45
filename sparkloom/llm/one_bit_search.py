"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Every vector, less the mean of all, is scaled to length one and turned by random rotations; its code
is the signs, packed into 64-bit words. With them go the vector's length and the inner product
of the vector with its own code, which make the estimate of a query's inner product unbiased and
bound its error. A turned query is cut into a few levels, and each binary digit of its components is
packed too: an estimate is a sum of bit counts of code AND digit, and no vector is read for it.
Queries meet all rows in blocks: in a block the rows of a query's best estimates are ranked on the
original vectors, and so is every row whose estimate and error bound together reach the k-th of them.

Work grows with queries times rows, a few word instructions a pair; memory is bounded by the blocks.
Rows and queries are sent once to every block of the other side, so blocks are as large as memory
allows, and row blocks only as small as it takes to give all tasks work.

Defined results: rows whose vector is null, zero or has null or non-finite components, or whose id is
null, take no part; shorter vectors count as ending in zeros; a query finds no row of its own id, and of
rows that repeat a query's id the smallest vector asks; equal rows all count; ties go to the smaller id;
empty tables give empty tables; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, column, table
from sparkloom.llm.vectors import in_order, matrix, packed, unpacked, usable, width

#: Standard errors within which estimates are trusted; rows ranked exactly at first, as a multiple of k; queries and rows
#: of a block at most; rows of a block wished for; queries and rows compared at once; binary digits of a query's components;
#: rotations, so signs a component.
TRUST, FIRST, QUERY_BLOCK, ROW_BLOCK, LEAST_BLOCK, AT_ONCE, ROWS_AT_ONCE, DIGITS, TURNS = 3.0, 8, 16_384, 65_536, 4096, 64, 8192, 4, 2


def rotation(wide: int, seed: int = 17) -> np.ndarray:
    """TURNS random orthogonal matrices side by side, scaled so that lengths stay: the same wherever it is made."""
    draws = np.random.Generator(np.random.PCG64(seed))
    turns = [np.linalg.qr(draws.standard_normal((wide, wide))) for _ in range(TURNS)]
    return np.concatenate([q * np.sign(np.diag(r)) for q, r in turns], axis=1) / np.sqrt(TURNS)


def mean(rows: DataFrame, wide: int) -> np.ndarray:
    """The mean vector over all rows: sums by partition, then over partitions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(wide), 0
        for batch in batches:
            x = matrix(column(batch, "vector"), wide)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide + 1)), pa.array(np.append(total, n))], ["k", "s"])

    got = rows.select("vector").mapInArrow(sums, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).orderBy("k").toArrow()["s"].to_numpy()
    return got[:wide] / max(1.0, got[wide]) if len(got) else np.zeros(wide)


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into 64-bit words."""
    octets = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-octets.shape[1] // 8) * 8), np.uint8)
    out[:, : octets.shape[1]] = octets
    return out.view(np.uint64)


def digits(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary digits of each row's components as words, lowest digit first, with the row's lowest value and the step of a level."""
    low, high = turned.min(axis=1), turned.max(axis=1)
    step = np.maximum(high - low, 1e-12) / ((1 << DIGITS) - 1)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    return np.stack([words(level >> j & 1) for j in range(DIGITS)]), low, step


def coded(rows: DataFrame, wide: int, centre: np.ndarray, kind: type) -> DataFrame:
    """(id, vector, code, length, fit) of (id, vector) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(wide)
        for batch in batches:
            x = matrix(column(batch, "vector"), wide)
            rest = x - centre
            length = np.linalg.norm(rest, axis=1)
            turned = rest @ turn / np.maximum(length, 1e-300)[:, None]
            fit = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])
            yield pa.RecordBatch.from_arrays([column(batch, "id"), packed(x.astype(kind)), packed(words(turned >= 0)), pa.array(length.astype(np.float32)), pa.array(fit.astype(np.float32))], ["id", "vector", "code", "length", "fit"])

    return rows.mapInArrow(run, "id long, vector binary, code binary, length float, fit float")


def estimates(unit: np.ndarray, code: np.ndarray, length: np.ndarray, fit: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Estimated inner products of queries of length one with rows, from packed bits and each row's two scalars."""
    turned = unit @ turn
    bits, low, step = digits(turned)
    count = np.zeros((len(unit), len(code)), np.uint16)
    for j in range(DIGITS):
        for w in range(code.shape[1]):
            count += np.bitwise_count(code[:, w] & bits[j, :, w, None]).astype(np.uint16) << np.uint16(j)
    ones = np.bitwise_count(code).sum(axis=1).astype(np.float32)
    out = count * (2 * step).astype(np.float32)[:, None]
    out += (2 * low).astype(np.float32)[:, None] * ones
    out -= turned.sum(axis=1).astype(np.float32)[:, None]
    out *= (length / np.maximum(fit, 1e-12) / np.sqrt(turn.shape[1])).astype(np.float32)
    out += (unit @ centre).astype(np.float32)[:, None]
    return out


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: dict, centre: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows of a block for each query, ties to smaller ids."""
    unit = queries / np.linalg.norm(queries, axis=1)[:, None]
    fit, vectors, ids = np.maximum(rows["fit"].astype(float), 1e-12), rows["vector"], rows["id"]
    guess = np.concatenate([estimates(unit, rows["code"][a : a + ROWS_AT_ONCE], rows["length"][a : a + ROWS_AT_ONCE], fit[a : a + ROWS_AT_ONCE], centre, turn) for a in range(0, len(fit), ROWS_AT_ONCE)], axis=1)
    # the rows of the best estimates, ranked exactly, give each query's bound
    some = min(len(fit), FIRST * k)
    first = np.argpartition(guess, len(fit) - some, axis=1)[:, len(fit) - some :]
    exact = np.einsum("qd,qrd->qr", unit, vectors[first].astype(float))
    exact[ids[first] == query_ids[:, None]] = -np.inf
    bound = -np.partition(-exact, min(k, some) - 1, axis=1)[:, min(k, some) - 1]
    if some < len(fit) and some <= k:
        bound[:] = -np.inf
    bound -= 1e-9
    # what a code's own inner product leaves open, spread over the other directions
    guess += (TRUST * np.sqrt(np.maximum(0.0, 1 - fit**2)) / fit / np.sqrt(max(1, turn.shape[1] - 1)) * rows["length"] + 1e-5).astype(np.float32)
    np.put_along_axis(guess, first, np.inf, axis=1)
    q, r = np.divmod(np.flatnonzero(guess >= bound[:, None].astype(np.float32)), len(fit))
    score, kept = [], []
    # in the vectors' own precision first, with room for its rounding
    short, slack = unit.astype(vectors.dtype), 2.4e-7 * vectors.shape[1] * float(np.sqrt((vectors**2).sum(axis=1).max(initial=0))) if vectors.dtype == np.float32 else 0.0
    for a in range(0, len(q), 50_000):
        i, j = q[a : a + 50_000], r[a : a + 50_000]
        near = np.einsum("id,id->i", short[i], vectors[j])
        good = np.flatnonzero((near >= bound[i] - slack) & (query_ids[i] != ids[j]))
        kept.append(a + good)
        score.append(in_order(queries[i[good]], vectors[j[good]].astype(float)))
    if not kept:
        return query_ids[:0], ids[:0], np.zeros(0)
    kept, score = np.concatenate(kept), np.concatenate(score)
    q, r = q[kept], r[kept]
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return query_ids[q[top]], ids[r[top]], score[top]


def search(rows: DataFrame, asks: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, <key>, score): for each row that asks, the k other rows of largest inner product."""
    good = rows.where(usable(vector) & F.col(key).isNotNull())
    every = good.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    wide = width(every, "vector")
    centre = mean(every, wide)
    kind = np.float32 if good.schema[vector].dataType.elementType.typeName() == "float" else np.float64
    codes = checkpointed(coded(every, wide, centre, kind))
    queries = good.where(asks).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(vector).alias("vector"))
    queries = checkpointed(coded(queries, wide, centre, kind))
    n, tasks = codes.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(1, -(-n // ROW_BLOCK), min(tasks, n // LEAST_BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shared = ["id", "vector", "code", "length", "fit"]
    left = queries.select(block(query_blocks, 1).alias("qb"), every_block(row_blocks).alias("rb"), F.lit(False).alias("row"), *shared)
    right = codes.select(every_block(query_blocks).alias("qb"), block(row_blocks, 2).alias("rb"), F.lit(True).alias("row"), *shared)
    turn = rotation(wide) if wide else np.zeros((0, 0))

    def run(key: tuple, got: pa.Table) -> pa.Table:
        is_row = got["row"].to_numpy()
        asking, there = got.filter(~is_row), got.filter(is_row)
        if not asking.num_rows or not there.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x = unpacked(asking["vector"], kind, wide).astype(np.float64)
        block = {"id": there["id"].to_numpy(), "vector": unpacked(there["vector"], kind, wide), "code": unpacked(there["code"], np.uint64, -(-wide * TURNS // 64)), "length": there["length"].to_numpy(), "fit": there["fit"].to_numpy()}
        ids, parts = asking["id"].to_numpy(), []
        for a in range(0, len(ids), AT_ONCE):
            parts.append(best_of_block(x[a : a + AT_ONCE], ids[a : a + AT_ONCE], block, centre, turn, k))
        q, r, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return pa.table({"query_id": q, "id": r, "score": s})

    best = left.unionAll(right).groupBy("qb", "rb").applyInArrow(run, "query_id long, id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def op6_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP6_SQL = """
WITH good AS (
  SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v) AS score
  FROM good q JOIN good r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
