"""Near-duplicate vectors of one label by product quantisation.

Vectors are scaled to length one, so a cosine bound is a distance bound. A coarse codebook gives
inverted lists by label and cell; what is left after the coarse centroid is coded by a codebook per
subspace, and the length of what the code leaves is kept. A vector is compared with its own list and
with every list that can hold a near vector: by the bisecting plane between two centroids no vector
of the list could else be near enough. In a list, asymmetric distances come from lookup tables; by
the triangle inequality a vector within the bound has a table distance of at most the bound plus its
code's error. These candidates get an exact cosine. So no link is lost, and codebooks, fitted on a
bounded sample, decide the cost alone.

Equal vectors form one class with a count. Lists are cut into blocks; a block reports sums of links
and a spanning set of edges, so its output grows with its rows and not with its links.

Defined results: rows with a null label or a vector that is null, zero or has null or non-finite
components link with nothing; shorter vectors count as ending in zeros; rows that repeat an id are
vectors of their own in counts and one node in components; a null id has a null component and is
kept; empty tables give empty tables; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, column, table
from sparkloom.llm.vectors import in_order, k_means, matrix, nearest, packed, unpacked, usable, width
from sparkloom.operators.graph import components

#: Rows that codebooks are fitted on at most; subspaces and codes of one; rows of a cell wished for,
#: most cells; rows of a block; queries compared at once.
SAMPLE, PARTS, CODES, CELL_ROWS, MOST_CELLS, BLOCK, AT_ONCE = 20_000, 8, 64, 2048, 1024, 2048, 256
#: Added to bounds against rounding; the exact cosine decides.
ROUNDING = 1e-7


@dataclass
class Codebooks:
    coarse: np.ndarray
    bounds: list[tuple[int, int]]
    fine: list[np.ndarray]


def fit(classes: DataFrame, wide: int, rows: int, largest: int, seed: int = 23) -> Codebooks:
    """Codebooks from the rows of smallest hashes."""
    share = min(1.0, SAMPLE / max(rows, 1))
    some = classes.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("id", "vector").toArrow().sort_by("id").combine_chunks()
    x = matrix(some["vector"].combine_chunks(), wide) if len(some) else np.eye(1, max(wide, 1))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    coarse = k_means(x, max(1, min(MOST_CELLS, -(-largest // CELL_ROWS))), 8, seed)
    rest = x - coarse[nearest(x, coarse)]
    edges = [(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(x.shape[1]), PARTS) if len(p)]
    return Codebooks(coarse, edges, [k_means(rest[:, a:b], CODES, 8, seed + 1 + i) for i, (a, b) in enumerate(edges)])


def listed(classes: DataFrame, books: Codebooks, wide: int, radius: float) -> DataFrame:
    """(label, cell, home, id, n, vector, code, error): every class in its own list and, as a visitor, in later lists it may have links in."""
    shared = classes.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        between = np.linalg.norm(books.coarse[:, None] - books.coarse[None], axis=2)
        for batch in batches:
            raw = matrix(column(batch, "vector"), wide)
            x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
            square = (x * x).sum(axis=1)[:, None] + (books.coarse**2).sum(axis=1) - 2 * (x @ books.coarse.T)
            cell = square.argmin(axis=1)
            rest = x - books.coarse[cell]
            codes = np.stack([nearest(rest[:, a:b], c) for (a, b), c in zip(books.bounds, books.fine)], axis=1).astype(np.uint8)
            left = rest.copy()
            for m, ((a, b), c) in enumerate(zip(books.bounds, books.fine)):
                left[:, a:b] -= c[codes[:, m]]
            error = np.linalg.norm(left, axis=1)
            apart = (square - square[np.arange(len(x)), cell][:, None]) / np.maximum(2 * between[cell], 1e-12)
            row, visit = np.nonzero((apart <= radius + ROUNDING) & (np.arange(len(books.coarse)) > cell[:, None]))
            take = np.concatenate([np.arange(len(x)), row])
            home = np.arange(len(take)) < len(x)
            where = np.concatenate([cell, visit]).astype(np.int32)
            for a in range(0, len(take), 5000):
                i = take[a : a + 5000]
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([column(batch, "label").take(at), pa.array(where[a : a + 5000]), pa.array(home[a : a + 5000]), column(batch, "id").take(at), column(batch, "n").take(at), packed(raw[i]), packed(codes[i]), pa.array(error[i])], ["label", "cell", "home", "id", "n", "vector", "code", "error"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.mapInArrow(run, f"label {kind}, cell int, home boolean, id long, n long, vector binary, code binary, error double")


class Block:
    """Rows of a list at home in one block, and the links of queries with them."""

    def __init__(self, books: Codebooks, cell: int, least: float, radius: float, rows: dict):
        self.books, self.cell, self.least, self.radius = books, cell, least, radius
        self.__dict__.update(rows)
        self.norm = np.sqrt(in_order(self.vector, self.vector))
        self.sums = np.zeros(len(self.ids), np.int64)
        self.root = np.arange(len(self.ids))

    def meet(self, ids, n, vectors, start: int = -1) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Each query's sum of linked rows, and edges that connect them. From a start on, queries are the block's own rows, met by later ones only."""
        norm = np.sqrt(in_order(vectors, vectors))
        rest = vectors / norm[:, None] - self.books.coarse[self.cell]
        square = np.zeros((len(ids), len(self.ids)))
        for m, ((a, b), c) in enumerate(zip(self.books.bounds, self.books.fine)):
            look_up = (rest[:, a:b] ** 2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * (rest[:, a:b] @ c.T)
            square += look_up[:, self.code[:, m]]
        q, r = np.nonzero(square <= (self.radius + self.error + ROUNDING) ** 2)
        if start >= 0:
            later = r > q + start
            q, r = q[later], r[later]
        cosine = np.empty(len(q))
        for a in range(0, len(q), 100_000):
            i, j = q[a : a + 100_000], r[a : a + 100_000]
            cosine[a : a + 100_000] = in_order(vectors[i], self.vector[j]) / (norm[i] * self.norm[j])
        q, r = q[cosine >= self.least], r[cosine >= self.least]
        sums = np.bincount(q, self.n[r], len(ids)).astype(np.int64)
        self.sums += np.bincount(r, n[q], len(self.ids)).astype(np.int64)
        edges = []
        cut = np.searchsorted(q, np.arange(len(ids) + 1))
        for i in np.unique(q).tolist():
            roots = np.unique(self.root[r[cut[i] : cut[i + 1]]])
            if start >= 0:
                roots = np.unique(np.append(roots, self.root[start + i]))
            else:
                edges.append((ids[i], self.ids[roots[0]]))
            if len(roots) > 1:
                edges += [(self.ids[roots[0]], self.ids[x]) for x in roots[1:].tolist()]
                self.root[np.isin(self.root, roots)] = roots[0]
        return sums, edges


def linked(blocks: DataFrame, books: Codebooks, wide: int, least: float, radius: float) -> DataFrame:
    """(a, b, n) from rows dealt by label, cell and block, those at home first: links n of class a, or an edge from a to b."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    parts = len(books.bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        key, block, gathered = None, None, []

        def result(rows: list, edges: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows] + [a for a, _ in edges], pa.int64()), pa.array([None] * len(rows) + [b for _, b in edges], pa.int64()), pa.array([n for _, n in rows] + [0] * len(edges), pa.int64())], ["a", "b", "n"])

        def values(got: pa.Table) -> dict:
            return {"ids": got["id"].to_numpy(), "n": got["n"].to_numpy(), "vector": unpacked(got["vector"], np.float64, wide), "code": unpacked(got["code"], np.uint8, parts), "error": got["error"].to_numpy()}

        def opened() -> Iterator[pa.RecordBatch]:
            """The block from the rows gathered, once they are all there, and the links among them."""
            nonlocal block, gathered
            if block is None and gathered:
                block = Block(books, key[1], least, radius, values(pa.concat_tables(gathered)))
                gathered = []
                for a in range(0, len(block.ids), AT_ONCE):
                    part = slice(a, a + AT_ONCE)
                    sums, edges = block.meet(block.ids[part], block.n[part], block.vector[part], a)
                    block.sums[part] += sums
                    yield result([], edges)

        def closed() -> Iterator[pa.RecordBatch]:
            yield from opened()
            if block is not None:
                some = np.flatnonzero(block.sums)
                yield result(list(zip(block.ids[some].tolist(), block.sums[some].tolist())), [])

        for batch in batches:
            got = pa.Table.from_batches([batch])
            if not got.num_rows:
                continue
            marks = list(zip(*(got[c].to_pylist() for c in ("label", "cell", "block", "home"))))
            cuts = [0] + [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]] + [len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                run_of, home = marks[a][:3], marks[a][3]
                if run_of != key:
                    yield from closed()
                    key, block, gathered = run_of, None, []
                if home:
                    gathered.append(got.slice(a, b - a))
                    continue
                yield from opened()
                for c in range(a, b, AT_ONCE):
                    if block is not None:
                        x = values(got.slice(c, min(AT_ONCE, b - c)))
                        sums, edges = block.meet(x["ids"], x["n"], x["vector"])
                        some = np.flatnonzero(sums)
                        yield result(list(zip(x["ids"][some].tolist(), sums[some].tolist())), edges)
        yield from closed()

    return blocks.mapInArrow(run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    plain = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    good = usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull()
    marked = plain.withColumn("good", good).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    classes = checkpointed(marked.where("good").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    wide = width(classes, "vector")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    # a little wider than the exact bound: an id that stands for several classes is told apart by its own class only
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + ROUNDING
    named = classes.withColumn("rep", F.col("id")).withColumn("id", F.monotonically_increasing_id())
    named = checkpointed(named)
    books = fit(named, wide, largest[1] or 0, largest[0] or 0)
    lists = checkpointed(listed(named.select("label", "id", "n", "vector"), books, wide, radius))
    sizes = lists.where("home").groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("id", F.lit(2)), "blocks").cast("int")).otherwise(F.col("blocks"))
    placed = lists.join(sizes, ["label", "cell"]).withColumn("own", own)
    # a row is at home in its own block and asks in those before it; visitors ask in all
    dealt = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.least("own", F.col("blocks") - 1)))).withColumn("home", F.col("home") & (F.col("block") == F.col("own")))
    dealt = dealt.repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", F.desc("home"))
    met = checkpointed(linked(dealt.select("label", "cell", "block", "home", "id", "n", "vector", "code", "error"), books, wide, least, radius))
    reps = named.select(F.col("id").alias("class"), "label", "h1", "h2", "n", "rep")
    sums = met.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    ends = met.where("b is not null").select("a", "b").join(reps.select(F.col("class").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("class").alias("b"), F.col("rep").alias("rb")), "b")
    joined = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")), loops=False)
    told = reps.join(sums, "class", "left").join(joined, F.col("rep") == F.col("node"), "left")
    told = checkpointed(told.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    out = marked.where("good").join(told, ["label", "h1", "h2"]).select("id", "links", "component")
    out = out.unionAll(marked.where(~F.col("good")).select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op7_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


OP7_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
sums AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(s.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low l ON e.vec_id = l.a LEFT JOIN sums s ON e.vec_id = s.a
"""
