"""Quality: a linear support vector machine over n-gram indicators scaled by naive Bayes log-count ratios.

A text's n-grams are those of its characters (word ends marked, case kept), those of its character
classes with equal neighbours as one, and runs of words equal to the word before. Each n-gram counts
once a text, scaled by the log of its smoothed share in good over that in other labelled texts; the
scaled values of each of the three kinds have length 1 together. Hinge loss is minimised by dual coordinate descent: every task takes
turns over the rows of its own block and its change of the weights is added to that of the others,
with steps shortened for the number of blocks, so rows never leave their tasks. Margins become
scores by a logistic curve, fitted on margins of rows by weights that have not seen them: in the same
turns, one more set of weights is found for each fold of the sample, from the rows of the other folds.

It is fitted on at most `most_rows` labelled rows a class, those with the smallest hashes of their
ids. A row is a set of at most WIDE buckets however long its text; the driver holds one number a row
and two a bucket, and the model has a fixed size, so it is broadcast.

Defined results: null and empty texts get the score of a text without n-grams; labels that are null
or not 0 or 1 are not learned from, and of repeated labels of an id the smallest counts; repeated
rows are learned from and scored each for itself; rows without id are scored, not learned from;
without labels of both classes the score is 0 for all (or 1, if all labels are 1); equal hashes of
ids are ordered by id; very long texts are read whole, in portions; empty tables give empty tables;
extra columns do not matter, and one named like the output is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded, checkpointed, column, fold, strings, table
from sparkloom.llm.ngrams import BLANK, grams
from sparkloom.llm.shingles import word_hashes

#: Buckets of character n-grams and of n-grams of classes, and three for repeated words.
CHARS, CHAR_SIZES = 18, (1, 2, 3, 4)
SHAPES, SHAPE_SIZES = 14, (1, 2, 3, 4, 5)
EDGES = np.cumsum([0, 1 << CHARS, 1 << SHAPES, 3])
WIDE = int(EDGES[-1])
#: Labelled rows of each class that the model is fitted on at most; blocks they are dealt over; folds for the curve.
MOST_ROWS, BLOCKS, FOLDS = 12_000, 8, 3
LOWER, UPPER, DIGIT, OTHER, INNER = 1, 2, 3, 4, 5
#: Code points handled together.
AT_ONCE = 1_000_000


@dataclass
class Model:
    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point of the first plane; marks stand for themselves."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalnum():
            out[i] = DIGIT if c.isdigit() else UPPER if c.isupper() else LOWER
        elif c.isspace():
            out[i] = INNER
    return out


def portion(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct buckets of each text; a text is never cut, however long."""
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    spaced = np.where((codes >= 0x09) & (codes <= 0x0D), np.uint32(BLANK), codes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for n in CHAR_SIZES:
        found.append(grams(spaced, n, CHARS))
    kinds = np.where(codes < (1 << 16), classes()[np.minimum(codes, (1 << 16) - 1)], np.uint32(OTHER))
    kinds[starts] = BLANK
    new = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    for n in SHAPE_SIZES:
        at, bucket = grams(kinds[new], n, SHAPES)
        found.append((new[at], bucket + (1 << CHARS)))
    order = [(bucket, np.searchsorted(at, starts)) for at, bucket in found]
    again = repeats(texts)
    seen = np.zeros(WIDE, bool)
    for i in range(len(texts)):
        for bucket, bounds in order:
            seen[bucket[bounds[i] : bounds[i + 1]]] = True
        seen[WIDE - 3 :] = again[i]
        out = np.flatnonzero(seen)
        seen[out] = False
        yield out


def repeats(texts: list[str]) -> np.ndarray:
    """Whether a text holds one, two and three words in a row that each equal the word before."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    with np.errstate(over="ignore"):
        words, sizes = word_hashes(np.frombuffer(b"".join(raw), np.uint8), at, fold=False)
    out = np.zeros((len(texts), 3), bool)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    same[first[first < len(same)]] = False
    owner = np.repeat(np.arange(len(texts)), sizes)
    run = same
    for k in range(3):
        out[owner[run], k] = True
        run = np.concatenate([[False], run[:-1]]) & same
    return out


def buckets(texts: list[str]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > AT_ONCE:
            yield from portion(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield from portion(held)


def sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """(doc_id, text, y, weight): at most so many labelled rows a class; weight is how many labels of its class a row stands for.

    The ids are bounded by the parameter, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    known = checkpointed(known)
    by_hash = F.xxhash64("doc_id", F.lit(13))
    parts = []
    for y in (0, 1):
        mine = known.where(F.col("y") == y)
        weight = max(1.0, mine.count() / most_rows)
        parts.append(mine.orderBy(by_hash, "doc_id").limit(most_rows).withColumn("weight", F.lit(weight)))
    return docs.select("doc_id", "text").join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")


def vectorised(rows: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, y, weight, fold, at): the sampled rows as sets of buckets, each block in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            at = pa.array([x.astype(np.int32) for x in buckets(strings(column(batch, "text")))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "y", "weight")), at], ["doc_id", "y", "weight", "at"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, y int, weight double, at array<int>")
    by_hash = F.xxhash64("doc_id", F.lit(17))
    found = found.withColumn("fold", F.pmod(by_hash, F.lit(FOLDS)).cast("int"))
    return checkpointed(found.repartition(blocks, F.pmod(F.shiftright(by_hash, 8), F.lit(blocks))).sortWithinPartitions("doc_id", "at"))


def ratios(rows: DataFrame) -> np.ndarray:
    """Log-count ratio of every bucket: a line for the rows of all folds but each, and a last one for all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 * FOLDS, WIDE), np.int64)
        for batch in batches:
            at = column(batch, "at")
            group = 2 * column(batch, "fold").to_numpy() + column(batch, "y").to_numpy()
            owner = np.repeat(group, at.value_lengths().to_numpy())
            flat = at.flatten().to_numpy()
            for k in range(2 * FOLDS):
                sums[k] += np.bincount(flat[owner == k], minlength=WIDE)
        group, some = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(some), pa.array(sums[group, some])], ["group", "bucket", "n"])

    got = rows.select("y", "fold", "at").mapInArrow(count, "group long, bucket long, n long").groupBy("group", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((FOLDS, 2, WIDE))
    counts[got["group"].to_numpy() // 2, got["group"].to_numpy() % 2, got["bucket"].to_numpy()] = got["n"].to_numpy()
    bad, good = np.moveaxis(counts.sum(axis=0) - np.concatenate([counts, np.zeros((1, 2, WIDE))]), 1, 0)
    share = lambda n: np.log((n + 1) / (n + 1).sum(axis=1, keepdims=True))
    # in one of the labelled texts alone, an n-gram is no evidence
    return np.where(bad + good < 2, 0.0, share(good) - share(bad))


def read_rows(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
    """(id, y as -1 or 1, fold, buckets) of a partition's rows, in order."""
    out = []
    for batch in batches:
        for i, y, k, at in zip(column(batch, "doc_id").to_pylist(), column(batch, "y").to_pylist(), column(batch, "fold").to_pylist(), column(batch, "at")):
            out.append((i, 2 * y - 1, k, at.values.to_numpy() if at.is_valid else np.zeros(0, np.int32)))
    return out


def scaled(at: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets of some weight, and their scaled values."""
    at = at[ratio[at] != 0]
    return at, ratio[at] / lengths(ratio[at] ** 2, at)


def lengths(squares: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of a text's buckets the length of the values of its kind."""
    bounds = np.searchsorted(at, EDGES)
    sums = np.diff(np.concatenate([[0.0], np.cumsum(squares)])[bounds])
    return np.repeat(np.sqrt(np.maximum(sums, 1e-12)), np.diff(bounds))


def descend(rows: list[tuple], w: np.ndarray, alpha: np.ndarray, cost: tuple[float, float], blocks: int, turns: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's new dual variables, and its own change of the weights, by turns of coordinate descent over (y, buckets, values).

    Each step is the exact minimum of a row's part of the dual with its square term times the number
    of blocks, which keeps the sum of all blocks' changes from overshooting. The last weight is the bias.
    """
    local, own = w.copy(), np.zeros_like(w)
    alpha = alpha.copy()
    draw = np.random.default_rng(seed)
    for _ in range(turns):
        for i in draw.permutation(len(rows)):
            y, at, value = rows[i]
            slack = 1 - y * (float(local[at] @ value) + local[-1])
            new = min(max(alpha[i] + slack / ((float(value @ value) + 1) * blocks), 0.0), cost[y > 0])
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                local[at] += blocks * step * value
                local[-1] += blocks * step
                own[at] += step * value
                own[-1] += step
    return alpha, own


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS, blocks: int = BLOCKS, cost: float = 1.0, rounds: int = 8, turns: int = 2) -> Model:
    """The model from (doc_id, text) rows and (doc_id, label) rows."""
    rows = vectorised(sample(docs, labels, label, most_rows), blocks)
    seen = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    total = [sum(n for (_, y), n in seen.items() if y == k) for k in (0, 1)]
    if not all(total):
        return Model(np.zeros(WIDE), np.zeros(WIDE), 0.0, 0.0, 50.0 if total[1] else -50.0)
    # both classes weigh alike
    costs = tuple(cost * sum(total) / (2 * n) for n in total)
    ratio, w, alphas = ratios(rows), np.zeros((FOLDS + 1, WIDE + 1)), {}
    sc = rows.sparkSession.sparkContext
    # only buckets of some weight, and the bias, go to the tasks
    some = np.append(np.flatnonzero(ratio.any(axis=0)), WIDE)
    fixed = sc.broadcast((some, ratio[:, some[:-1]].astype(np.float32)))
    for turn in range(rounds):
        shared = sc.broadcast((w[:, some].astype(np.float32), alphas))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            some, part = fixed.value
            ratio, w = np.zeros((FOLDS + 1, WIDE)), np.zeros((FOLDS + 1, WIDE + 1))
            ratio[:, some[:-1]] = part
            w[:, some], alphas = shared.value
            mine = read_rows(batches)
            for k in range(FOLDS + 1) if mine else ():
                fitted = [(y, *scaled(at, ratio[k])) for _, y, fold, at in mine if fold != k]
                # a block is known by its first id, as a lost task may be run again elsewhere
                name = f"{k}:{mine[0][0]}"
                alpha, own = descend(fitted, w[k], alphas.get(name, np.zeros(len(fitted))), costs, blocks, turns, turn)
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([name]), pa.array([alpha]), pa.array([at.astype(np.int32)]), pa.array([own[at].astype(np.float32)])], ["model", "block", "alpha", "at", "own"])

        # changes of the weights come to the driver unshuffled: one line a block and model, of at most WIDE + 1 values
        done = rows.select("doc_id", "y", "fold", "at").mapInArrow(run, "model long, block string, alpha array<double>, at array<int>, own array<float>").toArrow().sort_by("block")
        for k, block, alpha, at, own in zip(*(done[c] for c in ("model", "block", "alpha", "at", "own"))):
            alphas[block.as_py()] = alpha.values.to_numpy()
            w[k.as_py()][at.values.to_numpy()] += own.values.to_numpy()
        shared.destroy()
    models = [Model(w[k][:-1] * ratio[k], ratio[k] ** 2, float(w[k][-1]), 1.0, 0.0) for k in range(FOLDS + 1)]
    models[-1].slope, models[-1].shift = curve(rows, models[:-1])
    return models[-1]


def curve(rows: DataFrame, models: list[Model]) -> tuple[float, float]:
    """Slope and shift of the logistic curve from the margin of each row, by the model that was fitted without its fold, to labels; by Newton steps."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [margins([at], shared.value[k])[0] for _, _, k, at in read_rows([batch])]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), column(batch, "y"), column(batch, "weight")], ["z", "y", "weight"])

    got = rows.select("doc_id", "y", "weight", "fold", "at").mapInArrow(run, "z double, y int, weight double").toArrow().sort_by([("z", "ascending"), ("y", "ascending")])
    z, y, weight = (got[c].to_numpy().astype(float) for c in ("z", "y", "weight"))
    # labels a little inside 0 and 1, so that classes that do not overlap have a curve too
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    aim = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([z, np.ones_like(z)])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -35, 35)))
        h = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x @ (weight * (aim - p)) - 1e-6 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def margins(sets: Iterator[np.ndarray], model: Model) -> list[float]:
    return [float((model.weights[at] / lengths(model.squares[at], at)).sum()) + model.bias for at in sets]


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The rows, or the named columns of them, with a score from 0 to 1, in one pass without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(out)
    names = [c for c in rest.columns if keep is None or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in bounded(batches, text):
            z = np.array(margins(buckets(strings(column(batch, text))), model), float)
            p = 1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(p, pa.float64())], [*names, out])

    return rest.mapInArrow(run, rest.select(*names).schema.add(out, "double"))


def op13_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(docs, 0, 5)))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(~fold(docs, 0, 5), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
