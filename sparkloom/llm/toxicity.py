"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams of its distinct words, word ends marked. Each
feature is scaled by the log of its smoothed rate in toxic over that in other labelled texts, and a
logistic regression is trained on the scaled counts. As the score is linear, a word's part of it is
a constant, kept in a bounded cache.

It is fitted on at most `most_rows` labelled rows a class, those with the smallest hashes of their
ids; the counts of that sample are summed by Spark and the model has a fixed size, so it is broadcast.

Defined results: null, empty and wordless texts get the score of a text without features; labels that are null or not
0 or 1 are not learned from, and of repeated labels of an id the smallest counts; without labels of
both classes the score is 0 for all (or 1, if all labels are 1); empty tables give empty tables;
extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded, checkpointed, column, fold, strings, table
from sparkloom.llm.ngrams import code_points, grams

BITS, SIZES = 18, (2, 3, 4, 5)
#: Labelled rows of each class that the model is fitted on at most.
MOST_ROWS = 12_000
#: Features kept: seen in so many texts of the sample, with a log ratio of at least so much. Features of other texts are
#: left out: their sum falls with a text's length and would hide toxic words in long texts.
LEAST_TEXTS, LEAST_RATIO = 3, 0.5
WORDS = re.compile(r"\w+")
MOST_CACHED = 400_000


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of all n-grams of words."""
    codes = code_points(" " + " ".join(words) + " ")
    owner = np.cumsum(codes == 0x20) - 1
    found = [grams(codes, n, BITS) for n in SIZES]
    return owner[np.concatenate([at for at, _ in found])], np.concatenate([bucket for _, bucket in found])


def distinct_words(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


class WordScores(dict):
    """Each word's part of the score, in bounded memory."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def learn(self, words: set[str]) -> None:
        if len(self) > MOST_CACHED:
            self.clear()
        new = [w for w in words if w not in self]
        if new:
            owner, bucket = word_features(new)
            self.update(zip(new, np.bincount(owner, self.weights[bucket], len(new)).tolist()))


def linear_scores(texts: list[str], scores: WordScores, chars: int = 2_000_000) -> Iterator[float]:
    """Sum of the parts of each text's distinct words."""
    batch: list[set[str]] = []
    size = 0
    for text in [*texts, None]:
        if text is None or size > chars:
            scores.learn(set().union(*batch))
            for words in batch:
                yield sum(map(scores.__getitem__, sorted(words)))
            batch, size = [], 0
        if text is not None:
            batch.append(distinct_words(text))
            size += len(text)


def sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(doc_id, text, y): labelled texts, at most so many a class, by the smallest hash of the id.

    The ids are bounded by the parameter, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("y"))
    by_hash = F.xxhash64("doc_id", F.lit(5))
    chosen = known.where("y = 1").orderBy(by_hash, "doc_id").limit(most_rows).unionAll(known.where("y = 0").orderBy(by_hash, "doc_id").limit(most_rows))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature counts in toxic and in other texts, and the number of texts with the feature."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 1 << BITS), np.int64)
        for batch in bounded(batches):
            for text, y in zip(strings(column(batch, "text")), column(batch, "y").to_pylist()):
                if words := distinct_words(text):
                    bucket = word_features(list(words))[1]
                    sums[0 if y else 1] += np.bincount(bucket, minlength=1 << BITS)
                    sums[2][np.unique(bucket)] += 1
        at = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in sums)], ["bucket", "toxic", "other", "texts"])

    summed = rows.mapInArrow(count, "bucket long, toxic long, other long, texts long").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "texts")))
    out = np.zeros((3, 1 << BITS))
    got = summed.toArrow()
    for k, name in enumerate(("toxic", "other", "texts")):
        out[k, got["bucket"].to_numpy()] = got[name].to_numpy()
    return out[0], out[1], out[2]


def _rows(rows: DataFrame, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sample as sparse rows over the kept features: row bounds, columns, counts, labels."""
    shared = rows.sparkSession.sparkContext.broadcast(kept)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value
        for batch in bounded(batches):
            out = []
            for text in strings(column(batch, "text")):
                words = distinct_words(text)
                bucket = word_features(list(words))[1] if words else np.zeros(0, np.int64)
                at, n = np.unique(bucket[keep[bucket]], return_counts=True)
                out.append((at.astype(np.int32), n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "y"), pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([n for _, n in out], pa.list_(pa.int32()))], ["doc_id", "y", "at", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(pick, f"doc_id {kind}, y int, at array<int>, n array<int>").toArrow().sort_by("doc_id").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(got["at"].combine_chunks().value_lengths().to_numpy())]) if len(got) else np.zeros(1, np.int64)
    flat = [got[c].combine_chunks().flatten().to_numpy() if len(got) else np.zeros(0, np.int32) for c in ("at", "n")]
    return bounds.astype(np.int64), flat[0], flat[1], got["y"].to_numpy()


def logistic(bounds, at, values, y, weight, size: int, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Penalised logistic regression on sparse rows by Adam over all rows."""
    owner = np.repeat(np.arange(len(y)), np.diff(bounds))
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    total = weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(owner, values * w[at], len(y)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / total
        grad, gb = np.bincount(at, values * g[owner], size) + penalty * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.05 * min(1.0, 2 * (1 - t / (rounds + 1)))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, penalty: float = 1e-5, rounds: int = 150) -> Model:
    rows = checkpointed(sample(docs, labels, most_rows))
    toxic, other, texts = _counts(rows)
    ratio = np.log((toxic + 1) / (toxic + 1).sum()) - np.log((other + 1) / (other + 1).sum())
    kept = (texts >= LEAST_TEXTS) & (ratio >= LEAST_RATIO)
    bounds, at, n, y = _rows(rows, kept)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), -50.0 if not len(y) or y[0] == 0 else 50.0)
    names = np.flatnonzero(kept)
    place = np.zeros(1 << BITS, np.int64)
    place[names] = np.arange(len(names))
    scale = ratio[names]
    w, b = logistic(bounds, place[at], n * scale[place[at]], y, np.ones(len(y)), len(names), penalty, rounds)
    weights = np.zeros(1 << BITS)
    weights[names] = w * scale
    return Model(weights, float(b))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The rows, or the named columns of them, with a score from 0 to 1, in one pass without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(out)
    names = [c for c in rest.columns if keep is None or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = WordScores(model.weights)
        for batch in bounded(batches, text):
            z = np.fromiter(linear_scores(strings(column(batch, text)), scores), float, batch.num_rows) + model.bias
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(p)], [*names, out])

    return rest.mapInArrow(run, rest.select(*names).schema.add(out, "double"))


def op3_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(docs, 1, 3)))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(~fold(docs, 1, 3), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
