"""Language identification by the nearest of several centroids per language.

A text's vector holds its hashed n-grams of one to three letters, word ends marked: log frequency
times inverse document frequency, normalised. Document frequencies are counted over all training
rows. Each language's centroids come from spherical k-means over a bounded sample of its rows: those
of the smallest hashes, at most `most_rows` in all languages together. A text takes the language of
the centroid of largest cosine; it is marked as rejected where that cosine falls below what nearly
all of that centroid's own rows reach.

Defined results: null texts and texts without letters give `und` with score 0 and are rejected, and
so does every text where nothing could be learned; rows without lang are not learned from; equal
cosines give the language that sorts first; empty tables give empty tables; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded, column, fold, strings, table
from sparkloom.llm.ngrams import BLANK, grams
from sparkloom.llm.pretok import EEE, ELL, LETTER, RV, STMD, codepoint_classes

BITS, SIZES = 12, (1, 2, 3)
WIDE = 1 << BITS
#: Sampled rows of a language, and of all languages together, that centroids are fitted on at most.
MOST_OF_ONE, MOST_ROWS = 1_000, 20_000
CENTROIDS, ROUNDS = 4, 10
#: A text is rejected below this quantile of its centroid's own rows, times the slack.
QUANTILE, SLACK = 0.01, 0.8
UNKNOWN = "und"


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    floors: np.ndarray


def counts(texts: list[str], docs: int = 128, chars: int = 1_000_000) -> Iterator[np.ndarray]:
    """Matrices of n-gram counts, one row a text, for consecutive runs of the texts."""
    letter = np.isin(np.arange(16), (LETTER, STMD, RV, ELL, EEE))[codepoint_classes()]
    run: list[str] = []
    for text in [*texts, None]:
        if run and (text is None or len(run) == docs or sum(map(len, run)) > chars):
            sizes = np.array([len(t) + 1 for t in run])
            codes = np.frombuffer((" " + " ".join(run) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.where(letter[codes], codes, np.uint32(BLANK))
            owner = np.append(np.repeat(np.arange(len(run)), sizes), len(run) - 1)
            out = np.zeros(len(run) * WIDE, np.int64)
            for n in SIZES:
                at, bucket = grams(codes, n, BITS)
                out += np.bincount(owner[at] * WIDE + bucket, minlength=len(out))
            yield out.reshape(len(run), WIDE)
            run = []
        if text is not None:
            run.append(text.lower())


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = (np.log1p(found) * idf).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Texts with each feature, and the number of texts, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(WIDE + 1, np.int64)
        for batch in bounded(batches):
            for found in counts(strings(column(batch, "text"))):
                sums[:WIDE] += (found > 0).sum(axis=0)
                sums[WIDE] += len(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDE + 1)), pa.array(sums)], ["bucket", "texts"])

    got = rows.mapInArrow(count, "bucket long, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts")).toArrow()
    out = np.zeros(WIDE + 1)
    out[got["bucket"].to_numpy()] = got["texts"].to_numpy()
    return out[:WIDE], int(out[WIDE])


def sample(rows: DataFrame, most_of_one: int, most_rows: int) -> tuple[list[str], np.ndarray]:
    """Languages and n-gram counts of the sampled rows, hashed evenly from each language."""
    per_lang = rows.groupBy("lang").agg(F.count("*").alias("n"))
    langs = per_lang.agg(F.count("*")).first()[0]
    share = F.least(F.lit(1.0), F.lit(min(most_of_one, most_rows // max(langs, 1))) / F.col("n"))
    by_hash = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    # one row a language: broadcast, so that no text is shuffled
    chosen = rows.join(F.broadcast(per_lang.withColumnsRenamed({"lang": "of"})), F.col("lang") == F.col("of")).where(by_hash < share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            texts, lists = strings(column(batch, "text")), []
            for found in counts(texts):
                lists += [(np.flatnonzero(x).astype(np.int32), x[x > 0].astype(np.int32)) for x in found]
            yield pa.RecordBatch.from_arrays([column(batch, "lang"), column(batch, "h"), *(pa.array([x[k] for x in lists], pa.list_(pa.int32())) for k in (0, 1))], ["lang", "h", "at", "n"])

    got = chosen.select("lang", "text", by_hash.alias("h")).mapInArrow(count, "lang string, h long, at array<int>, n array<int>").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    out = np.zeros((len(got), WIDE), np.int32)
    for row, at, n in zip(out, got["at"].to_pylist(), got["n"].to_pylist()):
        row[at] = n
    return got["lang"].to_pylist(), out


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from the mean row and, in turn, the row furthest from all before."""
    mean = x.mean(axis=0)
    at = [int((x @ mean).argmax())]
    while len(at) < k:
        at.append(int((x @ x[at].T).max(axis=1).argmin()))
    c = x[at]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: DataFrame, most_of_one: int = MOST_OF_ONE, most_rows: int = MOST_ROWS, k: int = CENTROIDS) -> Model:
    """From (doc_id, text, lang) rows."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    texts, n = document_frequencies(rows)
    langs, found = sample(rows, most_of_one, most_rows)
    idf = np.log((1 + n) / (1 + texts)) + 0.1
    centroids, names, floors = [], [], []
    for lang in sorted(set(langs)):
        x = vectors(found[[i for i, other in enumerate(langs) if other == lang]], idf)
        c = k_means(x, max(1, min(k, len(x) // 8)))
        best = (x @ c.T).max(axis=1)
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            centroids.append(c[j])
            names.append(lang)
            floors.append(SLACK * float(np.quantile(best[near == j], QUANTILE)) if (near == j).any() else 0.0)
    return Model(idf, np.array(centroids, np.float32).reshape(-1, WIDE), names, np.array(floors))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of every row, in one pass without shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in bounded(batches):
            start = 0
            for found in counts(strings(column(batch, "text"))):
                some = found.any(axis=1)
                if model.langs:
                    near = vectors(found, model.idf) @ model.centroids.T
                    best = near.argmax(axis=1)
                    score = np.where(some, np.clip(near.max(axis=1), 0, 1), 0).astype(float)
                    lang = [model.langs[j] if ok else UNKNOWN for j, ok in zip(best, some)]
                    far = ~some | (score < model.floors[best])
                else:
                    score, lang, far = np.zeros(len(found)), [UNKNOWN] * len(found), np.ones(len(found), bool)
                yield pa.RecordBatch.from_arrays([column(batch, "key").slice(start, len(found)), pa.array(lang), pa.array(score), pa.array(far)], ["key", "lang_pred", "score", "rejected"])
                start += len(found)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(fold(docs, 2, 4)))
    held_out = F.coalesce(~fold(docs, 2, 4), F.lit(False)).alias("held_out")
    return identify(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")
