"""Periodic runs of words, found by seeds that are extended along diagonals of equal lag.

A run of period q and length L >= max(12, 2q) has L - q words in a row that equal the word q places
on. Lags are handled in bands: 1 to 11, then 12 to 23, 24 to 47 and so on, each band twice as wide as
the one before. The least overlap that a band guarantees (6 words in the first, its smallest lag in
the others) holds a k-gram of half its length that starts at a multiple of k. So the k-grams of a
band are indexed by content, those that occur once in their text are left out, and each one at a
multiple of k is paired with its occurrences in the same text at the band's lags: at most 4 pairs a
word and band, whatever the text. A pair is a seed of its lag's diagonal. Seeds that follow one
another k apart on a lag are covered by one extension, as are seeds behind the furthest place that a
lag has reached; a seed inside a run whose period divides its lag is part of that run and is not
extended. As lags come in rising order, a stretch that was found before with the same bounds has the
smaller period.

Texts of a batch stand one after another in one array of word numbers, with a number of its own
between any two, so no k-gram and no diagonal passes from one text to the next. Memory is linear in
the largest batch or text; nothing is shuffled.

Defined results: null and empty texts have no words and no runs; rows without id are handled like
the others; repeated rows have a result each; equally long runs are ordered by start, then period;
very long texts are cut into words in pieces at blanks and handled whole; empty tables give empty
tables; extra columns do not matter, and those named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded, column, table
from sparkloom.llm.shingles import mixed

#: Least length of a run; least repeats of its period.
LEAST, TIMES = 12, 2
#: Words of a k-gram, and lags, of the first band.
FIRST_K, FIRST_LAGS = 3, (1, 11)
BLANK = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: What the operator adds to a row: words dropped from a text are those of its runs after their first period.
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Words:
    """Numbers of words, as they are first seen, and the words of the numbers."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def of(self, text: bytes) -> np.ndarray:
        """The words of a text as numbers; long texts are cut into pieces where a blank stands."""
        parts, at = [], 0
        while at < len(text):
            cut = BLANK.search(text, at + PIECE) if len(text) - at > PIECE else None
            stop = cut.start() if cut else len(text)
            words = text[at:stop].split()
            for w in set(words).difference(self.number):
                self.number[w] = len(self.words)
                self.words.append(w)
            parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def joined(self, numbers: np.ndarray) -> Iterator[bytes]:
        """The words of the numbers with one blank between them, in pieces."""
        for at in range(0, len(numbers), 100_000):
            yield (b" " if at else b"") + b" ".join(map(self.words.__getitem__, numbers[at : at + 100_000].tolist()))


def end_of_match(x: np.ndarray, i: int, lag: int) -> int:
    """First place from i on whose word differs from the one a lag on."""
    width, n = 16, len(x) - lag
    while i < n:
        stop = min(i + width, n)
        differ = x[i:stop] != x[i + lag : stop + lag]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, width = stop, 2 * width
    return i


def start_of_match(x: np.ndarray, i: int, lag: int) -> int:
    """Smallest s so that the words from s to i - 1 equal those a lag on."""
    width = 16
    while i > 0:
        start = max(0, i - width)
        differ = (x[start:i] != x[start + lag : i + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, width = start, 2 * width
    return i


def seeds(x: np.ndarray, text_of: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, lags) of each band: places of k-grams at multiples of k that occur again in their text a lag on, ordered by lag and place."""
    k, (low, high) = FIRST_K, FIRST_LAGS
    if len(x) < LEAST:
        return
    # names of k-grams; the number of the text is part of them, so that only one text's are alike
    value = x.astype(np.uint64)
    name = mixed(value + (text_of.astype(np.uint64) + np.uint64(1)) * _STEP)[: len(x) - k + 1]
    for j in range(1, k):
        name = mixed(name * _STEP + value[j : j + len(name)])
    alive = np.arange(len(name))
    while low <= longest // TIMES and len(alive):
        names = name[alive]
        order = np.argsort(names, kind="stable")
        names = names[order]
        new = np.concatenate([[True], names[1:] != names[:-1]])
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1
        # the index: k-grams that occur more than once, one after another, each with its places in order
        places, group = alive[order[again]], group[again]
        if not len(places):
            return
        key = group * (len(x) + 1) + places
        at = np.flatnonzero(places % k == 0)
        first = np.searchsorted(key, key[at] + low)
        # never beyond the places of the same k-gram
        last = np.searchsorted(key, np.minimum(key[at] + high, (group[at] + 1) * (len(x) + 1) - 1), side="right")
        n = np.maximum(last - first, 0)
        start = np.repeat(places[at], n)
        other = places[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        lag = other - start
        sort = np.lexsort((start, lag))
        yield k, start[sort], lag[sort]
        # a k-gram of twice the length occurs twice only where both its halves do
        alive = np.sort(places)
        known = np.zeros(len(name) + k, bool)
        known[alive] = True
        size = max(0, len(name) - k)
        alive = alive[alive < size]
        alive = alive[known[alive + k]]
        longer = np.zeros(size, np.uint64)
        longer[alive] = mixed(name[alive] * _STEP + name[alive + k])
        name, k = longer, 2 * k
        low, high = high + 1, 2 * high + 1


def runs(x: np.ndarray, text_of: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    # the run that reaches furthest over each place: where it ends, and its period
    reach, period = np.zeros(len(x) + 1, np.int64), np.ones(len(x) + 1, np.int64)
    for k, start, lag in seeds(x, text_of, longest):
        inside = (reach[start] >= start + lag + k) & (lag % period[start] == 0)
        start, lag = start[~inside], lag[~inside]
        # a seed k words after another of its lag lies on the same stretch
        first = np.ones(len(start), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (start[1:] != start[:-1] + k)
        furthest: dict[int, int] = {}
        for i, d in zip(start[first].tolist(), lag[first].tolist()):
            if furthest.get(d, -1) >= i or (reach[i] >= i + d + k and d % period[i] == 0):
                continue
            end = end_of_match(x, i, d)
            furthest[d] = end
            begin = start_of_match(x, i, d)
            length = end - begin + d
            if length >= max(LEAST, TIMES * d) and (begin, length) not in found:
                found[begin, length] = d
                part = slice(begin, begin + length)
                further = reach[part] < begin + length
                period[part][further] = d
                reach[part][further] = begin + length
    out = np.array([(s, n, q) for (s, n), q in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def portions(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another with a number of its own behind each; the text of each place; where texts start."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    parts: list[np.ndarray] = []
    for i, t in enumerate(texts):
        parts += [t, np.array([-1 - i], np.int64)]
    return np.concatenate(parts), np.repeat(np.arange(len(texts)), sizes + 1), starts


def planted(numbers: np.ndarray, key: int) -> np.ndarray:
    """A text's words as the query's contract takes them: from a place on, one in ten texts repeats a stretch."""
    g, n = key // 10, len(numbers)
    if key % 10 or not n:
        return numbers
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = numbers.copy()
    out[a:] = numbers[a + np.arange(n - a) % p]
    return out


def find(docs: DataFrame, text: str = "text", key: str | None = None, digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """The rows, or the named columns of them, with the number of words of their text, its runs, and the text without the words that runs repeat.

    With a key, a column of non-negative numbers, words are first replaced as in `planted` (null: as
    they are). With digest, the collapsed text is given as its SHA-256 alone.
    """
    rest = docs.drop("n_words", "runs", "collapsed")
    names = [c for c in rest.columns if keep is None or c in keep]
    schema = rest.select(*names).schema
    for field in rest.sparkSession.createDataFrame([], FOUND).schema:
        schema = schema.add(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words()
        texts = [words.of((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in column(batch, text)]
        if key is not None:
            texts = [t if h is None else planted(t, h) for t, h in zip(texts, column(batch, key).to_pylist())]
        x, text_of, starts = portions(texts)
        found = runs(x, text_of, max(map(len, texts)))
        owner = text_of[found[:, 0]]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        listed, collapsed = [], []
        for i, numbers in enumerate(texts):
            mine = found[bounds[i] : bounds[i + 1]] - np.array([starts[i], 0, 0])
            listed.append([{"start": s, "length": n, "period": q} for s, n, q in mine.tolist()])
            if len(mine):
                edge = np.zeros(len(numbers) + 1, np.int64)
                np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
                np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
                numbers = numbers[np.cumsum(edge)[:-1] == 0]
            if digest:
                sha = hashlib.sha256()
                for piece in words.joined(numbers):
                    sha.update(piece)
                collapsed.append(sha.hexdigest())
            else:
                collapsed.append(b"".join(words.joined(numbers)).decode("utf-8", "surrogatepass"))
        added = [pa.array([len(t) for t in texts], pa.int64()), pa.array(listed, kind), pa.array(collapsed, pa.string())]
        return pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), *added], [*names, "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text, 2_000_000):
            if batch.num_rows:
                yield handle(batch)

    return rest.mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("key"))
    found = find(docs, key="key", digest=True, keep=["doc_id"])
    # the greatest of (length, -start, -period)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
