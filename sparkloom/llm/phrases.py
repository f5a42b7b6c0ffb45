"""Phrase collocations: suffix pointers sorted by multikey three-way quicksort, where equal partitions are counts.

Texts are lower-cased (A-Z), split at marks into pieces and these into words; everything is counted
for each language. A phrase is 2 to `longest` words of a piece that occur `least` times or more. Four
passes over the texts, each adding up in its task before anything is shuffled:

1. words, and the number of words of each language;
2. leading words: pairs of words that are both frequent, then triples of two such pairs, as slots of 40
   bits. A slot's count is that of its pairs together, so those of a slot below `least` are surely not
   frequent; the counts of pairs route the last pass;
3. suffixes: every place where a pair of a frequent slot starts gives a suffix, as far as triples of
   such slots follow, of `longest` words at most. It is sent to the partition of its leading pair. A pair
   that is too large for one partition is dealt by three leading words, or more while the pairs that
   follow are as large.

Each partition sorts pointers to its suffixes by three-way quicksort, a word at a time: the suffixes
that equal the pivot word are one phrase and go on with the next word, and a partition of fewer than
`least` occurrences is left. Phrases of pairs that were dealt by more words are added up afterwards.

The bitmaps of frequent words and pairs that tasks get are sized by their number up to a fixed size; a
full one lets more suffixes through and leaves out none. Words are known by 64-bit hashes that hold
the language; phrases are compared by those of all their words.

Defined results: null texts are empty, null languages are `und` and counted with texts of that
language; repeated rows count each; equal scores and counts are ordered by phrase in UTF-8 byte order,
equal cuts by their place; long texts are read whole; empty tables and texts without frequent phrases
give an empty table; extra columns do not matter. Counts may reach 10^16.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded, checkpointed, column, table
from sparkloom.llm.shingles import mixed

LEAST, LONGEST, MOST = 100, 5, 2_000
UNKNOWN = "und"
#: A byte that UTF-8 does not use, for the marks that end a piece.
END = b"\xff"
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", END * 10)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words that a task keeps numbers of, and rows that it adds up, before it hands on what it has; bits of a bitmap; bits of one row of it.
KNOWN, HELD, MOST_BITS, PAGE = 200_000, 600_000, 1 << 28, 1 << 15
#: Bits of a pair's slot.
SLOT = 40
#: Occurrences of pairs that one partition of suffixes is planned for.
OF_PARTITION = 4_000_000
#: Tasks for each core that make suffixes.
OF_CORE = 2


def lang_seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed) or 1


class Lexicon:
    """Words of one language as they are first seen in a task: number, hash, and whether they may be frequent.

    Number 0 ends a piece. With a bitmap of frequent words all others have number 1, and are forgotten
    when they are many, so that the numbers of frequent words hold for the whole task.
    """

    def __init__(self, lang: str, often: np.ndarray | None) -> None:
        self.seed = lang_seed(lang)
        self.often_bits = often
        self.words: list[bytes] = [END, b""]
        self.number: dict[bytes, int] = {END: 0}
        self.hashes = np.zeros(2, np.uint64)
        self.often = np.zeros(2, bool)

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        """The words of the texts, each piece ended by 0."""
        tokens = (END.join(texts) + END).lower().translate(_MARKS).replace(END, b" " + END + b" ").split()
        if len(self.number) - len(self.words) > KNOWN:
            self.number = {END: 0} | dict(zip(self.words[2:], range(2, len(self.words))))
        new = list(set(tokens).difference(self.number))
        hashes = np.fromiter((word_hash(w, self.seed) for w in new), np.uint64, len(new))
        often = np.ones(len(new), bool) if self.often_bits is None else held(self.often_bits, hashes)
        self.number.update(zip(new, np.where(often, len(self.words) + np.cumsum(often) - 1, 1).tolist()))
        self.words += [w for w, o in zip(new, often.tolist()) if o]
        self.hashes = np.concatenate([self.hashes, hashes[often]])
        self.often = np.concatenate([self.often, often[often]])
        return np.fromiter(map(self.number.__getitem__, tokens), np.int32, len(tokens))


class Sums:
    """Counts of rows of numbers, added up in bounded memory."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: np.ndarray, n: np.ndarray | None = None) -> None:
        if not len(rows):
            return
        key = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            key = mixed(key * _STEP + rows[:, k].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n[order], first)
        self.parts.append((rows[order[first]].astype(np.int32), n.astype(np.int64)))
        self.size += len(first)
        if self.size > HELD:
            self.compact()

    def compact(self) -> None:
        """Counts of equal rows become one."""
        if len(self.parts) > 1:
            rows, n = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.size = [], 0
            self.add(rows, n)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.compact()
        (rows, n), self.parts, self.size = self.parts[0], [], 0
        return rows, n


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _STEP + b)


def triple_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mixed(pair_hash(a, b) * _STEP + c)


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the slot of each hash is set."""
    slot = (hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def bitmap(rows: DataFrame, count: int) -> np.ndarray:
    """Bits of a size that suits so many rows, up to MOST_BITS, with the places of the rows' hashes set."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (256 * count).bit_length()))
    shift = np.uint64(64 - size.bit_length() + 1)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = (batch.column(0).to_numpy().view(np.uint64) >> shift).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot // PAGE), pa.array(slot % PAGE)], ["page", "at"])

    pages = rows.mapInArrow(slots, "page long, at long").groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
    out = np.zeros(size // 8, np.uint8)
    for page, bits in zip(pages["page"].to_pylist(), pages["bits"].to_pylist()):
        part = np.frombuffer(bits, np.uint8)[: PAGE // 8]
        out[page * PAGE // 8 : page * PAGE // 8 + len(part)] = part
    return out


def through_texts(docs: DataFrame, often, count: Callable, emit: Callable, schema: str) -> DataFrame:
    """One pass: count(lexicon, numbers, sums) for the texts of each language and slice, then emit(lang, lexicon, sums) as batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if often is None else often.value
        state: dict[str, tuple[Lexicon, Sums]] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            lexicon, sums = state.pop(lang)
            if sums.size:
                yield from emit(lang, lexicon, sums)

        for batch in bounded(batches, most=1_000_000):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(column(batch, "lang").to_pylist(), column(batch, "text")):
                if text.is_valid:
                    by_lang.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            for lang, texts in by_lang.items():
                lexicon, sums = state.setdefault(lang, (Lexicon(lang, bits), Sums()))
                count(lexicon, lexicon.numbers(texts), sums)
            # what a task holds is bounded over all its languages together; it adds up before it hands on
            if sum(s.size for _, s in state.values()) > HELD:
                for _, s in state.values():
                    s.compact()
            while sum(len(x.words) for x, _ in state.values()) > KNOWN or sum(s.size for _, s in state.values()) > HELD or len(state) > 256:
                yield from flush(max(state, key=lambda x: len(state[x][0].words) + state[x][1].size))
        for lang in list(state):
            yield from flush(lang)

    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(run, schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, word, h, n) of frequent words with their hash; with a null word, the number of words of a language."""

    def count(lexicon: Lexicon, x: np.ndarray, sums: Sums) -> None:
        n = np.bincount(x, minlength=len(lexicon.words))
        n[:2] = 0
        at = np.flatnonzero(n)
        sums.add(at[:, None], n[at])

    def emit(lang: str, lexicon: Lexicon, sums: Sums) -> Iterator[pa.RecordBatch]:
        rows, n = sums.take()
        n = np.bincount(rows[:, 0], n, len(lexicon.words)).astype(np.int64)
        at = np.flatnonzero(n)
        words = [lexicon.words[i].decode() for i in at]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array([*words, None], pa.string()), pa.array(np.append(n[at], n.sum()))], ["lang", "word", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [0 if word is None else word_hash(word.encode(), lang_seed(lang)) for lang, word in zip(column(batch, "lang").to_pylist(), column(batch, "word").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, _signed(np.array(h, np.uint64))], [*batch.schema.names, "h"])

    found = through_texts(docs, None, count, emit, "lang string, word string, n long")
    frequent = found.groupBy("lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull())
    return frequent.mapInArrow(hashed, "lang string, word string, n long, h long")


def linked(lexicon: Lexicon, x: np.ndarray, pairs: np.ndarray, triples: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether a pair, and a triple, of a frequent slot starts at each place; without a bitmap of triples, one of two such pairs."""
    good, h = lexicon.often[x], lexicon.hashes
    two, three = np.zeros(len(x), bool), np.zeros(len(x), bool)
    at = np.flatnonzero(good[:-1] & good[1:])
    two[at[held(pairs, pair_hash(h[x[at]], h[x[at + 1]]))]] = True
    at = np.flatnonzero(two[:-1] & two[1:])
    three[at if triples is None else at[held(triples, triple_hash(h[x[at]], h[x[at + 1]], h[x[at + 2]]))]] = True
    return two, three


def slot_counts(docs: DataFrame, often, pairs, least: int) -> DataFrame:
    """(slot, n): slots that occur often enough, of pairs of frequent words, or with a bitmap of pairs of triples; a slot is the leading bits of the hash."""

    def count(lexicon: Lexicon, x: np.ndarray, sums: Sums) -> None:
        if pairs is None:
            good = lexicon.often[x]
            at, size = np.flatnonzero(good[:-1] & good[1:]), 2
        else:
            at, size = np.flatnonzero(linked(lexicon, x, pairs.value)[1]), 3
        if len(at):
            sums.add(np.stack([x[at + k] for k in range(size)], axis=1))

    def emit(lang: str, lexicon: Lexicon, sums: Sums) -> Iterator[pa.RecordBatch]:
        rows, n = sums.take()
        name = pair_hash if rows.shape[1] == 2 else triple_hash
        for at in range(0, len(rows), 200_000):
            h = lexicon.hashes[rows[at : at + 200_000]]
            yield pa.RecordBatch.from_arrays([pa.array(slots_of(name(*h.T))), pa.array(n[at : at + 200_000])], ["slot", "n"])

    found = through_texts(docs, often, count, emit, "slot long, n long")
    return found.groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT)).astype(np.int64)


def leading(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """How many leading words route each suffix (rows of hashes): two, and one more for each large pair in a row from the start."""
    out = np.full(len(h), 2)
    more = np.ones(len(h), bool)
    for k in range(h.shape[1] - 2):
        more = more & np.isin(slots_of(pair_hash(h[:, k], h[:, k + 1])), hot)
        out += more
    return np.minimum(out, h.shape[1])


def suffixes(docs: DataFrame, often, pairs, triples, hot, longest: int) -> DataFrame:
    """(h0, h1, ..., n, route): suffixes of two words or more along frequent slots, as hashes, 0 where they end, how often, and what deals them."""
    names = [f"h{k}" for k in range(longest)]

    def count(lexicon: Lexicon, x: np.ndarray, sums: Sums) -> None:
        two, three = linked(lexicon, x, pairs.value, triples.value if triples else None)
        at = np.flatnonzero(two)
        if not len(at):
            return
        three = np.append(three, np.zeros(longest, bool))
        out = np.zeros((len(at), longest), np.int32)
        out[:, 0], out[:, 1] = x[at], x[at + 1]
        more = np.ones(len(at), bool)
        for k in range(2, longest):
            more = more & three[at + k - 2]
            out[more, k] = x[at[more] + k]
        sums.add(out)

    def emit(lang: str, lexicon: Lexicon, sums: Sums) -> Iterator[pa.RecordBatch]:
        rows, n = sums.take()
        for at in range(0, len(rows), 100_000):
            h = lexicon.hashes[rows[at : at + 100_000]]
            used = leading(h, hot.value)
            route = np.zeros(len(h), np.uint64)
            for k in range(longest):
                route = np.where(k < used, mixed(route * _STEP + h[:, k]), route)
            yield pa.RecordBatch.from_arrays([*(_signed(h[:, k]) for k in range(longest)), pa.array(n[at : at + 100_000]), _signed(route)], [*names, "n", "route"])

    # each task hands on every frequent phrase that it meets, so more tasks would mean more rows for the same texts
    docs = docs.coalesce(OF_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    return through_texts(docs, often, count, emit, ", ".join(f"{c} long" for c in [*names, "n", "route"]))


def multikey_quicksort(h: np.ndarray, n: np.ndarray, least: int, whole: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, words, occurrences) of each phrase of two words or more among suffixes (rows of hashes, 0 where they end).

    Pointers are parted by a pivot word into smaller, equal and larger; equal ones go on with the next
    word. Parts of fewer occurrences than `least` are left, but where `whole` says that a phrase of so
    many words is not wholly in this partition: such are given with what is here.
    """
    depth_of = h.shape[1]
    stack = [(np.arange(len(h)), 0)]
    while stack:
        at, depth = stack.pop()
        word = h[at, depth]
        pivot = word[len(word) // 2]
        equal = word == pivot
        smaller = word < pivot
        if not equal.all():
            for part in (at[smaller], at[~smaller & ~equal]):
                if len(part) and (n[part].sum() >= least or (whole[part] > max(2, depth + 1)).any()):
                    stack.append((part, depth))
        at = at[equal]
        if not pivot:
            continue
        words = depth + 1
        occurrences = int(n[at].sum())
        if occurrences < least and (whole[at] <= max(2, words)).all():
            continue
        if words >= 2:
            yield int(at[0]), words, occurrences
        if words < depth_of:
            stack.append((at, words))


def sorted_counts(rows: DataFrame, hot, longest: int, least: int) -> DataFrame:
    """(words, a) of the frequent phrases; words are hashes."""
    names = [f"h{k}" for k in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.stack([column(b, c).to_numpy().view(np.uint64) for c in names], axis=1), column(b, "n").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        out: list[tuple[list[int], int]] = []
        for row, words, occurrences in multikey_quicksort(h, n, least, leading(h, hot.value)):
            out.append((h[row, :words].view(np.int64).tolist(), occurrences))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.list_(pa.int64())), pa.array([a for _, a in out], pa.int64())], ["words", "a"])

    found = rows.mapInArrow(run, "words array<long>, a long")
    # a phrase that was dealt over partitions comes from each of them
    return found.groupBy("words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def counted(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, h, n) as from word_counts, and (words, a) of all frequent phrases; both written."""
    sc = docs.sparkSession.sparkContext
    words = checkpointed(word_counts(docs, least))
    known = words.where("word is not null")
    often = sc.broadcast(bitmap(known.select("h"), known.count()))
    slots = checkpointed(slot_counts(docs, often, None, least))
    count, total = slots.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs, triples = sc.broadcast(bitmap(slots.select(F.shiftleft("slot", 64 - SLOT)), count)), None
    if longest > 2:
        more = checkpointed(slot_counts(docs, often, pairs, least))
        triples = sc.broadcast(bitmap(more.select(F.shiftleft("slot", 64 - SLOT)), more.count()))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // OF_PARTITION))
    # so many occurrences that there are at most four large slots for each partition
    large = max(least, total // (4 * parts))
    hot = sc.broadcast(np.sort(slots.where(F.col("n") > large).select("slot").toArrow()["slot"].to_numpy()))
    dealt = suffixes(docs, often, pairs, triples, hot, longest).repartition(parts, "route").drop("route")
    return words, checkpointed(sorted_counts(dealt, hot, longest, least))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language, from (lang, text) rows.

    A phrase is cut in two where 1000 * a * n / (l * r), rounded down, is least; l and r are the counts
    of its parts. It is left out where a longer phrase holds it and is as frequent.
    """
    words, phrases = counted(docs, least, longest)
    known = words.where("word is not null")
    counts = phrases.unionAll(known.select(F.array("h").alias("words"), F.col("n").alias("a")))
    size = F.size("words")
    # a longer phrase as frequent holds one of a single word more that is
    holding = phrases.where(size > 2).select(F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), F.col("a").alias("longer"))
    holding = holding.groupBy("words").agg(F.max("longer").alias("longer"))
    kept = phrases.join(holding, "words", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).select("words", "a")
    totals = words.where("word is null").select(F.col("lang").alias("of"), F.col("n").alias("total"))
    langs = known.select(F.col("h").alias("first"), "lang").join(totals, F.col("lang") == F.col("of")).select("first", "lang", F.col("total").alias("n"))
    kept = kept.join(langs, F.col("words")[0] == F.col("first")).drop("first")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("words").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("words").alias("right"), F.col("a").alias("r")), "right")
    # products of up to 38 digits
    score = F.expr("(cast(a as decimal(16,0)) * 1000 * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("words", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("words", "a", "lang", "n", "cut.score", "cut.l", "cut.r")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = best.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= most).drop("place")
    # words of the best phrases alone
    spelled = best.select("words", F.posexplode("words").alias("at", "h")).join(known.select("h", "word"), "h").groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = best.join(spelled, "words").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), suffixes AS (
  SELECT lang, w[i : i + 4] AS s FROM placed
), grams AS (
  SELECT lang, m, s[1:m] AS words, count(*) AS f FROM suffixes, range(1, 6) AS t(m) WHERE len(s) >= m GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang
), longer AS (
  SELECT lang, words, max(f) AS f FROM (
    SELECT lang, words[1 : m - 1] AS words, f FROM grams WHERE m > 2 UNION ALL SELECT lang, words[2 : m] AS words, f FROM grams WHERE m > 2
  ) GROUP BY ALL
), cuts AS (
  SELECT g.lang, g.words, g.f AS a, t.n, k, x.f AS l, y.f AS r, (1000 * g.f::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM grams g JOIN totals t ON t.lang = g.lang, range(1, 5) AS c(k), grams x, grams y
  WHERE g.m > 1 AND k < g.m AND x.lang = g.lang AND x.words = g.words[1 : k] AND y.lang = g.lang AND y.words = g.words[k + 1 : g.m]
    AND NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = g.lang AND o.words = g.words AND o.f >= g.f)
), best AS (
  SELECT *, array_to_string(words, ' ') AS phrase FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
