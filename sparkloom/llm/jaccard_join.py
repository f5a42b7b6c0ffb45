"""N-gram Jaccard join by a token-group matrix.

Texts with equal shingle sets form one class. Classes of similar size and equal min-hash form a
group of bounded size, and the matrix holds, for every token, the groups whose union has it, with the
first place at which a member has it. A class is a query: the first tokens that it shares with a
group's union bound their overlap by their number and by what is left from there on in the query and
in the group's members. Only groups whose bound reaches what the similarity needs are opened and
their members compared on whole sets.

Members of a large cluster would each meet all of its groups. So texts that share one of two min-hashes are
compared first, in groups of bounded size that the first text of that min-hash is held against too, which ties
such groups together. What is found to be of one cluster then has one name, and no query meets a group that lies in its own.

The matrix need not hold all tokens. In any order common to all sets, x and y of the wanted
similarity share a(x, y) = ceil(t (|x| + |y|) / (1 + t)) tokens, so the first l shared ones stand among
the first |x| - a + l of x and |y| - a + l of y: with a few for l, few groups come near by chance. The
smaller of two sets is met by the larger: the matrix takes the places that a set of the same size
needs, a query those for the smallest set it can be similar to. Tokens that many texts share (common lines, copied passages) come last in the order,
the rest by hash, so that few texts meet on a token. The table of such tokens has a fixed size: those
of the highest counts. It steers the order and so the cost, never the result.

Texts of sets to be compared are found again by a bitmap of fixed size over hashes of their ids, so
that only their sets, and not all texts, are shuffled; a full bitmap would let more texts through, and
the join that follows is exact.

Defined results: A-Z count as a-z; texts of fewer words than a shingle are one shingle as a whole;
null and wordless texts have empty sets and link with nothing; rows that repeat an id are one
document, linked with all that any of them links with; rows without id have a null component; empty
tables give empty tables; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, column, table
from sparkloom.llm.shingles import batch_sets, mixed
from sparkloom.operators.graph import components

#: Frequent tokens known to all tasks at most; tokens counted together; members of a group at most;
#: queries that one task compares with a group; growth of sizes within a group; bits of the bitmap of ids; tokens in which
#: a query meets a group, where sizes allow; parts that a frequent token's texts are dealt over.
FREQUENT, COUNTED, MEMBERS, QUERIES, GROWTH, BITS, MEETINGS, SPREAD = 400_000, 4_000_000, 128, 256, 1.1, 1 << 26, 4, 64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """One pass over the texts: (id, n, f1, f2), size and fingerprint of each text's set, and, with a null n, (f1, f2) frequent tokens of a part of the texts and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n > 1
            m = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), _signed(values[often]), pa.array(n[often].astype(np.int64))], ["id", "n", "f1", "f2"])

        for batch in batches:
            n, f1, f2 = (np.zeros(batch.num_rows, t) for t in (np.int32, np.uint64, np.uint64))
            for i, s in enumerate(batch_sets(column(batch, "text"), k)):
                n[i] = len(s)
                with np.errstate(over="ignore"):
                    f1[i], f2[i] = s.sum(dtype=np.uint64), mixed(s).sum(dtype=np.uint64)
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield frequent()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(n), _signed(f1), _signed(f2)], ["id", "n", "f1", "f2"])
        yield frequent()

    return docs.mapInArrow(run, "id long, n int, f1 long, f2 long")


def frequent_tokens(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that most texts share, sorted, with their counts: as many counts from the top as the table holds."""
    sums = checkpointed(found.where("n is null").groupBy("f1").agg(F.sum("f2").alias("texts")))
    sizes = sums.groupBy("texts").agg(F.count("*").alias("tokens"))
    above = F.sum("tokens").over(Window.orderBy(F.desc("texts")))
    least = sizes.withColumn("above", above).where(F.col("above") <= FREQUENT).agg(F.min("texts")).first()[0]
    often = sums.where(F.col("texts") >= (3 if least is None else max(3, least))).toArrow() if least is not None else sums.limit(0).toArrow()
    token, texts = often["f1"].to_numpy().view(np.uint64), often["texts"].to_numpy()
    order = np.argsort(token)
    return token[order], texts[order]


def prefixes(docs: DataFrame, k: int, share: tuple[int, int], often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, n, f1, f2, near, rare, head) of every text with a set: its first tokens in the common order, those that are not known as frequent first and counted by rare, and two keys, either of which similar sets are likely to share."""
    shared = docs.sparkSession.sparkContext.broadcast(often)
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, texts = shared.value
        for batch in batches:
            ids, out = column(batch, "id"), []
            kept = []
            for i, s in enumerate(batch_sets(column(batch, "text"), k)):
                if not len(s) or not ids[i].is_valid:
                    continue
                at = np.searchsorted(tokens, s)
                hot = np.zeros(len(s), bool)
                inside = at < len(tokens)
                hot[inside] = tokens[at[inside]] == s[inside]
                length = len(s) - -(-num * len(s) // den) + 1
                head = s[~hot][:length]
                rare = len(head)
                if len(head) < length:
                    rest = s[hot]
                    head = np.concatenate([head, rest[np.lexsort((rest, texts[at[hot]]))][: length - len(head)]])
                with np.errstate(over="ignore"):
                    # sizes at a bound of one key's ranges are in the middle of the other's
                    least = [mixed(s + np.uint64(i)).min() + np.uint64(int(np.log(len(s)) / np.log(GROWTH) + i / 2)) for i in (1, 2)]
                    near = [int(x) for x in mixed(np.array(least, np.uint64)) >> np.uint64(33)]
                    out.append((len(s), s.sum(dtype=np.uint64), mixed(s).sum(dtype=np.uint64), near, rare, head))
                kept.append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(kept, pa.int64())),
                    pa.array([x[0] for x in out], pa.int32()),
                    _signed(np.array([x[1] for x in out], np.uint64)),
                    _signed(np.array([x[2] for x in out], np.uint64)),
                    pa.array([x[3] for x in out], pa.list_(pa.int64())),
                    pa.array([x[4] for x in out], pa.int32()),
                    pa.ListArray.from_arrays(np.cumsum([0] + [len(x[5]) for x in out]).astype(np.int32), _signed(np.concatenate([x[5] for x in out] or [np.zeros(0, np.uint64)]))),
                ],
                ["id", "n", "f1", "f2", "near", "rare", "head"],
            )

    return docs.mapInArrow(run, "id long, n int, f1 long, f2 long, near array<long>, rare int, head array<long>")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, tokens): the sets of texts as packed sorted 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in batch_sets(column(batch, "text"), k)]
            for a in range(0, len(sets), 500):
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(a, len(sets[a : a + 500])), pa.array(sets[a : a + 500], pa.binary())], ["id", "tokens"])

    return docs.mapInArrow(run, "id long, tokens binary")


def present(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is likely among the ids: a broadcast join with a bitmap of BITS bits, whatever the number of ids."""
    slot, page = F.pmod(F.xxhash64("id"), F.lit(BITS)), 1 << 15
    bits = ids.select((slot / page).cast("int").alias("page"), (slot % page).alias("at")).groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", ((slot % page) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = docs.withColumn("page", (slot / page).cast("int")).join(F.broadcast(bits), "page")
    return joined.where(F.floor(byte / F.pow(F.lit(2), slot % 8)) % 2 == 1).select(*docs.columns)


class Opened:
    """Members of one group, to be compared with queries: all tokens of the union with the members that have them."""

    def __init__(self, share: tuple[int, int]):
        self.num, self.den = share
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.root = np.zeros(0, np.int64)
        self.asked: list[tuple[int, int]] = []
        self.token = None

    def add(self, node: int, tokens: np.ndarray, compare: bool) -> None:
        found = self.joined(tokens) if compare else []
        self.root = np.append(self.root, self.ids.index(found[0]) if found else len(self.ids))
        self.ids.append(node)
        self.sets.append(tokens)
        self.token = None

    def linked(self, tokens: np.ndarray) -> np.ndarray:
        """Places of the members that a set is similar to."""
        if self.token is None:
            owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
            token = np.concatenate(self.sets)
            order = np.argsort(token, kind="stable")
            self.token, self.owner, self.sizes = token[order], owner[order], np.array([len(s) for s in self.sets])
        a, b = np.searchsorted(self.token, tokens, "left"), np.searchsorted(self.token, tokens, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sets))
        union = self.sizes + len(tokens) - common
        return np.flatnonzero(self.den * common >= self.num * union)

    def joined(self, tokens: np.ndarray) -> list[int]:
        """Of all that a set is similar to, one member of each part not connected before; the parts become one."""
        if not self.ids:
            return []
        roots = np.unique(self.root[self.linked(tokens)])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
        return [self.ids[i] for i in roots.tolist()]

    def answers(self, node: int, tokens: np.ndarray) -> list[int]:
        """As joined, of a query; it is kept as connected with that part."""
        found = self.joined(tokens)
        if found:
            self.asked.append((self.ids.index(found[0]), node))
        return found

    def tied(self, key: tuple[int, int]) -> list[tuple[int, int, int]]:
        """(part, member, smallest member or query connected with it) of the part's first copy, members that are such themselves left out."""
        part, salt = key
        least: dict[int, int] = {}
        for root, node in [*zip(self.root.tolist(), self.ids), *((int(self.root[at]), node) for at, node in self.asked)]:
            least[root] = min(node, least.get(root, node))
        return [(part, node, least[root]) for root, node in zip(self.root.tolist(), self.ids) if node != least[root] and not salt]


def compared(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(part, a, b): links that connect all that similarity connects, from rows (part, salt, query, id, tokens) dealt by part and salt, members before queries; members that are connected have the smallest text connected with them as b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = (None, 0), Opened(share)
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            cols = [column(batch, c) for c in ("part", "salt", "query", "id", "tokens")]
            for part, salt, query, node, packed in zip(*(c.to_pylist() for c in cols[:4]), cols[4]):
                if (part, salt) != key:
                    found += group.tied(key)
                    key, group = (part, salt), Opened(share)
                tokens = np.frombuffer(packed.as_buffer(), np.uint64)
                if query:
                    found += [(part, node, other) for other in group.answers(node, tokens)]
                else:
                    # members are compared with each other in the part's first copy only
                    group.add(node, tokens.copy(), compare=not salt)
            yield listed(found)
        yield listed(group.tied(key))

    def listed(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["part", "a", "b"])

    return rows.mapInArrow(run, "part long, a long, b long")


def links(docs: DataFrame, found: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """(a, b): links between classes, each named by its smallest id, enough to connect all that similarity connects."""
    needed = lambda x, y: F.ceil((x + y) * F.lit(share[0]) / F.lit(sum(share)))
    heads = prefixes(docs, k, share, frequent_tokens(found))
    classes = heads.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.first(F.struct("near", "rare", "head")).alias("x")).select("id", F.col("n").cast("long").alias("n"), "x.*")
    # size and place share one long, and both keys another, which keeps the shuffled rows short
    keys = F.shiftleft(F.get("near", 0), 32) + F.get("near", 1)
    rows = classes.select("id", "n", keys.alias("near"), "rare", F.posexplode("head").alias("at", "token"))
    # a frequent token is shared by many texts, so only the others, of which each has few, are counted
    spread = F.when(F.col("at") >= F.col("rare"), F.pmod(F.xxhash64("id"), F.lit(SPREAD)) + 1).otherwise(0).cast("int")
    rows = rows.select("token", spread.alias("spread"), "id", (F.shiftleft("n", 32) + F.col("at")).alias("about"), "near")
    met = rows.withColumn("texts", F.count("*").over(Window.partitionBy("token", "spread"))).where("texts > 1 or spread > 0")
    met = checkpointed(met.select("token", "id", F.col("about").bitwiseAND((1 << 32) - 1).alias("at"), F.shiftright("about", 32).alias("n"), "near"))
    # groups of similar sets, none larger than MEMBERS but by chance of the hash; those of either key are told by their last bit
    near = F.array(F.shiftright("near", 32) * 2, F.col("near").bitwiseAND((1 << 32) - 1) * 2 + 1)
    keyed = met.select("id", "n", "near").distinct().select("id", "n", F.explode(near).alias("near"))
    sizes = keyed.groupBy("near").agg(F.count("*").alias("many"), F.min("id").alias("pivot"))
    home = F.xxhash64("near", F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("many") / MEMBERS)))
    home = F.shiftleft(home, 1) + F.col("near") % 2
    homes = checkpointed(keyed.join(sizes, "near").select("id", "n", home.alias("home"), "many", "pivot"))
    texts = docs.where("id is not null")

    def held_against(work: DataFrame) -> DataFrame:
        """Links of the texts of (id, part, salt, query) rows."""
        ids = work.select("id").distinct()
        sets = whole_sets(present(texts, ids), k).join(ids, "id", "left_semi")
        dealt = work.join(sets, "id").repartition("part", "salt").sortWithinPartitions("part", "salt", "query")
        return checkpointed(compared(dealt.select("part", "salt", "query", "id", "tokens"), share))

    inside = homes.where("many > 1").select("id", F.col("home").alias("part"), F.lit(0).alias("salt"), F.lit(False).alias("query"))
    # the first text of a key asks all other groups of the key
    pivots = homes.where(F.col("many") > MEMBERS).select("pivot", "home", F.lit(0), F.lit(True))
    tied = held_against(inside.unionAll(pivots).groupBy("id", "part", "salt").agg(F.min("query").alias("query")))
    nodes = checkpointed(homes.where("home % 2 = 0").select("id", "n", "home").join(ties(tied), "id", "left"))
    # of a home, the members of one cluster are a group of their own
    nodes = nodes.withColumn("part", F.when(F.col("tie").isNull(), F.col("home")).otherwise(F.xxhash64("home", "tie")))
    return tied.unionAll(held_against(pairs_to_compare(met, nodes, needed, share))).select("a", "b")


def ties(tied: DataFrame) -> DataFrame:
    """(id, tie) of the texts that are linked within groups of one key or of the other: a name that only texts of one cluster share.

    Texts are named by the group of the one key, groups of the other take the smallest name in them, then those of the
    one key again. A cluster may keep several names: then its texts meet in groups once more, and no link is lost.
    """
    both = tied.select("part", F.col("a").alias("id"), "b").unionAll(tied.select("part", F.col("b").alias("id"), "b"))
    of = lambda key: F.min(F.when(F.abs(F.col("part") % 2) == key, F.col("b")))
    named = both.groupBy("id").agg(F.least(of(0), "id").alias("one"), F.least(of(1), "id").alias("other"))
    named = named.withColumn("tie", F.min("one").over(Window.partitionBy("other")))
    return named.select("id", F.min("tie").over(Window.partitionBy("one")).alias("tie"))


def pairs_to_compare(met: DataFrame, nodes: DataFrame, needed: Callable[[Column, Column], Column], share: tuple[int, int]) -> DataFrame:
    """(id, part, salt, query): groups that are to be opened, with their members and queries; of nodes (id, n, home, part, tie).

    Those of one home are compared before, and what is tied to all of a group already does not meet it.
    """
    num, den = share
    placed = met.select("token", "id", "at", "n").join(nodes.select("id", "home", "part", "tie"), "id")
    held = placed.where(F.col("n") - F.col("at") > needed(F.col("n"), F.col("n")) - MEETINGS)
    whole = F.when(F.count("tie") == F.count("*"), F.min("tie")).alias("whole")
    matrix = held.groupBy("token", "part").agg(F.min("home").alias("its"), F.min("at").alias("first"), F.min("n").alias("least"), F.max("n").alias("most"), whole)
    asked = placed.drop("part").withColumnRenamed("at", "place")
    # members that the query may be similar to and that are not larger; of equal sizes each pair of groups is met from one side
    smallest = F.ceil(F.col("n") * F.lit(num) / F.lit(den))
    smaller, larger = F.greatest(F.col("least"), smallest), F.least("most", "n")
    both = needed(F.col("n"), smaller)
    meetings = F.least(F.lit(MEETINGS).cast("long"), both - smallest + 1)
    left = F.least(F.col("n") - F.col("place"), larger - F.col("first"))
    meets = (F.col("its") != F.col("home")) & (smaller <= larger) & (left > both - meetings) & ((F.col("least") < F.col("n")) | (F.col("its") > F.col("home")))
    meets = meets & F.coalesce(F.col("tie") != F.col("whole"), F.lit(True))
    counted = asked.join(matrix.withColumnRenamed("token", "t"), (F.col("token") == F.col("t")) & meets).groupBy("id", "part").agg(F.count("*").alias("met"), F.min(meetings).alias("wanted"))
    opened = checkpointed(counted.where("met >= wanted").select("id", "part"))
    salts = opened.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts"))
    inside = nodes.join(salts, "part").select("id", "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("query"))
    asking = opened.join(salts, "part").select("id", "part", F.pmod(F.xxhash64("id", F.lit(9)), "salts").cast("int").alias("salt"), F.lit(True).alias("query"))
    return checkpointed(inside.unionByName(asking))


def jaccard_components(docs: DataFrame, k: int, share: tuple[int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; share is the least similarity as (numerator, denominator)."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = checkpointed(profiles(plain, k))
    joined = components(links(plain, found, k, share), loops=False)
    every = found.where("n is not null")
    classes = every.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("first"))
    # rows that repeat an id tie the classes of that id
    named = checkpointed(classes.join(joined, F.col("first") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("component", "first").alias("component")))
    out = every.where("n > 0 and id is not null").join(named, ["f1", "f2", "n"]).select("id", "n", "component")
    out = out.unionAll(every.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, k: int, share: tuple[int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component, one of those that repeat an id; rows without id all stay."""
    found = jaccard_components(docs, k, share, key, text)
    first = checkpointed(found.where(F.col(key) == F.col("component_id")).select(key).distinct())
    rest = [c for c in docs.columns if c != key]
    # the join has dealt the rows by id, so the choice among repeated ids needs no further exchange
    kept = docs.join(first, key, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("__row"))
    return kept.select(key, "__row.*").select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, (85, 100))
