"""Personal data: exact base spans, and terms that disclose them, by information-theoretic sanitisation.

Base spans are matches of fixed patterns with their checks. Their distinct values are the protected
entities. A word of a text with an entity discloses it as far as seeing the word tells of the entity:
pointwise mutual information over the entity's information content, with counts over the whole
corpus. Words that tell all are removed, words that tell nearly all are generalised, wherever they
stand in a document with the entity.

Entities and pairs are counted in different texts, so copies of a text are one piece of evidence;
words are counted in documents, so those of copied texts pass for better known and are kept rather
than removed. Entities that stand in the same texts disclose alike and are one class; that they do is
verified text by text, not taken from a hash. Only words rare
enough to reach the threshold with some entity of their text are paired with its classes.

Everything is built from DataFrame functions. A pattern's positions come from the lengths of what
lies between its matches (split) and of the matches; both are in code points. Patterns use
possessive loops and start guards: the same matches, without recursion and without quadratic time.

Defined results: null and empty texts have no spans; without spans the hash is that of the empty
string; spans of different kinds may overlap and all are kept; empty tables give empty tables; rows
that repeat an id are handled one by one; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import checkpointed, table

#: Kinds in the order in which spans of one start are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # the greedy run of digits as a whole, so runs of other lengths cannot match in part
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any text with a match passes.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": PATTERNS["card"], "phone": r"\+[0-9]"}
REMOVE, GENERALISE = "remove", "generalise"
#: Letters of a word at least, and the shares of an entity's information from which a word is removed or generalised.
LEAST_LETTERS = 3
REMOVE_FROM, GENERALISE_FROM = 0.999, 0.9
#: Values of a block of running sums.
BLOCK = 64

SPAN = "struct<start:int,stop:int,kind:string,value:string>"
#: Words of a masked text, where letters of spans are U+0000: none that run into a span.
WORDS = rf"(?<![\p{{L}}\x00])\p{{L}}{{{LEAST_LETTERS},}}+(?!\x00)"


def let(value: Column, f) -> Column:
    """f of a value that is made once: inside a lambda, an expression is made again wherever it stands."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(values: Column, join, none: int = 0) -> Column:
    """For each of an array's values what join makes of those before it: in blocks, so that no long array grows value by value."""
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def blocks(v: Column) -> Column:
        many = F.ceil(F.size(v) / BLOCK).cast("int")
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))

    def sums(b: Column) -> Column:
        firsts = F.aggregate(F.transform(b, lambda x: F.aggregate(x, F.lit(none), join)), start(F.lit(none)), add, lambda acc: acc["out"])
        return F.flatten(F.zip_with(b, firsts, lambda x, f: F.aggregate(x, start(f), add, lambda acc: acc["out"])))

    return let(values, lambda v: let(blocks(v), sums))


def located(text: Column, pattern: str | Column, kind: str) -> Column:
    """Array of all matches of a pattern as spans, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    pieces = lambda m: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda gap, x: F.struct(F.length(gap).alias("gap"), x.alias("value")))

    def span(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"))

    def spans(p: Column) -> Column:
        return F.zip_with(p, running(F.transform(p, lambda x: x["gap"] + F.length(x["value"])), lambda a, x: a + x), span)

    return let(let(found, pieces), spans)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit doubled."""
    each = F.split(F.reverse(value), "")
    worth = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x["value"], r"\."), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.coalesce(F.try_element_at(F.array(part.try_cast("int")), F.lit(1)), F.lit(256)) <= 255)),
    "card": lambda x: luhn(digits(x["value"])),
    "phone": lambda x: F.length(digits(x["value"])).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """All base spans of a text by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    parts = [F.when(text.rlike(HINTS[k]), F.filter(located(text, PATTERNS[k], k), CHECKS[k])).otherwise(none) for k in KINDS]
    return in_order(F.concat(*parts))


def in_order(spans: Column) -> Column:
    rank = lambda x: F.array_position(F.array(*map(F.lit, (*KINDS, REMOVE, GENERALISE))), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), rank(x).alias("b"), x["stop"].alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def entity(kind: Column, value: Column) -> Column:
    """One spelling of a protected value."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), digits(value)).otherwise(F.lower(value)))


def cut(text: Column, spans: Column, piece) -> Column:
    """The text with each span's part beyond the spans before it, and whether it overlaps them, given to `piece`."""

    def part(x: Column, at: Column) -> Column:
        begin = F.greatest(at, x["start"])
        return F.when(x["stop"] > at, F.concat(F.substring(text, at + 1, begin - at), piece(F.substring(text, begin + 1, x["stop"] - begin), x, x["start"] < at))).otherwise("")

    def whole(s: Column) -> Column:
        before = running(F.transform(s, lambda x: x["stop"]), lambda a, x: F.greatest(a, x))
        end = F.coalesce(F.array_max(F.transform(s, lambda x: x["stop"])), F.lit(0))
        return F.concat(F.array_join(F.zip_with(s, before, part), ""), F.substring(text, end + 1, F.length(text)))

    return let(spans, whole)


def masked(text: Column, spans: Column) -> Column:
    """The text, as long, with letters of spans as U+0000 and their other code points as U+0001."""
    return cut(text, spans, lambda part, x, overlaps: F.regexp_replace(F.regexp_replace(part, r"\p{L}", "\0"), "[^\0]", "\1"))


def spellings(hidden: Column) -> Column:
    """The different words of a masked text as they are spelt."""
    return F.array_distinct(F.regexp_extract_all(hidden, F.lit(WORDS), F.lit(0)))


def document_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, n_term): documents of the corpus with each word."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"\P{L}+"))
    return docs.select(F.explode(words).alias("term")).where(F.length("term") >= LEAST_LETTERS).groupBy("term").agg(F.count("*").alias("n_term"))


def fingerprint() -> Column:
    """Of the texts of an entity, a number for their set, by two sums of hashes."""
    mark = lambda seed: F.bit_xor(F.xxhash64("same", F.lit(seed)))
    return F.xxhash64(F.count("*"), mark(1), mark(2))


def entity_classes(found: DataFrame) -> DataFrame:
    """(same, class, n_entity): the classes of entities of each text, with the number of texts that hold them.

    Entities of one fingerprint are one class if each of their texts holds all of them; where one does not, each
    of them is a class of its own.
    """
    values = F.array_distinct(F.transform("__base", lambda x: entity(x["kind"], x["value"])))
    each = checkpointed(found.where(F.size("__base") > 0).select(F.col("__same").alias("same"), F.explode(values).alias("entity")).distinct())
    # numbers of entities are fixed by the written copy
    sets = checkpointed(each.groupBy("entity").agg(F.count("*").alias("n_entity"), fingerprint().alias("print")).withColumn("number", F.monotonically_increasing_id()))
    groups = sets.groupBy("print").agg(F.min("number").alias("class"), F.count("*").alias("members"))
    named = each.join(sets.join(groups, "print"), "entity")
    whole = checkpointed(named.groupBy("same", "class").agg(F.first("n_entity").alias("n_entity"), F.first("members").alias("members"), F.count("*").alias("held")))
    mixed = whole.where("held < members").select("class").distinct()
    if mixed.isEmpty():
        return whole.select("same", "class", "n_entity")
    alone = named.join(mixed, "class", "left_semi").select("same", F.col("number").alias("class"), "n_entity")
    return checkpointed(whole.join(mixed, "class", "left_anti").select("same", "class", "n_entity").unionByName(alone))


def together(found: DataFrame, classes: DataFrame, counts: DataFrame, text: str, rows: int) -> DataFrame:
    """(same, class, n_entity, term, n_term): each class of a text with each word outside base spans that is rare enough to tell of it."""
    words = spellings(masked(F.col(text), F.col("__base")))
    terms = found.where(F.size("__base") > 0).select(F.col("__same").alias("same"), F.explode(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).alias("term")).distinct()
    # by n_both <= n_entity, the disclosure reaches the threshold only for words of so few documents
    limit = F.pow(F.lit(float(rows)), F.lit(1 - GENERALISE_FROM)) * F.pow(F.col("n_entity"), F.lit(GENERALISE_FROM)) * (1 + 1e-9)
    widest = classes.groupBy("same").agg(F.max(limit).alias("limit"))
    rare = terms.join(counts, "term").join(widest, "same").where(F.col("n_term") <= F.col("limit")).select("same", "term", "n_term")
    return rare.join(classes, "same").where(F.col("n_term") <= limit)


def disclosing(pairs: DataFrame, rows: int) -> DataFrame:
    """(class, term, kind): words that tell too much of a class of entities."""
    counts = pairs.groupBy("class", "term").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    told = F.log2(F.col("n_both") * F.lit(float(rows)) / (F.col("n_term") * F.col("n_entity")))
    content = F.log2(F.lit(float(rows)) / F.col("n_entity"))
    ratio = counts.where(content > 0).select("class", "term", (told / content).alias("disclosure"))
    kind = F.when(F.col("disclosure") >= REMOVE_FROM, REMOVE).when(F.col("disclosure") >= GENERALISE_FROM, GENERALISE)
    return ratio.withColumn("kind", kind).where(F.col("kind").isNotNull())


def occurrences(hidden: Column, told: Column) -> Column:
    """Spans of all words of a masked text that a map of terms to kinds holds."""
    spans = F.transform(located(hidden, WORDS, "term"), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.try_element_at(told, F.lower(x["value"])).alias("kind"), F.lower(x["value"]).alias("value")))
    return F.filter(spans, lambda x: x["kind"].isNotNull())


def find(docs: DataFrame, text: str = "text", base: str = "base", added: str = "added") -> DataFrame:
    """The rows with arrays of spans under the names given; columns of those names are replaced, all others kept, whatever their names."""
    kept = docs.drop(base, added)
    names, plain = kept.columns, text
    # other columns lie in one, so that none is taken for a column of the method
    others = [F.col(f"`{c}`") for c in names if c != plain]
    kept = kept.select(F.col(f"`{plain}`").alias("__text"), F.struct(*others or [F.lit(None)]).alias("__kept"))
    text = "__text"
    # numbers of rows are fixed by the written copy
    found = kept.withColumn("__base", base_spans(F.col(text))).withColumn("__same", F.xxhash64(text)).withColumn("__row", F.monotonically_increasing_id())
    found = checkpointed(found)
    rows = found.count()
    classes = entity_classes(found)
    pairs = checkpointed(together(found, classes, document_counts(kept, text), text, rows))
    terms = pairs.join(disclosing(pairs, rows), ["class", "term"]).groupBy("same", "term").agg(F.max("kind").alias("kind"))
    told = terms.groupBy("same").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("__told"))
    # numbers of rows meet the words of their text, so that a text of many copies is spread over tasks when it is read again
    told = found.where(F.size("__base") > 0).select("__row", F.col("__same").alias("same")).join(told, "same").select("__row", "__told")
    none = F.array().cast(f"array<{SPAN}>")
    # only rows with base spans can have terms, so the texts of others are not shuffled
    bare = found.where(F.size("__base") == 0).withColumn("__added", F.lit(None).cast(f"array<{SPAN}>"))
    out = found.where(F.size("__base") > 0).join(told, "__row", "left").withColumn("__hidden", F.when(F.col("__told").isNotNull(), masked(F.col(text), F.col("__base"))))
    out = out.withColumn("__added", F.when(F.col("__told").isNotNull(), occurrences(F.col("__hidden"), F.col("__told")))).drop("__told", "__hidden")
    out = out.unionByName(bare)
    back = [F.col(text if c == plain else f"__kept.`{c}`").alias(c) for c in names]
    return out.select(*back, F.col("__base").alias(base), in_order(F.coalesce("__added", none)).alias(added))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first; removed words leave nothing."""
    mark = lambda x: F.when(x["kind"] == REMOVE, F.lit("")).when(x["kind"] == GENERALISE, F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
    return F.when(F.size(spans) > 0, cut(text, spans, lambda part, x, overlaps: F.when(overlaps, "").otherwise(mark(x)))).otherwise(text)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(in_order(F.concat("base", "added"))).alias("spans"))
