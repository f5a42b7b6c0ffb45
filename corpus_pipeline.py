"""A corpus pipeline of five stages over `documents`, each calling one operator of the llm subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it as Parquet and
gives it, read again, to the next. All stages but the last return the columns of documents.

Defined results, for every stage: null texts count as empty and stay null; empty tables give empty
tables; further columns are returned as they are, whatever their names; very long texts are handled
whole. Rows that repeat an id are scored and cleaned each for itself, are one document where near
duplicates are dropped, and are taken together, as often as their id, by the mix; of equal documents
the one with the smallest id stays. Rows without id are scored and cleaned, have no near duplicates
and are mixed with others of their source that have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe_codec, jaccard_join, mixing, pii, toxicity
from sparkloom.llm.common import checkpointed, table

TOXIC_FROM = 0.7
#: Words of a shingle and least Jaccard similarity of near-duplicates.
SHINGLE, SIMILAR = 5, (80, 100)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with lines added behind those that docs has as columns already."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labelled documents at hand, scores below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "__score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return jaccard_join.one_of_each(docs, SHINGLE, SIMILAR)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and words that disclose it generalised or removed."""
    base, added = fresh(docs, "__base_spans", "__added_spans")
    found = pii.find(docs, base=base, added=added)
    clean = pii.sanitised(F.col("text"), pii.in_order(F.concat(base, added)))
    found = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows of one id and source are taken together."""
    units = mixing.sized(docs).groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    ident, source, copies, copy = fresh(docs, "__id", "__source", "__copies", "__copy")
    taken = mixing.decide(units).where(F.col("copies") > 0)
    taken = checkpointed(taken.select(F.col("doc_id").alias(ident), F.col("source").alias(source), F.col("copies").alias(copies)))
    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(ident)) & F.col("source").eqNullSafe(F.col(source)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids) of every document taken."""
    import public_tokenizers

    coded = bpe_codec.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("mixing", mix_sources),
    ("bpe_codec", encode_texts),
]

#: Rounding by chance, classifiers and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
