"""Corpus pipeline: quality, near duplicates, secrets, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir), works on every row of `docs`, and its
decisions take effect on the rows it returns. All but the last return the columns
of `documents`. `run` writes each stage to the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dispatchlake.llm import (
    attention_quality,
    bin_completion,
    ngram_join,
    pivotal_mix,
    secret_markov,
)
from dispatchlake.llm.common import table
from dispatchlake.session import scratch_path
from dispatchlake.session import stage as store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels of `docs` alone.

    Every row is judged by its own whole text: null and empty texts get a score too,
    rows that repeat a doc_id and rows without one stay or go one by one. An empty
    table stays empty.
    """
    model = attention_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = attention_quality.score_documents(docs.select(*COLUMNS), model)
    return scored.where("predicted = 1").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near duplicates (five words, 0.8): the smallest doc_id.

    Documents without words are nobody's duplicates and stay, as do rows without
    a doc_id. Rows equal in doc_id and text count as one document; rows that
    repeat a doc_id with other texts are documents of their own, so each has a
    key by which it is compared. Of near copies under one doc_id the text of the
    smallest hash stays.
    """
    rest = ["lang", "source", "n_chars"]
    named = docs.where("doc_id is not null").groupBy("doc_id", "text")
    named = named.agg(F.min(F.struct(*rest)).alias("rest")).select("doc_id", "text", "rest.*")
    marks = {"key": F.monotonically_increasing_id(), "spread": F.xxhash64("text")}
    keyed = store(named.withColumns(marks), "keyed-documents")
    groups = ngram_join.components(keyed.select(F.col("key").alias("doc_id"), "text"), 5, 80)
    groups = groups.select(F.col("doc_id").alias("key"), "component_id")
    least = F.min(F.struct("doc_id", "spread", "key")).alias("least")
    first = keyed.select("key", "doc_id", "spread").join(groups, "key")
    first = first.groupBy("component_id").agg(least).select("least.key")
    kept = keyed.join(first, "key", "left_semi").select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows the text.

    Rows stay as many as they were, repeated ids and null ids too. Null texts stay
    null and empty ones empty; texts are searched whole, of any length.
    """
    clean = secret_markov.redact(secret_markov.find_secrets(docs.select(*COLUMNS)))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long"))
    return clean.withColumn("n_chars", F.coalesce(n_chars, "n_chars")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to two times.

    Rows equal in all columns are copies of one another: the mix rounds each, and
    one of them stands for the sum. Rows that repeat a doc_id with anything else are
    rows of their own. Null and empty texts have no words and are not taken; a null
    source is a source. Texts are counted and kept whole; an empty table stays empty.
    """
    key = ["doc_id", "source", "spread"]
    rest = ("lang", "n_chars")
    copies = pivotal_mix.mix(docs, also=rest).groupBy(*key).agg(F.sum("copies").cast("int").alias("taken"))
    marked = docs.select(*COLUMNS, F.xxhash64("text", "doc_id", *rest).alias("spread"))
    marked = marked.dropDuplicates(key)
    same = [marked[c].eqNullSafe(copies[c]) for c in key]
    joined = marked.join(copies.where("taken > 0"), same)
    return joined.select(
        *[marked[c] for c in COLUMNS], F.explode(F.sequence(F.lit(1), "taken")).alias("copy")
    ).drop("copy")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place.

    Null and empty texts are one piece, the end id; each row that repeats a doc_id
    is a document. Only texts over a sequence are cut, into full pieces and a rest.
    """
    return bin_completion.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("secrets", hide_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

# learned scores, random rounding and tokenisers: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
