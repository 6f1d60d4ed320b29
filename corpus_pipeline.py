"""A corpus pipeline: toxicity filter, near-dedup, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns
the columns of ``documents``; the last returns packed pieces. ``run`` writes each stage's
result as Parquet and reads it again for the next.

Defined cases, beside those of the operators: rows with one id and rows without an id are
separate documents, so of their copies one row stays too (one with an id before one without);
documents that lose their whole text stay with an empty text; columns other than those of
``documents`` pass every stage but the last whatever their names; an empty table passes every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.llm import mixing, nearcopies, packing, suffixes, toxicity
from ringweave.llm.common import WORD, stage
from ringweave.llm.queries import tokenizer_path
from ringweave.session import prepare
from ringweave.sources.tables import table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that the stages read or write; all others only pass.
READ = ("doc_id", "text", "source", "n_chars")


def _same_columns(function: Stage) -> Stage:
    """A stage that returns its input's columns: those it does not know have other names meanwhile."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in READ else f"passed_{i}" for i, c in enumerate(docs.columns)]
        return function(spark, docs.toDF(*names), sf_dir).select(names).toDF(*docs.columns)

    return run


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and its length where the table has that column."""
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else changed


@_same_columns
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; learned from the labelled ones among them."""
    labels = table(prepare(spark), sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.keep_clean(docs, toxicity.train(docs.select("doc_id", "text"), labels))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key per row, ``_row``; staged, so that the keys stay what they are."""
    return stage(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")


@_same_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts that reach each other over pairs of which five-word
    shingles are 0.8 alike: one with an id before one without, then the one with the least."""
    keyed = _keyed(docs)
    named = nearcopies.near_copies(keyed, "_row").withColumnRenamed("key", "_row")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row").alias("_row"))
    rows = keyed.select("_row", "doc_id").join(named, "_row")
    kept = rows.groupBy("root").agg(F.min(first).alias("_first")).select("_first._row")
    return keyed.join(kept, "_row", "left_semi")


@_same_columns
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that stand elsewhere too."""
    return _with_text(suffixes.cut(docs).select(docs.columns), F.col("text"))


@_same_columns
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy that the mix takes as a row; one that the budget ends in has its first words."""
    keyed = _keyed(docs)
    queued = mixing.queues(keyed, keep=["_row"])
    mixed = mixing.served(queued, keep=["_row", "size"])
    copies = keyed.join(mixed.select("_row", F.col("words").alias("_words"), F.col("size").alias("_size")), "_row")
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))  # with the blanks before them
    first = F.array_join(F.slice(words, 1, F.col("_words").cast("int")), "")
    text = F.when(F.col("_words") >= F.col("_size"), F.col("text")).otherwise(first)
    return _with_text(copies, text).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows in sequences of 2048, with their ids (little-endian, 32 bits each)."""
    return packing.pack_documents(docs, tokenizer_path(), keep_ids=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_dedup", near_dedup),
    ("suffix_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Training, fingerprints and tokens are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
