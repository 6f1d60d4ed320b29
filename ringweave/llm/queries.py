"""The registered queries of this subpackage: thin readers of the tables over its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.llm import (
    alignment,
    langid,
    mixing,
    packing,
    phrases,
    sharding,
    simhash,
    substrings,
    suffixes,
    topk,
    toxicity,
    vectors,
    warc,
)
from ringweave.llm.common import stage
from ringweave.session import prepare
from ringweave.sources.tables import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(by: int):
    """crc32 of the document id as text, modulo ``by``; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % by


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's toxicity, learned without the held-out fifth."""
    docs = table(prepare(spark), sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "toxic").where(_remainder(5) != 0)
    return toxicity.score(docs, toxicity.train(docs, labels)).select(
        "doc_id",
        (_remainder(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's SimHash and the least document its links reach."""
    fps = stage(simhash.fingerprints(table(prepare(spark), sf, "documents")), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return simhash.near_duplicates(fps).select("doc_id", digits, "component_id")


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without 50-word windows that a smaller document has."""
    docs = table(prepare(spark), sf, "documents").select("doc_id", "text")
    return substrings.cut(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Page ids of one archive file.
FILE_PAGES = 1000


def replicas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The pages as WARC records, and a replica of them with records damaged, lost and added by rule."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    file = F.concat(F.lit("pages-"), F.floor(F.col("page_id") / FILE_PAGES).cast("string")).alias("file")
    content = warc.response_record(F.col("page_id"), F.col("url"), F.col("html"))
    records = pages.select(file, F.col("page_id").alias("record_id"), content.alias("content"))
    rotten = F.concat(F.lit("X"), F.expr("substring(content, 2)"))
    short = F.expr("substring(content, 1, char_length(content) - 10)")
    damaged = (
        F.when(F.col("record_id") % 97 == 13, rotten).when(F.col("record_id") % 131 == 7, short).otherwise(F.col("content"))
    )
    kept = F.coalesce(F.col("record_id") % 211 != 5, F.lit(True))
    # Records that only the replica has stand under ids of their own.
    added = pages.where("page_id % 307 = 11").select(
        file,
        (-1 - F.col("page_id")).alias("record_id"),
        warc.response_record(-1 - F.col("page_id"), F.col("url"), F.col("html")).alias("content"),
    )
    return records, records.where(kept).withColumn("content", damaged).unionByName(added)


def op4_warc_fixity(spark: SparkSession, sf: str) -> DataFrame:
    """Where a damaged replica of the page archive differs from the archive."""
    found = warc.audit(*replicas(prepare(spark), sf))
    return found.select("file", F.col("record_id").alias("page_id"), "kind", "offset", "length")


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 2048."""
    return packing.pack_documents(table(prepare(spark), sf, "documents"), tokenizer_path())


def op6_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector by integer inner product."""
    rows = table(prepare(spark), sf, "embeddings").select(
        F.monotonically_increasing_id().alias("row"), "vec_id", topk.quantized(F.col("embedding")).alias("v")
    )
    rows = stage(rows, "quantized")
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return topk.top_k(rows, asked, 10)


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's language, learned without the held-out third."""
    docs = table(prepare(spark), sf, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(_remainder(3) != 1))
    return langid.predict(docs, model).select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op8_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's number of near duplicates and their component."""
    return vectors.near_duplicates(table(prepare(spark), sf, "embeddings"), 0.95)


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """What a mix of the sources at weights 1, 2, 3, ... takes of every document."""
    return mixing.mix(table(spark, sf, "documents")).drop("before", "shuffle", "_place")


def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without byte strings of 200 that start elsewhere too."""
    docs = table(prepare(spark), sf, "documents").select("doc_id", "text")
    return suffixes.cut(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """How the tokens of two tokenizers go together in every document, and how widely."""
    docs = table(prepare(spark), sf, "documents")
    return alignment.alignment(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's shard of 24 and its place there: a uniform shuffle with equal row counts."""
    placed = sharding.shard(table(spark, sf, "documents"), 24)
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The 2000 best phrases of every language that occur 30 times or more."""
    return phrases.collocations(table(prepare(spark), sf, "documents"), least=30, longest=4, percent=80, keep=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_packing": op5_packing,
    "op6_exact_topk": op6_exact_topk,
    "op7_language_id": op7_language_id,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_mixing": op9_mixing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_alignment": op11_alignment,
    "op12_sharding": op12_sharding,
    "op13_phrases": op13_phrases,
}
