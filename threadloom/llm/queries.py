"""The queries of the operators over the driver's tables, with production parameters, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import chat, decontamination, divergence, embed_dedup, jaccard_join, language, license_scan, line_dedup, merkle, mixing, oracle, suffix_dedup, token_output, toxicity
from threadloom.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", names, "contaminated")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    # roles are known, and learned from, outside the held-out fold only
    known = chat.raw_transcripts(conversations.where(fold(F.col("conv_id")) != 0), ["role"])
    return chat.chat_format(chat.raw_transcripts(conversations), known)


#: Domains of the tables' sources, and target weights of domains and of languages within each.
WEIGHTS = {("web",): 0.3, ("reference",): 0.4, ("community",): 0.3}
WEIGHTS |= {(domain, lang): w for (domain,) in list(WEIGHTS) for lang, w in (("en", 0.5), ("fr", 0.2), ("es", 0.15), ("de", 0.15))}


def domain_of(source: str = "source") -> Column:
    number = F.try_to_number(F.regexp_extract(source, r"(\d{1,6})$", 1), F.lit("999999"))
    return F.when(number == 0, "web").when(number < 10, "reference").otherwise("community")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domain_of(), WEIGHTS, share=0.5, max_epochs=2, seed=17)


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embed_dedup(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_suffix_dedup, op2_toxicity, op3_decontamination, op4_jaccard_join, op5_token_output, op6_language, op7_chat, op8_mixing, op9_embed_dedup, op10_line_dedup, op11_license_scan, op12_divergence, op13_merkle)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
