"""The corpus pipeline: documents without toxic ones, near copies and benchmark passages, mixed and written as token ids.

Cases, for all stages: null and empty texts pass until mixing, which takes those of no tokens once; null ids are ids of
their own; rows that repeat a document are one after the near copies; an empty table stays empty through all stages; extra
columns pass, under whatever names, until the last stage, which returns doc_id, start, n_tokens and ids_crc32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontamination, jaccard_join, mixing, queries, token_output, toxicity
from threadloom.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; without labels all of them."""
    return toxicity.without_toxic(docs, queries.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; of equal rows one; texts without words stay, a row an id and text."""
    return jaccard_join.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty stands in a benchmark's passage; with an empty benchmark all."""
    return decontamination.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the weights, 0.8 of all tokens, none more than twice; each is whole, a row for each time it is taken."""
    return mixing.mixed_documents(docs, queries.domain_of(), queries.WEIGHTS, share=0.8, max_epochs=2, seed=17)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place and number of ids in the files, read back from them; null and empty texts hold the end id alone."""
    return token_output.token_output(docs, queries.tokenizer_path(), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each earlier stage is written in the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
