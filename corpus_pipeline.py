"""The corpus pipeline: from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of documents. Null texts, empty tables, repeated
rows and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernweave.llm import bpe, decontaminate, language, pii, similarity
from fernweave.llm.common import dropped, table, written
from fernweave.llm.queries import tokenizer_path
from fernweave.shipping import shipped


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose words are of no known language, go; texts in several known ones stay."""
    return language.known_language(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays."""
    return similarity.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    return pii.redacted(docs, pii.fit(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number, and digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", shipped(language_id)),
    ("near_duplicates", shipped(near_duplicates)),
    ("decontamination", shipped(decontamination)),
    ("personal_data", shipped(personal_data)),
    ("token_ids", shipped(token_ids)),
]

#: A conditional random field's decisions have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table that it was written to; what the stages before it wrote is removed."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
        if held is not None:
            dropped(spark, held)
        held = docs
    return docs
