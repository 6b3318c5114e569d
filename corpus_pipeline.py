"""The corpus pipeline: rules, near duplicates, benchmark leaks, personal data, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that the stage before it kept.
All but the last return the columns of `documents`. `run` applies them, writing each result as Parquet to the cluster's
shared folder and reading it again; a stage's input is removed once its result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duolex.llm import bpe, decontaminate, neardup, pii, quality
from duolex.llm.common import shared_folder, table
from duolex.session import remove


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base nor the learned decision list rejects, each row judged by its own text.

    Null and blank texts go; rows that repeat are judged alike; without labels only the base rejects; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (five-word shingles, similarity 0.8), the one of the smallest doc_id.

    SimHash links and an exact rest, see `duolex.llm.neardup`, which also says what becomes of nulls, blanks and repeated rows.
    """
    return neardup.deduplicate(docs, words=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy, edited or not, of a benchmark item. Null and blank texts, which hold none, stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal numbers, dates, addresses and secrets replaced by pseudonyms; n_chars follows the text.

    The key is that of the setting `duolex.pii.key`, or a random one for the session. Null texts and null n_chars stay null.
    """
    return pii.pseudonymize(docs, pii.session_key(spark)).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents, and ids, n_tokens and decoded text of every document, in place of columns of these names.

    Null and blank texts have no ids; rows that repeat are encoded each.
    """
    got = bpe.encode(docs, bpe.vocabulary(), decoded="decoded")
    return got.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("benchmark leaks", benchmark_leaks), ("personal data", personal_data), ("tokens", tokens)]
#: The learned list, the components and the tokens have no statement in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
