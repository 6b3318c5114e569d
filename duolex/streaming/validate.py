"""Incremental ingestion of parsed lines. There is no event time and no state: rows are filtered as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import reason


def valid_pairs_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over tab-separated (key, en, ja) files of a folder: rows that pass the checks of the batch import."""
    rows = spark.readStream.format("text").load(folder)
    parts = F.split("value", "\t")
    pairs = rows.select(F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("en"), F.get(parts, F.lit(2)).alias("ja"))
    return pairs.filter(reason(F.col("en"), F.col("ja")).isNull())
