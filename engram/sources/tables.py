"""Readers of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "memory vectors messages feedback_log topic_log eval_queries doc_labels eval_items name_parts"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table. Timestamps without zone become UTC instants, which watermarks need."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df
