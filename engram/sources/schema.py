"""Schemas of the store's tables, their evolution, vectors and their dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "entries": "key string, content_hash string, version int, content string, tags array<string>, category string, source string, created timestamp, fragment_type string, intensity double, polarity double, sentiment_label string, feedback_score bigint, entities array<string>, level int, valid_until timestamp, invalid_at timestamp, corrected_at timestamp, consumed_by string, consumed_at timestamp",
    "updates": "key string, ts timestamp, column string, value string",
    "feedback": "key string, ts timestamp, delta bigint, write_id string",
    "topics": "topic string, ts timestamp, weight double, write_id string",
    "attention": "topic string, ts timestamp, weight double, write_id string",
    "vectors": "key string, model string, embedding array<float>",
    "synonyms": "term string, synonyms string",
    "checked": "key string",
}

#: Dimensions of known embedding models; any other has 1536.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "mini-embed-64": 64, "old-embed-48": 48}


def dimension(model: str) -> int:
    return DIMENSIONS.get(model, 1536)


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables as one; columns that either lacks are null in its rows."""
    return old.unionByName(new, allowMissingColumns=True)


def wrong_dimension(vectors: DataFrame, model: str) -> DataFrame:
    """Rows of a model whose vectors haven't its dimension."""
    return vectors.where((F.col("model") == model) & F.col("embedding").isNotNull() & (F.size("embedding") != dimension(model)))


@F.pandas_udf(T.BinaryType())
def _pack(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _unpack(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def packed(v: Column) -> Column:
    """A vector as 32-bit floats in little-endian order, for exchange with other stores."""
    return _pack(v)


def unpacked(b: Column) -> Column:
    return _unpack(b)
