"""Settings from JSON, environment and code; skip patterns; synonym tables."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.text import strip
from engram.params import Params

PREFIX = "ENGRAM_"


def merged(low: Mapping[str, Any], high: Mapping[str, Any]) -> dict[str, Any]:
    """Two settings trees as one; where both have a value the second's counts."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def params(path: str | None = None, env: Mapping[str, str] | None = None, **inline: Any) -> Params:
    """Parameters: defaults, then the JSON file, then ENGRAM_<NAME>, then what is given here. Unknown names in the file are passed over; values have the default's type."""
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Params)}
    values: dict[str, Any] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values = {k: v for k, v in json.load(f).items() if k in kinds}
    values |= {k: v for k in kinds if (v := (os.environ if env is None else env).get(PREFIX + k.upper())) is not None}
    values |= inline
    return Params(**{k: kinds[k](v) for k, v in values.items()})


def strict_bool(value: Any) -> bool:
    """True or false of a setting; words count as what they say."""
    if isinstance(value, str):
        word = value.strip().lower()
        if word in ("1", "true", "yes", "on"):
            return True
        if word in ("0", "false", "no", "off", ""):
            return False
        raise ValueError(f"neither true nor false: {value!r}")
    return bool(value)


def skip_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(pattern) of a text file: one a line, in lower case, without blank lines and lines that begin with #."""
    lines = spark.read.text(path).select(F.lower(strip(F.col("value"))).alias("pattern"))
    return lines.where((F.col("pattern") != "") & ~F.col("pattern").startswith("#")).distinct()


def unlocked(queries: DataFrame, locks: DataFrame, agent: str = "agent") -> DataFrame:
    """Queries of agents that no workflow has locked; null agents hold no lock."""
    return queries.join(locks.select(agent).where(F.col(agent).isNotNull()).distinct(), agent, "left_anti")


def gated(queries: DataFrame, patterns: DataFrame, least: int = 2) -> DataFrame:
    """Queries worth a search: long enough, and not among the skip patterns."""
    asked = queries.where(F.length(strip(F.col("query"))) >= least)
    return asked.join(patterns.select(F.col("pattern").alias("_p")), F.lower(strip(F.col("query"))) == F.col("_p"), "left_anti")
