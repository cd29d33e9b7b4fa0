"""Incremental jobs as streams: topic scores, turns for distillation, superseded versions, progress messages.

Each runs with ``Trigger.AvailableNow`` from a checkpoint in the shared folder: a second run reads only what has
arrived since, and a run that was broken off goes on where it stood.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.operators import maintain as M
from engram.operators import topics as T
from engram.session import shared_dir


def stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A parquet file or folder as a stream, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")


def place(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """All that is there now, in micro-batches; returns when it is done, raises what a batch raised."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def topic_scores(log: DataFrame) -> DataFrame:
    """Running scores of topics, for a stream written in complete mode: writes delivered again count once."""
    return T.scores(T.writes(log))


def write_topic_scores(spark: SparkSession, path: str, target: str, checkpoint: str) -> None:
    """Keeps a table of scores; each batch replaces the table that the one before wrote."""
    run(topic_scores(stream(spark, path)), checkpoint, lambda df, n: df.write.mode("overwrite").parquet(f"{target}/batch={n}"), "complete")


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The table that the last batch wrote."""
    every = spark.read.parquet(target)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")


def write_turns(spark: SparkSession, path: str, target: str, checkpoint: str) -> None:
    """Appends turns for distillation. The checkpoint is the watermark: what was read once is not read again. A batch that is repeated after a failure replaces its own rows."""
    run(stream(spark, path), checkpoint, lambda df, n: M.turns(df).write.mode("overwrite").parquet(f"{target}/batch={n}"))


def turns(spark: SparkSession, target: str) -> DataFrame:
    """Each turn once, also if its message came in two batches."""
    return spark.read.parquet(target).groupBy("id").agg(F.max("line").alias("line"))


def superseded(entries: DataFrame) -> DataFrame:
    """(key, superseded_by) as newer entries of the same content arrive, by state kept per content: its latest key.

    In one batch entries are taken in order of (created, key); one that arrives late, before the latest that is known, is
    reported as superseded itself."""

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = state.get if state.exists else None
        rows = pd.concat(batches).drop_duplicates("key").sort_values(["created", "key"])
        out = []
        for key, created in zip(rows.key, rows.created):
            here = (int(created), key)
            if latest is None:
                latest = here
            elif here > tuple(latest):
                out.append((latest[1], key))
                latest = here
            elif key != latest[1]:
                out.append((key, latest[1]))
        state.update(latest)
        yield pd.DataFrame(out, columns=["key", "superseded_by"])

    rows = entries.where("key IS NOT NULL AND content_hash IS NOT NULL").select("content_hash", "key", F.coalesce(F.unix_micros("created"), F.lit(0)).alias("created"))
    return rows.groupBy("content_hash").applyInPandasWithState(step, "key string, superseded_by string", "created long, key string", "append", GroupStateTimeout.NoTimeout)


def progress_line(message: Column) -> Column:
    """What is shown of a progress message ``task|tag|content``: tag and content."""
    parts = F.split(message, r"\|", 3)
    return F.concat_ws(" ", F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3)))


def session_board(log: DataFrame, days: int) -> DataFrame:
    """Lives of the whole set of topics as session windows of a stream; needs a key column, which here is constant."""
    rows = log.where("ts IS NOT NULL").withColumn("set", F.coalesce(F.substring("topic", 1, 0), F.lit(""))).withWatermark("ts", "1 day")
    w = F.session_window("ts", f"{days} days")
    return rows.groupBy(w.alias("w"), "set").agg(F.count(F.lit(1)).alias("writes")).select(F.col("w.start").alias("first"), F.col("w.end").alias("end"), "writes")
