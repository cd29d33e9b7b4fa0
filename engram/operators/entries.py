"""Entries: one row per key, filters, versions, updates, timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions.text import strip


def entries(memory: DataFrame, *columns: str) -> DataFrame:
    """One row per key, of the named columns (or all): rows delivered again collapse, in part before the shuffle. Of values that differ the greatest that isn't null stays."""
    names = columns or [c for c in memory.columns if c != "key"]
    return memory.where(F.col("key").isNotNull()).groupBy("key").agg(*[F.max(c).alias(c) for c in names if c != "key"])


def lookup(memory: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Entries of the given keys. The keys are filtered before rows are reduced, so that the filter reaches the scan."""
    return entries(memory.where(F.col("key").isin(*keys)) if keys else memory.where("false"), *columns)


def live(rows: DataFrame) -> DataFrame:
    """Entries that a search may return: not expired, not superseded, not consumed, not corrected."""
    return rows.where("invalid_at IS NULL AND valid_until IS NULL AND corrected_at IS NULL AND coalesce(fragment_type, '') <> 'consumed'")


def not_noise(rows: DataFrame, most: int) -> DataFrame:
    return rows.where(F.length("content") <= most)


def clean_tags(tags: Column) -> Column:
    """Tags with spaces around them and empty ones removed."""
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), strip), lambda t: t.isNotNull() & (t != ""))


def visible_to(tags: Column, agent: str | None, primary: bool = False) -> Column:
    """Whom an entry is for: the primary agent sees all, another its own and shared ones, none only shared ones."""
    if primary:
        return F.lit(True)
    own = [F.lit(f"agent:{agent}")] if agent else []
    return F.arrays_overlap(clean_tags(tags), F.array(*own, F.lit("shared")))


def tagged(tags: Column, wanted: list[str]) -> Column:
    """Whether any of the wanted tags is there."""
    return F.arrays_overlap(clean_tags(tags), F.array(*map(F.lit, wanted)))


def stored_tags(tags: Column, agent: str) -> Column:
    """Tags as they are stored: those of other agents give way to the storing agent's own."""
    return F.array_append(F.filter(clean_tags(tags), lambda t: ~t.startswith("agent:")), F.lit(f"agent:{agent}"))


def versions(rows: DataFrame) -> DataFrame:
    """(key, content_hash, number, last): entries of one content in order of time; each but the last is superseded when the next begins.

    A content may be stored again any number of times; rows of one content lie in one window frame, which is read in a stream.
    """
    w = Window.partitionBy("content_hash").orderBy(F.col("created").asc_nulls_first(), "key")
    following = F.lead(F.struct("created")).over(w)
    return rows.select("key", "content_hash", "created", F.row_number().over(w).alias("number"), following["created"].alias("superseded_at"), following.isNull().alias("last"))


def timeline(rows: DataFrame) -> DataFrame:
    """(entity, key, created): entries that have a content, by entity."""
    named = F.explode(F.array_distinct(F.filter(F.transform("entities", lambda e: F.lower(strip(e))), lambda e: e != "")))
    return rows.where("content IS NOT NULL AND trim(content) <> ''").select(named.alias("entity"), "key", "created", "content", "valid_until")


def with_updates(rows: DataFrame, updates: DataFrame, *columns: str) -> DataFrame:
    """Entries overlaid with an update log (key, ts, column, value): the last value of a column wins.

    The log is reduced to a row per key before the join; deleting is an anti join (``without``)."""
    last = updates.groupBy("key").agg(*[F.max_by("value", F.when(F.col("column") == c, F.col("ts"))).alias(f"new_{c}") for c in columns])
    joined = rows.join(last, "key", "left")
    kinds = dict(rows.dtypes)
    return joined.select(*[F.coalesce(F.col(f"new_{c}").try_cast(kinds[c]), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose key isn't among those to be deleted."""
    return rows.join(gone.select("key").distinct(), "key", "left_anti")


def feedback_totals(log: DataFrame) -> DataFrame:
    """(key, score) of a log of deltas; a row delivered again counts once, told by its write_id where there is one. Few keys hold most rows: partial sums come first."""
    return log.where("key IS NOT NULL").select("key", "ts", "delta", *[c for c in ("write_id",) if c in log.columns]).distinct().groupBy("key").agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("score"))
