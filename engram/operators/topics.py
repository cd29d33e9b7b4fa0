"""Topic scores with whole-set lifetimes, attention, and what of them an entry's text mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import text as X
from engram.functions.weights import age_days
from engram.operators import vocabulary as V
from engram.params import DEFAULT, Params

#: Days without any write after which a whole set is gone.
LIFETIMES = {"all": 7, "daily": 2, "weekly": 14}


def sessions(log: DataFrame, days: int) -> DataFrame:
    """The times over which a set lives on: every write prolongs the whole set's life by ``days``.

    Sessions are made from (hour, first, last, rows) summaries, a table whose size is the log's time span and not its
    rows, so that the one global ordering they need is over few rows.
    """
    hours = log.where("ts IS NOT NULL").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("hour")
    before = F.lag("last").over(w)
    begins = before.isNull() | (F.col("first") >= before + F.expr(f"INTERVAL {days} DAYS"))
    numbered = hours.withColumn("begins", begins.cast("int")).withColumn("session", F.sum("begins").over(w))
    return numbered.groupBy("session").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("writes"))


def current(log: DataFrame, period: str, p: Params = DEFAULT) -> DataFrame:
    """Rows of the log in the set's current life; none if it has ended by ``as_of``. An unknown period is ``all``."""
    days = LIFETIMES.get(period, LIFETIMES["all"])
    spans = sessions(log.where(F.col("ts") < F.lit(p.as_of).cast("timestamp")), days)
    last = spans.agg(F.max(F.struct("last", "first")).alias("s")).first().s  # one row
    if last is None:
        return log.where("false")
    rows = log.where(F.col("ts").between(F.lit(last["first"]), F.lit(last["last"])))
    alive = F.lit(last["last"]) + F.expr(f"INTERVAL {days} DAYS") > F.lit(p.as_of).cast("timestamp")
    return rows.where(alive)


def writes(log: DataFrame) -> DataFrame:
    """(topic, ts, weight) of the log, topics in lower case, rows delivered again once (told by their write_id, where there is one), no null topics; a null weight is 1."""
    own = [c for c in ("write_id",) if c in log.columns]
    return log.where("topic IS NOT NULL AND trim(topic) <> ''").select(F.lower(X.strip(F.col("topic"))).alias("topic"), "ts", F.coalesce("weight", F.lit(1.0)).alias("weight"), *own).distinct().drop(*own)


def scores(log: DataFrame) -> DataFrame:
    """(topic, score, last_seen). A topic that holds a large part of the log is summed up in part before the shuffle."""
    return log.groupBy("topic").agg(F.sum(F.col("weight").cast("decimal(18,6)")).cast("double").alias("score"), F.max("ts").alias("last_seen"))


def top(scored: DataFrame, limit: int) -> DataFrame:
    """The highest scores; ties go to the topic that comes last."""
    return scored.orderBy(F.desc("score"), F.desc("topic")).limit(limit)


def attention(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(topic, score): the five keywords of each entry, each adding a base and a part of the entry's intensity."""
    words = V.keywords(rows, carry=("intensity",)).where(F.length("word") >= 2)
    gained = p.attention_base + F.coalesce(F.col("intensity"), F.lit(0.0)) * p.attention_emotion
    return words.select(F.col("word").alias("topic"), gained.alias("gain")).groupBy("topic").agg(F.sum(F.col("gain").cast("decimal(18,6)")).cast("double").alias("score"))


def topic_list(topics: DataFrame, limit: int) -> list:
    """At most ``limit`` topics, as rows on the driver."""
    return top(topics, limit).collect()


def hot_hits(content: Column, hot: list, p: Params = DEFAULT) -> Column:
    """What the hot topics in a text add up to: each that occurs counts less the longer it wasn't seen.

    There are at most ``hot_topics`` of them, so they go into the expression: no join, no shuffle."""
    low = F.lower(F.coalesce(content, F.lit("")))
    hits = F.lit(0.0)
    for r in hot:
        if len(r.topic) >= 2:
            weight = F.coalesce(F.pow(F.lit(2.0), -F.greatest(age_days(F.lit(r.last_seen), p.as_of), F.lit(0.0)) / p.topic_half_life_days), F.lit(0.5)) if r.last_seen else F.lit(0.5)
            hits += F.when(F.contains(low, F.lit(r.topic)), weight).otherwise(0.0)
    return hits


def matched_attention(content: Column, listed: list) -> tuple[Column, float]:
    """Scores of the listed topics that occur in a text, and of all listed."""
    low = F.lower(F.coalesce(content, F.lit("")))
    matched = F.lit(0.0)
    for r in listed:
        matched += F.when(F.contains(low, F.lit(r.topic)), float(r.score)).otherwise(0.0)
    return matched, float(sum(r.score for r in listed))
