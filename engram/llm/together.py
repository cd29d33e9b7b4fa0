"""Items that appear together in one record.

Baskets are lists within a row. A basket of up to ``block`` items emits its pairs directly. A larger one is cut into
chunks of ``block`` items; every pair of chunks becomes a row of its own, the rows are spread over all tasks, and each
multiplies out at most ``block`` x ``block`` pairs. Both streams meet in one partial aggregation (a hot pair becomes one
row per task before the shuffle), and association scores are computed on the pairs that reach the support.

Defined results: rows with a null key are no records; of several rows of one key the greatest list counts; null lists and
null or blank items don't count; repeats of an item in one basket count once; fewer than two items give no pair; an empty
table gives an empty result. Pairs are ordered by code point. Only key and items are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.terms import records


def baskets(df: DataFrame, key: str, items: str) -> DataFrame:
    """(rec, items): distinct items in order, of records with any."""
    return records(df, key, [items]).select("rec", F.array_sort(F.array_distinct("f0")).alias("items")).where(F.size("items") > 0)


def basket_pairs(lists: DataFrame, block: int = 64) -> DataFrame:
    """(a, b) once for each basket that holds both, a < b."""
    size = F.size("items")
    small = (
        lists.where(size.between(2, block))
        .select("items", F.posexplode("items").alias("i", "a"))
        .select("a", F.explode(F.slice("items", F.col("i") + 2, F.lit(block))).alias("b"))
    )
    chunks = F.ceil(size / block).cast("int")
    spread = (
        lists.where(size > block)
        .select("rec", "items", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("i"))
        .select("rec", "items", "i", F.explode(F.sequence(F.col("i"), chunks - 1)).alias("j"))
        .select("rec", "i", "j", *[F.slice("items", F.col(c) * block + 1, F.lit(block)).alias(f"x{c}") for c in "ij"])
        .repartition("rec", "i", "j")
    )
    large = spread.select(F.explode("xi").alias("a"), "xj").select("a", F.explode("xj").alias("b")).where("a < b")
    return small.unionByName(large)


def lift(n_ab: Column, n_a: Column, n_b: Column, total: Column) -> Column:
    """How many times more often than by chance; in doubles, since products of counts don't fit into 64 bits."""
    return n_ab.cast("double") * total.cast("double") / (n_a.cast("double") * n_b.cast("double"))


def appear_together(df: DataFrame, key: str, items: str, least: int = 1, block: int = 64) -> DataFrame:
    """(item_a, item_b, records, lift) of pairs in at least ``least`` records; lift is n_ab N / (n_a n_b)."""
    lists = baskets(df, key, items)
    total = lists.count()
    counts = lists.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    pairs = basket_pairs(lists, block).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= least)
    a, b = (counts.select(F.col("item").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    score = lift(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.lit(total))
    return pairs.join(a, "a").join(b, "b").select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), F.col("n_ab").alias("records"), score.alias("lift"))
