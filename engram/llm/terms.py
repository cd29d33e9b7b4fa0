"""Frequency of every distinct term, by vertical bitmaps.

Every record gets a shard and a dense number within it. For each (field, term, shard) the numbers of the records that
hold the term form one container: a sorted list of 16-bit numbers where few, a bitmap where many (the smaller of the
two). Beside it runs a counter of occurrences. Containers of different shards are disjoint, those of one shard merge by
union; the document frequency is the sum of the containers' cardinalities.

Scale: copies of a record collapse before the shuffle (partial aggregation), so a key that holds a third of the rows costs
one row per input partition. A term that stands in a third of all records has one container per shard, of at most
``shard_rows`` numbers or so. After the numbering, containers are built without a further shuffle (rows already lie by
shard); only (field, term, shard, cardinality, occurrences) is exchanged, after a partial sum.

Defined results: rows with a null key are no records; of several rows of one key the greatest list that isn't null counts;
null lists, null elements and blank ones hold no term; a term repeated in a list occurs as often, in one record. An empty
table gives an empty result. Columns other than key and the fields are never read, so clashing names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that are taken off both ends of a term.
BLANKS = " \t\r\n 　"
#: Up to so many numbers a list of two bytes each is smaller than a bitmap of 4096 bytes.
SPARSE_MOST = 2047


def term_list(column: Column) -> Column:
    """Terms of a list column: ends trimmed, lower case, without nulls and blanks; a null list is an empty one."""
    trimmed = F.transform(column, lambda x: F.lower(F.btrim(x, F.lit(BLANKS))))
    return F.coalesce(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def records(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key with its term lists."""
    narrow = df.where(F.col(key).isNotNull()).select(F.col(key).alias("rec"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    one = narrow.groupBy("rec").agg(*[F.max(f"f{i}").alias(f"f{i}") for i in range(len(fields))])
    return one.select("rec", *[term_list(F.col(f"f{i}")).alias(f"f{i}") for i in range(len(fields))])


def term_containers(df: DataFrame, key: str, fields: Sequence[str], shard_rows: int = 16384) -> DataFrame:
    """(field, term, shard, encoding, bits, occurrences): the vertical layout."""
    shards = max(1, math.ceil(df.select(key).count() / shard_rows))
    numbered = (
        records(df, key, fields)
        .withColumn("shard", F.pmod(F.xxhash64("rec"), F.lit(shards)).cast("int"))
        .withColumn("number", (F.row_number().over(Window.partitionBy("shard").orderBy("rec")) - 1).cast("int"))
    )
    lists = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("terms")) for i, f in enumerate(fields)]))
    postings = numbered.select("shard", "number", lists.alias("l")).select("shard", "number", "l.field", F.explode("l.terms").alias("term"))
    # A shard that outgrew the 2^15 numbers of a bitmap goes on in further containers.
    bucket = F.shiftright("number", 15).alias("part")
    ids = F.array_sort("ids")
    hexes = F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 4, "0")), "")
    return (
        postings.groupBy("shard", "field", "term", bucket)
        .agg(
            F.collect_set(F.col("number").bitwiseAND(0x7FFF)).alias("ids"),
            F.bitmap_construct_agg(F.col("number").bitwiseAND(0x7FFF).cast("long")).alias("dense"),
            F.count(F.lit(1)).alias("occurrences"),
        )
        .select(
            "field",
            "term",
            F.concat_ws(".", "shard", "part").alias("shard"),
            F.when(F.size("ids") <= SPARSE_MOST, "list").otherwise("bitmap").alias("encoding"),
            F.when(F.size("ids") <= SPARSE_MOST, F.to_binary(hexes, F.lit("hex"))).otherwise(F.col("dense")).alias("bits"),
            "occurrences",
        )
    )


def cardinality(encoding: Column, bits: Column) -> Column:
    """How many numbers a container holds."""
    return F.when(encoding == "list", (F.octet_length(bits) / 2).cast("long")).otherwise(F.bitmap_count(bits))


def merge_containers(*parts: DataFrame) -> DataFrame:
    """The union of containers over the same numbering, as bitmaps; occurrences add up (the parts must not share rows)."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    number = lambda i: F.conv(F.hex(F.substring(F.col("bits"), i * 2 + 1, F.lit(2))), 16, 10).cast("long")
    last = (F.octet_length("bits") / 2).cast("int") - 1
    lists = every.where("encoding = 'list'").select("field", "term", "shard", F.explode(F.transform(F.sequence(F.lit(0), last), number)).alias("n"))
    bitmaps = lists.groupBy("field", "term", "shard").agg(F.bitmap_construct_agg("n").alias("bits"))
    bitmaps = bitmaps.unionByName(every.where("encoding = 'bitmap'").select("field", "term", "shard", "bits"))
    union = bitmaps.groupBy("field", "term", "shard").agg(F.bitmap_or_agg("bits").alias("bits"))
    counters = every.groupBy("field", "term", "shard").agg(F.sum("occurrences").alias("occurrences"))
    return union.join(counters, ["field", "term", "shard"]).select("field", "term", "shard", F.lit("bitmap").alias("encoding"), "bits", "occurrences")


def term_frequencies(df: DataFrame, key: str, fields: Sequence[str], rare_most: int = 2, common_share: float = 0.05) -> DataFrame:
    """(field, term, occurrences, records, mark) of every term.

    mark is ``rare`` at ``rare_most`` records or fewer, ``common`` at ``common_share`` of all records (with or without
    lists) or more, null between; where a small table makes a term both, it is ``common``.
    """
    total = df.agg(F.countDistinct(key)).first()[0]
    counted = (
        term_containers(df, key, fields)
        .groupBy("field", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum(cardinality(F.col("encoding"), F.col("bits"))).alias("records"))
    )
    mark = F.when(F.col("records") >= F.lit(common_share * total), "common").when(F.col("records") <= rare_most, "rare")
    return counted.select("field", "term", "occurrences", "records", mark.alias("mark"))
