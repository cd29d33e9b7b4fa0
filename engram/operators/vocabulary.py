"""Vocabulary: document frequencies, pairs of words and entities, synonyms, dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.functions import text as X
from engram.params import DEFAULT, Params


def words(rows: DataFrame) -> DataFrame:
    """(key, words): distinct content terms of each entry, in order."""
    return rows.select("key", F.array_sort(F.array_distinct(X.content_terms(F.col("content")))).alias("words"))


def document_frequency(rows: DataFrame) -> DataFrame:
    return words(rows).select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def pairs(lists: DataFrame, items: str, a: str, b: str) -> DataFrame:
    """(a, b, n): in how many rows two items stand together; items must be distinct and in order. Partial counts come before the shuffle."""
    opened = lists.where(F.size(items) > 1).select(items, F.posexplode(items).alias("i", a))
    return opened.select(a, F.explode(F.slice(items, F.col("i") + 2, F.size(items))).alias(b)).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def entity_lists(rows: DataFrame) -> DataFrame:
    low = F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.lower(X.strip(e)))
    return rows.select("key", F.array_sort(F.array_distinct(F.filter(low, lambda e: e.isNotNull() & (e != "")))).alias("entities"))


def entity_pairs(rows: DataFrame) -> DataFrame:
    return pairs(entity_lists(rows), "entities", "entity_a", "entity_b")


def synonyms(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(word_a, word_b, n, jaccard): frequent words that stand together often enough or mostly.

    Starting from pairs that were seen is the same as comparing all words: a pair never seen has a Jaccard of 0. Words
    below the frequency are taken out of the lists before pairs are made.
    """
    df = document_frequency(rows).where(F.col("df") >= p.synonym_frequency)
    kept = words(rows).select("key", F.explode("words").alias("word")).join(df.select("word"), "word").groupBy("key").agg(F.array_sort(F.collect_list("word")).alias("words"))
    a, b = (df.select(F.col("word").alias(f"word_{x}"), F.col("df").alias(f"df_{x}")) for x in "ab")
    near = pairs(kept, "words", "word_a", "word_b").join(a, "word_a").join(b, "word_b").withColumn("jaccard", F.round(F.col("n") / (F.col("df_a") + F.col("df_b") - F.col("n")), 6))
    return near.where((F.col("jaccard") >= p.synonym_jaccard) | (F.col("n") >= p.synonym_together)).select("word_a", "word_b", "n", "jaccard")


def merged_synonyms(found: DataFrame, manual: DataFrame) -> DataFrame:
    """(term, synonym) both ways; a term with manual synonyms keeps just those."""
    both = found.select(F.col("word_a").alias("term"), F.col("word_b").alias("synonym")).unionByName(found.select(F.col("word_b").alias("term"), F.col("word_a").alias("synonym")))
    own = manual.select(F.lower("term").alias("term"), F.lower("synonym").alias("synonym")).distinct()
    return own.unionByName(both.join(own.select("term").distinct(), "term", "left_anti")).distinct()


def synonym_edges(table: DataFrame, term: str = "term", listed: str = "synonyms") -> DataFrame:
    """(term, synonym) of a table whose synonyms are JSON arrays, both ways, in lower case."""
    one = table.select(F.lower(term).alias("term"), F.explode(F.from_json(listed, "array<string>")).alias("s")).select("term", F.lower("s").alias("synonym")).where("synonym IS NOT NULL")
    return one.unionByName(one.select(F.col("synonym").alias("term"), F.col("term").alias("synonym"))).distinct()


def synonym_rows(edges: DataFrame) -> DataFrame:
    """(term, synonyms): JSON arrays, as they are kept. A term's synonyms are those above a frequency, a short list."""
    return edges.groupBy("term").agg(F.to_json(F.array_sort(F.collect_set("synonym"))).alias("synonyms"))


def dictionary(rows: DataFrame, known: DataFrame, least: int = 2, floor: int = 3) -> DataFrame:
    """(word, freq): document frequencies of at least ``least``; terms of the synonym table count at least ``floor``."""
    terms = known.select(F.explode(F.array("term", "synonym")).alias("word")).distinct().withColumn("known", F.lit(floor))
    both = document_frequency(rows).join(terms, "word", "full")
    return both.select("word", F.greatest(F.coalesce("df", F.lit(0)), F.coalesce("known", F.lit(0))).cast("long").alias("freq")).where(F.col("freq") >= least)


def dictionary_lines(words_: DataFrame) -> DataFrame:
    """Lines of a tokenizer's dictionary; to be written with ``write.text``."""
    return words_.select(F.concat_ws(" ", "word", F.col("freq").cast("string"), F.lit("nz")).alias("value"))


def keywords(rows: DataFrame, most: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, word, n, place): the most frequent keywords of each entry; ties by first place in the text. ``carry`` names columns of the entry to be kept."""
    opened = rows.select("key", *carry, F.posexplode(X.keyword_occurrences(F.col("content"))).alias("at", "word"))
    found = opened.groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), *[F.max(c).alias(c) for c in carry])
    w = Window.partitionBy("key").orderBy(F.desc("n"), F.asc("at"))
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("key", "word", "n", "place", *carry)
