from collections import Counter
from itertools import combinations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.llm import terms, together

SCHEMA = "key string, tags array<string>, entities array<string>, term string, field string"


def table(spark, rows):
    return spark.createDataFrame([(k, t, e, "clash", "clash") for k, t, e in rows], SCHEMA)


ROWS = [("a", ["X ", "x", None, " ", "y"], None), ("a", ["X ", "x", None, " ", "y"], None), ("b", None, ["P", "q", "Q"]), ("c", [], ["p"]), (None, ["z"], ["z"]), ("d", ["y"], ["q", "p", "r"])]


def test_counts_and_marks(spark):
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(table(spark, ROWS), "key", ["tags", "entities"], 1, 0.5).collect()}
    assert got == {("tags", "x"): (2, 1, "rare"), ("tags", "y"): (2, 2, "common"), ("entities", "p"): (3, 3, "common"), ("entities", "q"): (3, 2, "common"), ("entities", "r"): (1, 1, "rare")}


def test_empty(spark):
    assert terms.term_frequencies(table(spark, []), "key", ["tags"]).count() == 0
    assert together.appear_together(table(spark, []), "key", "entities").count() == 0


def test_both_encodings_and_union(spark):
    df = spark.range(6000).select(F.col("id").cast("string").alias("key"), F.array(F.lit("all"), F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("tags"))
    boxes = terms.term_containers(df, "key", ["tags"], shard_rows=100_000)
    kinds = {r.encoding for r in boxes.select("encoding").distinct().collect()}
    assert kinds == {"list", "bitmap"}
    counted = lambda b: {r.term: r.n for r in b.groupBy("term").agg(F.sum(terms.cardinality(F.col("encoding"), F.col("bits"))).alias("n")).collect()}
    assert counted(boxes) == {"all": 6000, **{f"t{i}": 120 for i in range(50)}}
    halves = [boxes.where(F.pmod(F.xxhash64("term"), F.lit(2)) == i) for i in (0, 1)]
    merged = terms.merge_containers(*halves)
    assert counted(merged) == counted(boxes)
    assert counted(terms.merge_containers(boxes, boxes)) == counted(boxes)  # a union, not a sum
    assert merged.agg(F.sum("occurrences")).first()[0] == 12000


def test_many_shards(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.array(F.lit("hot")).alias("tags"))
    df = df.unionByName(spark.range(500).select(F.lit("7").alias("key"), F.array(F.lit("hot")).alias("tags")))  # a key with a third of all rows
    assert [(r.occurrences, r.records) for r in terms.term_frequencies(df, "key", ["tags"]).collect()] == [(1000, 1000)]
    assert terms.term_containers(df, "key", ["tags"], shard_rows=50).count() > 10


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([" a", "A", "b", "c", "d", "e", "f", None, ""]), max_size=9), max_size=12), st.integers(1, 5))
def test_pairs_against_brute_force(spark, lists, block):
    df = table(spark, [(str(i), None, x) for i, x in enumerate(lists)])
    sets = [sorted({x.strip().lower() for x in items if x and x.strip()}) for items in lists]
    sets = [s for s in sets if s]
    one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in combinations(s, 2))
    want = {p: (n, round(n * len(sets) / (one[p[0]] * one[p[1]]), 6)) for p, n in two.items()}
    got = {(r.item_a, r.item_b): (r.records, round(r.lift, 6)) for r in together.appear_together(df, "key", "entities", block=block).collect()}
    assert got == want


def test_huge_basket(spark):
    items = [f"i{n:04d}" for n in range(300)]
    df = table(spark, [("a", None, items + items), ("b", None, items[:2]), ("b", None, items[:2])])
    got = together.appear_together(df, "key", "entities", block=64)
    assert got.count() == 300 * 299 // 2
    assert [(r.item_a, r.item_b) for r in got.where("records = 2").collect()] == [("i0000", "i0001")]


def test_lift_of_billions_of_records(spark):
    many = 5_000_000_000
    df = spark.createDataFrame([(many, many, many, many), (3_000_000_000, 4_000_000_000, 4_000_000_000, many), (20, 20, many, many)], "ab long, a long, b long, n long")
    got = [r.x for r in df.select(together.lift(*map(F.col, ("ab", "a", "b", "n"))).alias("x")).collect()]
    assert got == [1.0, 3e9 * 5e9 / (4e9 * 4e9), 1.0]
