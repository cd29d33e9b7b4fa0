import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions import text as X
from engram.functions import weights as W
from engram.operators import chunks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, TYPES(values))))
    return df.select(column.alias("x")).first().x


def TYPES(values):
    kinds = {str: "string", float: "double", int: "bigint", list: "array<string>", type(None): "string"}
    return [kinds[type(v)] for v in values.values()]


@pytest.mark.parametrize(
    "text, strength, label",
    [("", 0.0, "neutral"), ("plain text", 0.0, "neutral"), ("真的吗?!", 0.55, "neutral"), ("AAA!!", 0.6, "neutral"), ("WHY??? this is TERRIBLE!!", 1.45, "strong_negative"), ("This is great", 0.2, "positive"), ("great, I know", 0.0, "negative"), ("abab xyxyxy", 0.4, "neutral"), ("太好了！！！！非常非常满意", 1.1, "positive"), (None, 0.0, "neutral")],
)
def test_intensity(spark, text, strength, label):
    c = F.col("t")
    assert one(spark, X.intensity(c), t=text) == pytest.approx(strength)
    assert one(spark, X.intensity_label(c, X.intensity(c)), t=text) == label


@pytest.mark.parametrize("text, polarity", [("很好用，推荐", 1.0), ("不推荐", -1.0), ("good but bad", -0.111111), ("", 0.0), (None, 0.0)])
def test_sentiment(spark, text, polarity):
    assert one(spark, X.sentiment(F.col("t")), t=text) == pytest.approx(polarity, abs=1e-6)


@pytest.mark.parametrize("days, weight", [(-5, 1.0), (0, 1.0), (30, 0.707107), (60, 0.5), (120, 0.25), (None, 0.01)])
def test_decay(spark, days, weight):
    at = F.lit("2026-02-05 00:00:00").cast("timestamp") - F.make_interval(days=F.col("d")) if days is not None else F.lit(None).cast("timestamp")
    assert spark.createDataFrame([(days or 0,)], "d int").select(W.decay(at).alias("x")).first().x == pytest.approx(weight, abs=1e-6)


@pytest.mark.parametrize("score, weight", [(5, 1.3), (3, 1.3), (1, 1.1), (0, 1.0), (-1, 0.833333), (-2, 0.666667), (-3, 0.5), (-9, 0.5)])
def test_feedback(spark, score, weight):
    assert one(spark, W.feedback_weight(F.col("s")), s=score) == pytest.approx(weight, abs=1e-6)


@pytest.mark.parametrize("value, weight", [(-1.0, 0.6), (0.0, 1.0), (0.55, 1.22), (2.0, 1.8), (3.0, 1.8)])
def test_emotion(spark, value, weight):
    assert one(spark, W.emotion_weight(F.col("s")), s=value) == pytest.approx(weight)


@pytest.mark.parametrize("hits, weight", [(0.0, 1.0), (0.9, 1.0), (1.0, 1.066667), (1.5, 1.1), (3.0, 1.2), (7.0, 1.2)])
def test_hot(spark, hits, weight):
    assert one(spark, W.hot_weight(F.col("s")), s=hits) == pytest.approx(weight, abs=1e-6)


def test_attention_and_distance(spark):
    assert one(spark, W.attention_weight(F.col("a"), F.lit(6.0)), a=3.0) == pytest.approx(1.25)
    assert one(spark, W.attention_weight(F.col("a"), F.lit(0.0)), a=3.0) == 1.0
    for d, s in ((0.0, 1.0), (0.5, 0.75), (1.0, 0.5), (2.0, 0.0), (2.4, 0.0)):
        assert one(spark, W.similarity_of_distance(F.col("d")), d=d) == pytest.approx(s)


def test_sets(spark):
    grams = lambda a, b: one(spark, X.jaccard(X.ngrams(F.col("a")), X.ngrams(F.col("b"))), a=a, b=b)
    assert (grams("abcd", "bcde"), grams("a", "abc"), grams("aaaa", "aa")) == (0.5, 0.0, 1.0)
    assert one(spark, X.jaccard(F.col("a"), F.col("b")), a=["a", "b"], b=["b", "c"]) == pytest.approx(1 / 3)
    assert one(spark, X.jaccard(F.col("a"), F.col("b")), a=[], b=["a"]) == 0.0
    assert one(spark, X.content_hash(F.col("a")), a="hello") == "2cf24dba5fb0"


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="检索 Foo-Bar größe 12号") == ["检索", "foo", "bar", "größe", "12", "号"]
    assert one(spark, X.tokens(F.col("t")), t="数据流水线") == ["数据", "据流", "流水", "水线"]
    assert one(spark, X.tokens(F.col("t")), t=None) == []


def test_entities(spark):
    assert one(spark, X.entities(F.col("t")), t="BTC和macd，小米公司，63000，BTC/USD") == ["BTC", "BTC/USD", "MACD", "小米", "63000"]
    assert one(spark, X.entities(F.col("t")), t=None) == []


def test_abbreviations(spark):
    for t, yes in (("see Dr.", True), ("the end.", False), ("etc.", True), (None, False)):
        assert one(spark, X.is_abbreviation(F.col("t")), t=t) is yes
    assert one(spark, X.ends_with_numeral(F.col("t")), t="version 2.") is True


def test_chunks():
    assert chunks.pieces("first paragraph\n\nsecond paragraph") == ["first paragraph", "second paragraph"]
    assert chunks.pieces(None) == chunks.pieces("short") == []
    assert chunks.sentences("Dr. Who came. He left at 3. 5 minutes later! 好。") == ["Dr. Who came.", "He left at 3. 5 minutes later!好。"]
    long = " ".join(f"This is sentence number {i} of many." for i in range(60))
    assert all(len(x) <= 500 for x in chunks.pieces(long))
    assert " ".join(chunks.pieces(long)) == long


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=2000))
def test_chunks_keep_order(text):
    out = chunks.pieces(text)
    assert all(len(x) >= 10 for x in out)


def test_jaccard_laws(spark):
    lists = [[], ["a"], ["a", "b"], ["b", "c", "c"], ["d"], None]
    df = spark.createDataFrame([(x, y) for x in lists for y in lists], "a array<string>, b array<string>")
    for r in df.select(X.jaccard(F.col("a"), F.col("b")).alias("x"), X.jaccard(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.x == r.y and 0 <= r.x <= 1
