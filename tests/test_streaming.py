import pandas as pd
from pyspark.sql import functions as F

from engram.streaming import jobs as J


def test_turns_are_read_once(spark, tmp_path):
    schema = "id bigint, role string, content string, ts timestamp"
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda *rows: spark.createDataFrame([(i, "user", c, None) for i, c in rows], schema).write.mode("append").parquet(source)
    write((1, "a message that is long enough"), (2, "short"))
    J.write_turns(spark, source, target, str(tmp_path / "cp"))
    assert J.turns(spark, target).count() == 1
    write((1, "a message that is long enough"), (3, "another message, long enough"))
    J.write_turns(spark, source, target, str(tmp_path / "cp"))
    assert sorted(r.id for r in J.turns(spark, target).collect()) == [1, 3]
    J.write_turns(spark, source, target, str(tmp_path / "cp"))
    assert spark.read.parquet(target).count() == 3


def test_scores_go_on(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    t = pd.Timestamp("2026-01-01")
    write = lambda *rows: spark.createDataFrame([(x, t.to_pydatetime(), w) for x, w in rows], "topic string, ts timestamp, weight double").write.mode("append").parquet(source)
    write(("A", 1.5), (None, 1.0), ("a", 1.5))
    J.write_topic_scores(spark, source, target, str(tmp_path / "cp"))
    assert [(r.topic, r.score) for r in J.latest(spark, target).collect()] == [("a", 1.5)]
    write(("b", None), ("a", 1.3))
    J.write_topic_scores(spark, source, target, str(tmp_path / "cp"))
    assert sorted((r.topic, r.score) for r in J.latest(spark, target).collect()) == [("a", 2.8), ("b", 1.0)]


def test_superseded_keeps_state(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    write = lambda *rows: spark.createDataFrame([(k, "h", pd.Timestamp(c).to_pydatetime()) for k, c in rows], "key string, content_hash string, created timestamp").write.mode("append").parquet(source)
    go = lambda: J.run(J.superseded(J.stream(spark, source)), str(tmp_path / "cp"), lambda df, n: df.write.mode("overwrite").parquet(f"{target}/batch={n}"))
    write(("h", "2025-01-01"))
    go()
    write(("h:1", "2025-02-01"), ("h:1", "2025-02-01"))
    go()
    assert [(r.key, r.superseded_by) for r in spark.read.parquet(target).collect()] == [("h", "h:1")]


def test_progress_line(spark):
    df = spark.createDataFrame([("1|tag|a|b",), ("1|tag",), (None,)], "m string")
    assert [r.x for r in df.select(J.progress_line(F.col("m")).alias("x")).collect()] == ["tag a|b", "tag", ""]


def test_session_board_is_a_valid_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", pd.Timestamp("2026-01-01").to_pydatetime(), 1.0)], "topic string, ts timestamp, weight double").write.parquet(source)
    seen = []
    J.run(J.session_board(J.stream(spark, source), 2), str(tmp_path / "cp"), lambda df, n: seen.extend(df.collect()), "complete")
    assert seen and seen[-1].writes == 1
