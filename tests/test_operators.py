import pytest
from pyspark.sql import functions as F

from engram.params import Params
from engram.operators import components as C
from engram.operators import entries as E
from engram.operators import maintain as M
from engram.operators import search as S
from engram.operators import topics as T
from engram.operators import vocabulary as V

ENTRY = "key string, content_hash string, content string, tags array<string>, source string, created timestamp, fragment_type string, intensity double, feedback_score bigint, entities array<string>, level int, valid_until timestamp, invalid_at timestamp, corrected_at timestamp"


def entries(spark, *rows):
    names = [c.split()[0] for c in ENTRY.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ENTRY)


def ts(spark, s):
    import datetime

    return datetime.datetime.fromisoformat(s) if s else None


def test_fusion(spark):
    rows = spark.createDataFrame([("q", x, l, p, x) for l, items in ((1, "abc"), (2, "bda")) for p, x in enumerate(items, 1)], "qid string, item string, list int, place int, key string")
    got = {r.item: round(r.fused, 6) for r in S.fuse(rows, 60, 5).collect()}
    assert got == {"b": 0.032522, "a": 0.032266, "d": 0.016129, "c": 0.015873}


def test_bm25_golden(spark):
    rows = entries(spark, {"key": "1", "content": "x x a b"}, {"key": "2", "content": "x c"}, {"key": "3", "content": "d e f"}, {"key": "4", "content": None})
    terms = spark.createDataFrame([("q", "x", "x")], "qid string, query string, term string")
    assert {r.key: r.score for r in S.bm25(rows, terms).collect()}["1"] == pytest.approx(0.590862, abs=1e-6)
    assert S.bm25(rows.where("false"), terms).count() == 0


def test_nearest_is_exact_with_ties(spark):
    base = spark.createDataFrame([(f"{i:03d}", [float(i % 7), 1.0, float(i % 3)]) for i in range(50)], "id string, v array<double>")
    got = S.nearest(base, base.where("id < '005'").withColumnRenamed("id", "qid"), 4, chunk=7, block=2).collect()
    assert len(got) == 20 and all(r.qid != r.id for r in got)
    first = [r for r in got if r.qid == "000" and r.place == 1][0]
    assert first.id == "021" and first.distance == 0


def test_components(spark):
    links = [(f"{i:04d}", f"{i + 1:04d}") for i in range(0, 60) if i != 29] + [("x", "x"), ("hub", "0010")] + [("star", f"s{i}") for i in range(30)]
    labels, kept = C.components(spark.createDataFrame(links, "a string, b string"), "a", "b")
    got = {r.node: r.component for r in labels.collect()}
    assert got["0029"] == got["hub"] == "0000" and got["0060"] == got["0030"] == "0030" and got["star"] == "s0" and "x" not in got
    assert len(got) == labels.count() == 61 + 1 + 31
    empty, _ = C.components(spark.createDataFrame([], "a string, b string"), "a", "b")
    assert empty.count() == 0


def test_leader_groups_match_the_sequential_pass(spark):
    import random

    rng = random.Random(5)
    words = [f"word{chr(97 + i)}{chr(97 + i)}x" for i in range(12)]
    data = [{"key": f"k{i:03d}", "content": " ".join(rng.sample(words, 5)), "created": ts(spark, f"2025-01-{1 + i % 28:02d}")} for i in range(120)]
    df = entries(spark, *data)
    got = {r.key: r.leader for r in M.leader_groups(df).collect()}
    sets = {}
    for r in V.keywords(df).collect():
        sets.setdefault(r.key, set()).add(r.word)
    order = sorted(data, key=lambda d: (d["created"], d["key"]))
    want, taken = {}, set()
    for a in order:
        if a["key"] in taken or a["key"] not in sets:
            continue
        mine = [b["key"] for b in order if b["key"] not in taken and b["key"] != a["key"] and len(sets[a["key"]] & sets.get(b["key"], set())) >= 2]
        taken.add(a["key"])
        if mine:
            taken.update(mine)
            want.update({k: a["key"] for k in [a["key"], *mine]})
    assert got == want


def test_merge_and_consume(spark):
    rows = entries(spark, {"key": "a", "content": "alpha text", "tags": ["x", "session:1", None, " y "], "level": 1}, {"key": "b", "content": None, "tags": None, "level": None})
    groups = spark.createDataFrame([("a", "a"), ("a", "b")], "leader string, key string")
    m = M.merge_groups(groups, rows).collect()[0]
    assert (m.content, m.tags, m.level, m.sources) == ("- alpha text", ["x", "y"], 2, ["a", "b"])
    log = M.consumed(M.merge_groups(groups, rows))
    assert log.count() == 6
    after = E.with_updates(rows, log, "fragment_type")
    assert [r.fragment_type for r in after.orderBy("key").collect()] == ["consumed", "consumed"]


def test_versions_and_updates(spark):
    rows = entries(spark, *[{"key": k, "content_hash": "h", "created": ts(spark, t)} for k, t in (("h", "2025-01-01"), ("h:2", "2025-02-01"), ("h:3", "2025-02-01"), ("h:0", None))])
    got = [(r.key, r.number, r.last) for r in E.versions(rows).orderBy("number").collect()]
    assert got == [("h:0", 1, False), ("h", 2, False), ("h:2", 3, False), ("h:3", 4, True)]
    log = spark.createDataFrame([("h", 1, "feedback_score", "3"), ("h", 2, "feedback_score", "4"), ("h:2", 1, "feedback_score", "no number"), ("gone", 1, "feedback_score", "1")], "key string, ts int, column string, value string")
    assert {r.key: r.feedback_score for r in E.with_updates(rows, log, "feedback_score").collect()} == {"h": 4, "h:2": None, "h:3": None, "h:0": None}


def test_sessions(spark):
    log = spark.createDataFrame([("a", ts(spark, t), 1.0) for t in ("2026-01-01 00:00:00", "2026-01-02 23:59:59", "2026-01-05 00:00:00", "2026-02-04 10:00:00")], "topic string, ts timestamp, weight double")
    spans = sorted((str(r["first"]), r.writes) for r in T.sessions(log, 2).collect())
    assert spans == [("2026-01-01 00:00:00", 2), ("2026-01-05 00:00:00", 1), ("2026-02-04 10:00:00", 1)]
    assert T.current(log, "daily").count() == 1 and T.current(log, "no such period").count() == 1
    assert T.current(log.where("ts < '2026-01-10'"), "all").count() == 0
    assert T.current(log.where("false"), "all").count() == 0


def test_feedback_counts_rows_once(spark):
    log = spark.createDataFrame([("a", ts(spark, "2026-01-01"), 1), ("a", ts(spark, "2026-01-01"), 1), ("a", ts(spark, "2026-01-02"), -2), ("b", ts(spark, "2026-01-01"), None), (None, None, 1)], "key string, ts timestamp, delta bigint")
    assert {r.key: r.score for r in E.feedback_totals(log).collect()} == {"a": -1, "b": 0}


def test_forget_reasons(spark):
    old, new = ts(spark, "2025-01-01"), ts(spark, "2026-02-01")
    rows = entries(
        spark,
        {"key": "1", "fragment_type": "consolidated"}, {"key": "2", "source": "own", "feedback_score": 0}, {"key": "3", "source": "own", "feedback_score": -1, "created": old}, {"key": "4", "feedback_score": 1},
        {"key": "5", "created": new}, {"key": "6", "created": old, "intensity": 0.3}, {"key": "7", "content": "about topic", "created": old}, {"key": "8"},
    )
    listed = spark.createDataFrame([("topic", 5.0)], "topic string, score double").collect()
    got = {r.key: r.d for r in rows.select("key", M.forget_decision(["own"], listed).alias("d")).collect()}
    assert got == {"1": "consolidated", "2": "protected source", "3": "forget", "4": "liked", "5": "recent", "6": "intense", "7": "attended", "8": "forget"}


def test_distilled_items(spark):
    answers = ['Sure: [{"content": "a long enough fact", "category": "fact"}, {"content": "short"}] done', "no list", None, "[broken"]
    df = spark.createDataFrame([(a,) for a in answers], "a string").select(M.distilled_items(F.col("a")).alias("x"))
    assert [[i.content for i in r.x] for r in df.collect()] == [["a long enough fact"], [], [], []]


def test_dedup_marks_the_older(spark):
    text = "the quick deployment finished on staging cluster yesterday"
    rows = entries(spark, {"key": "new", "content": text, "created": ts(spark, "2025-02-01"), "entities": ["S"]}, {"key": "old", "content": text + " evening", "created": ts(spark, "2025-01-01"), "entities": ["S"]}, *[{"key": f"o{i}", "content": f"other words entirely number{i} thing{i}"} for i in range(6)])
    assert [(r.key, r.kept) for r in M.dedup_marks(rows).collect() if r.key in ("new", "old")] in ([], [("old", "new")])
    again = M.dedup_eligible(rows, spark.createDataFrame([("old",)], "key string"))
    assert again.count() == 7


def test_visibility_and_tags(spark):
    df = spark.createDataFrame([("a", ["agent:x"]), ("b", [" shared "]), ("c", None), ("d", ["agent:y", None, ""])], "key string, tags array<string>")
    seen = lambda c: {r.key for r in df.where(c).collect()}
    assert seen(E.visible_to(F.col("tags"), "x")) == {"a", "b"} and seen(E.visible_to(F.col("tags"), None)) == {"b"}
    assert seen(E.visible_to(F.col("tags"), None, primary=True)) == {"a", "b", "c", "d"}
    assert {r.key: r.t for r in df.select("key", E.stored_tags(F.col("tags"), "x").alias("t")).collect()}["d"] == ["agent:x"]


def test_backfill_and_missing(spark):
    rows = entries(spark, {"key": "a", "content": "text"}, {"key": "b", "content": "text two"}, {"key": "c", "content": " "})
    vectors = spark.createDataFrame([("a", "m", [1.0])], "key string, model string, embedding array<float>")
    keys = M.missing_vectors(rows, vectors, "m")
    assert [r.key for r in keys.collect()] == ["b"]
    assert [(r.key, r.embedding) for r in M.backfill(rows, keys, lambda ts: [[float(len(t))] for t in ts], "m").collect()] == [("b", [8.0])]


def test_synonym_tables(spark):
    table = spark.createDataFrame([("A", '["b", "C"]'), ("d", "no json")], "term string, synonyms string")
    edges = V.synonym_edges(table)
    assert {(r.term, r.synonym) for r in edges.collect()} == {("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")}
    found = spark.createDataFrame([("a", "x"), ("y", "z")], "word_a string, word_b string")
    merged = {(r.term, r.synonym) for r in V.merged_synonyms(found, edges.where("term = 'a'")).collect()}
    assert merged == {("a", "b"), ("a", "c"), ("x", "a"), ("y", "z"), ("z", "y")}


def test_every_character_is_in_a_batch(spark):
    said = {1: "first " + "a" * 50, 2: "b" * 230, 3: "third " + "c" * 60, 4: "last " + "d" * 60}
    messages = spark.createDataFrame([(i, "user", t) for i, t in said.items()], "id bigint, role string, content string")
    p = Params(distill_chars=100, distill_most=120)
    got = M.conversations(M.turns(messages, None, p), p).collect()
    assert all(len(r.text) <= 100 for r in got) and sum(r.messages for r in got) == 4
    every = "".join(r.text for r in got)
    assert all(every.count(c) >= n for c, n in (("a", 50), ("b", 230), ("c", 60), ("d", 60)))


def test_dedup_marks_all_copies_of_a_large_group(spark):
    text = "the quick deployment finished on staging cluster yesterday"
    rows = entries(spark, *[{"key": f"k{i:02d}", "content": text, "created": ts(spark, f"2025-01-{1 + i // 2:02d}"), "intensity": 0.5} for i in range(50)], *[{"key": f"o{i}", "content": f"other words entirely number{i} thing{i}"} for i in range(200)])
    got = {r.key: r.kept for r in M.dedup_marks(rows).collect() if r.key < "l"}
    assert set(got) == {f"k{i:02d}" for i in range(49)}
