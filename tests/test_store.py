import json

import pytest
from pyspark.sql import functions as F

from engram.params import Params
from engram.sources import config, schema
from engram.store import MemoryStore, embedder, register_embedder

P = Params(as_of="2026-02-05 00:00:00", synonym_frequency=2)


class Letters:
    """Counts of letters as a vector."""

    model = "letters"

    def __call__(self, texts):
        return [[float(t.lower().count(chr(97 + i))) + 0.01 for i in range(26)] for t in texts]


def rows(spark, *texts, at="2026-02-04 12:00:00", tags=("shared",)):
    return spark.createDataFrame([(t, list(tags), "fact", "chat") for t in texts], "content string, tags array<string>, category string, source string").withColumn("created", F.lit(at).cast("timestamp"))


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Many small plans: compiling them would take most of the time."""
    names = {"spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture()
def store(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path), "main", params=P)
    s.store(rows(spark, "The gateway of BTC exchange restarts every night", "The parser reads the quarterly report", "数据流水线每天早上更新", " ", None))
    return s


def test_store_and_search(spark, store):
    assert store.entries().count() == 3
    hit = store.search("gateway exchange").orderBy("place").first()
    assert hit.content.startswith("The gateway") and "BTC" in hit.entities and hit.tags == ["shared", "agent:main"]
    assert store.search("流水线").count() == 1 and store.search("nothing like it zzz").count() == 0
    assert store.search("gateway", tags=["no such tag"]).count() == 0


def test_empty_store(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path / "new"), "main", params=P)
    assert s.entries().count() == s.search("anything").count() == s.topics().count() == s.timeline("x").count() == 0
    assert s.prefetch("anything at all") == "" and s.backfill() == 0
    assert s.dedup().count() == 0
    with pytest.raises(ValueError):
        MemoryStore(spark, str(tmp_path), "")


def test_prefetch_gate(spark, store):
    skip = spark.createDataFrame([("gateway",)], "pattern string")
    assert "[1] The gateway" in store.prefetch("gateway")
    assert store.prefetch("Gateway ", skip) == store.prefetch("g") == store.prefetch("gateway", locked=True) == ""


def test_feedback_and_correction(spark, store):
    key = store.search("gateway").first().key
    store.feedback(key, True)
    assert store.entries().where(F.col("key") == key).first().feedback_score == 1
    store.correct([key])
    assert store.search("gateway").count() == 0


def test_versions_and_topics(spark, store):
    store.store(rows(spark, "The parser reads the quarterly report", at="2026-02-04 13:00:00"))
    both = store.entries().where("content like 'The parser%'").orderBy("created").collect()
    assert len(both) == 2 and both[0].valid_until is not None and both[1].valid_until is None and ":" in both[1].key[12:]
    assert store.search("parser").count() == 1
    assert store.is_hot("parser") and not store.is_hot("zzz")
    assert store.topics("daily", 99).count() > 3 and store.attention().count() > 3
    assert store.timeline("btc").count() == 1


def test_agents(spark, store):
    store.store(rows(spark, "private gateway note", tags=()))
    other = MemoryStore(spark, store.folder, "other", params=P)
    assert store.search("private note").count() == 1 and other.search("private note").count() == 0
    assert MemoryStore(spark, store.folder, "boss", primary=True, params=P).search("private note").count() == 1


def test_hybrid(spark, store):
    register_embedder("letters", Letters)
    schema.DIMENSIONS["letters"] = 26
    s = MemoryStore(spark, store.folder, "main", embed=embedder("letters"), params=P)
    assert s.backfill() == 3 and s.backfill() == 0
    got = s.search("gateway exchange").orderBy("place").collect()
    assert got[0].content.startswith("The gateway") and len(got) == 3
    assert schema.wrong_dimension(s.table("vectors"), "letters").count() == 0


def test_jobs(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path), "main", params=P)
    text = "deployment pipeline rotates staging certificates"
    s.store(rows(spark, text + " early", text + " late", text + " again", "unrelated words about gardens", at="2025-01-01 00:00:00"))
    merged = s.consolidate().collect()
    assert len(merged) == 1 and len(merged[0].sources) == 3
    assert s.entries().where("fragment_type = 'consumed'").count() == 3
    assert s.search("certificates").first().fragment_type == "consolidated"
    assert s.forget().where("decision = 'forget'").count() >= 1
    assert s.entries().where("invalid_at is not null").count() == 0
    s.forget(dry_run=False)
    assert s.entries().where("invalid_at is not null").count() >= 1
    s.dedup()
    assert s.table("checked").count() > 0
    s.discover_synonyms()
    s.dictionary(str(tmp_path / "dict"))
    assert spark.read.text(str(tmp_path / "dict")).count() >= 0


def test_distill(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path), "main", params=P)
    messages = spark.createDataFrame([(1, "user", "we decided to keep the nightly backup"), (2, "tool", "ignored but long enough to count"), (3, "assistant", "ok")], "id bigint, role string, content string")
    s.distill(messages, lambda texts: ['[{"content": "' + t.split("] ")[1] + '", "category": "project", "tags": "a,b"}]' for t in texts])
    e = s.entries().first()
    assert e.content == "we decided to keep the nightly backup" and set(e.tags) >= {"auto-distill", "project", "a", "b", "agent:main"}


def test_config(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"final_limit": 7, "half_life_days": 10, "unknown": 1}))
    p = config.params(str(f), {"ENGRAM_FINAL_LIMIT": "8", "ENGRAM_RRF_K": "30"}, rrf_k=20)
    assert (p.final_limit, p.half_life_days, p.rrf_k, p.knn_limit) == (8, 10.0, 20, 10)
    assert config.merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
    assert config.strict_bool("false") is False and config.strict_bool("Yes") is True
    with pytest.raises(ValueError):
        config.strict_bool("maybe")
    g = tmp_path / "skip.txt"
    g.write_text("# comment\n好\n OK \n\nok\n", encoding="utf-8")
    patterns = config.skip_patterns(spark, str(g))
    assert {r.pattern for r in patterns.collect()} == {"好", "ok"}
    asked = spark.createDataFrame([("好",), ("可以看看",), ("OK",), ("x",), ("分析BTC",)], "query string")
    assert {r.query for r in config.gated(asked, patterns).collect()} == {"可以看看", "分析BTC"}


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>").select(schema.packed(F.col("v")).alias("b"))
    assert [r.v for r in df.select(schema.unpacked(F.col("b")).alias("v")).collect()] == [[1.0, -2.5], None]
    assert schema.dimension("mini-embed-64") == 64 and schema.dimension("unheard of") == 1536


def test_merged_texts_stay_whole(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path), "main", params=P)
    text = "deployment pipeline rotates staging certificates " * 8
    s.store(rows(spark, text + "zebrafish", text + "marmalade", at="2025-01-01 00:00:00"))
    assert len(s.consolidate().collect()) == 1
    assert s.search("zebrafish").count() == s.search("marmalade").count() == 1


def test_consolidate_asks_a_model_once(spark, tmp_path):
    import uuid

    s = MemoryStore(spark, str(tmp_path), "main", params=P)
    text = "deployment pipeline rotates staging certificates"
    s.store(rows(spark, text + " early", text + " late", at="2025-01-01 00:00:00"))
    key = s.consolidate(lambda texts: f"merged {uuid.uuid4()}").first().key
    assert {r.consumed_by for r in s.entries().where("fragment_type = 'consumed'").collect()} == {key}
    assert s.table("entries").where("fragment_type = 'consolidated'").first().key == key


def test_each_write_counts(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path), "main", params=P)
    s.store(rows(spark, "gateway alpha", "gateway beta"))
    assert s.topics("all", 30).where("topic = 'gateway'").first().score == 2.0
    key = s.table("entries").first().key
    s.feedback(key, True)
    s.feedback(key, True)
    s.append("feedback", s.table("feedback").limit(1))  # delivered again
    assert s.entries().where(F.col("key") == key).first().feedback_score == 2


def test_dedup_finds_a_duplicate_of_a_later_run(spark, tmp_path):
    s = MemoryStore(spark, str(tmp_path), "main", params=P)
    text = "太棒了!! really GREAT deployment pipeline rotates staging certificates"
    s.store(rows(spark, text, *[f"other{i} words{i} entirely{i}" for i in range(30)], at="2026-01-01 00:00:00"))
    assert s.dedup().count() == 0
    s.store(rows(spark, text + ".", at="2026-02-01 00:00:00"))
    first, second = (s.entries().where(F.col("content") == t).first().key for t in (text, text + "."))
    assert [(r.key, r.kept) for r in s.dedup().collect()] == [(first, second)]
    assert s.dedup().count() == 0
