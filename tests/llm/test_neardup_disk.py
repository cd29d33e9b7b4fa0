import time
from glob import glob

from pyspark.sql import functions as F

from engram.llm import neardup
from engram.session import cut_and_clear


def test_shuffle_files_go_at_once(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    count = lambda: {f for d in folders for f in glob(f"{d}/*/shuffle_*.data")}
    before = count()
    assert len(cut_and_clear(spark.range(1000).groupBy(F.col("id") % 7).count()).collect()) == 7
    for _ in range(50):
        if count() - before:
            time.sleep(0.2)
    assert not count() - before


def test_entities_decide_before_pairs_are_written(spark):
    text = "the very same long template about staging, certificates and a nightly backup of server "
    rows = [(f"k{i:03d}", text + str(i), [f"a{i}", f"b{i}", f"c{i}"]) for i in range(60)] + [("x", text + "x", ["u", "v"]), ("y", text + "y", ["u", "v"])]
    df = spark.createDataFrame(rows, "key string, text string, entities array<string>")
    signed = neardup.signed(df, "key", "text", "entities", 60, neardup.MinMax())
    columns = [c for c in signed.columns if c not in ("cls", "bands", "entities", "folded")]
    found = {(r.a, r.b) for r in neardup.candidate_pairs(signed.select(*columns, F.explode("bands").alias("band")), 0.6, 0.5).collect()}
    assert ("x", "y") in found and len(found) < 200
    assert [(r.id_a, r.id_b) for r in neardup.near_pairs(df, "key", "text", "entities").collect()] == [("x", "y")]


def test_small_chunks_and_passes_find_the_same(spark, monkeypatch):
    text = "every one of these texts begins with the very same long introduction that a template wrote number "
    df = spark.createDataFrame([(f"k{i:02d}", text + str(i), ["e"]) for i in range(40)], "key string, text string, entities array<string>")
    want = {tuple(r) for r in neardup.near_pairs(df, "key", "text", "entities").collect()}
    monkeypatch.setattr(neardup, "PASS_ROWS", 40 * 20)
    assert want == {tuple(r) for r in neardup.near_pairs(df, "key", "text", "entities", cap=7).collect()} and len(want) == 780
