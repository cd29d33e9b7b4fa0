import numpy as np

from engram.operators import ranked


def test_search_is_exact():
    rng = np.random.default_rng(1)
    n, words = 3000, 40
    has = rng.random((n, words)) < np.linspace(0.02, 0.6, words)
    starts, docs = np.r_[0, np.cumsum(has.sum(0))], np.concatenate([np.flatnonzero(has[:, w]) for w in range(words)])
    idf = np.log(1 + (n - has.sum(0) + 0.5) / (has.sum(0) + 0.5))
    asking = [(i, w := np.flatnonzero(has[i])[:8], idf[w]) for i in range(0, n, 7)]
    for own, c, sums in ranked.search(np.arange(words), starts, docs, n, asking, 20):
        w = np.flatnonzero(has[own])[:8]
        want = np.round((has[:, w] * idf[w]).sum(1), 6)
        want[own] = 0
        best = np.lexsort((np.arange(n), -want))[:20]
        best = best[want[best] > 0]
        assert list(c) == list(best) and np.allclose(sums, want[best])


def test_lists_over_shards_and_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from engram.operators import maintain as M

    rows = spark.createDataFrame([(f"k{i:03d}", f"common words stand here alpha{i % 7} beta{i % 11} gamma{i % 13} delta{i % 3}") for i in range(150)], "key string, content string")
    want = {tuple(r) for r in M.dedup_candidates(rows).collect()}
    for m in (ranked, M):
        monkeypatch.setattr(m, "SHARD", 40)
    monkeypatch.setattr(ranked, "BLOCK", 60)
    assert {tuple(r) for r in M.dedup_candidates(rows).collect()} == want and len(want) == 150 * 20
    assert M.dedup_candidates(rows.where(F.lit(False))).count() == 0


def test_jaccards():
    rng = np.random.default_rng(2)
    sets = [np.flatnonzero(rng.random(50) < 0.3) for _ in range(30)] + [np.zeros(0, np.int64)]
    a, b = np.repeat(np.arange(31), 31), np.tile(np.arange(31), 31)
    want = [len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) and len(y) else 0.0 for x in sets for y in sets]
    assert np.allclose(ranked.jaccards(list(sets), a, b), want)


def test_scores_over_several_cells_count_the_same(spark, monkeypatch):
    from engram.operators import maintain as M

    rows = spark.createDataFrame([(f"k{i:02d}", f"common words stand here alpha{i % 7} beta{i % 11}", [f"e{i % 4}"], 0.1 * (i % 6)) for i in range(60)], "key string, content string, entities array<string>, intensity double")
    want = {tuple(r) for r in M.dedup_scores(rows).collect()}
    monkeypatch.setattr(ranked, "BLOCK", 10)
    assert {tuple(r) for r in M.dedup_scores(rows).collect()} == want and len(want) == 60 * 20


def test_search_counts_frequent_words_by_bitmaps(monkeypatch):
    """Words that many entries have aren't walked through: their lists may be empty."""
    rng = np.random.default_rng(3)
    n, words = 5000, 60
    has = rng.random((n, words)) < np.r_[np.linspace(0.001, 0.01, 15), np.linspace(0.02, 0.5, 45)]
    idf = np.log(1 + (n - has.sum(0) + 0.5) / (has.sum(0) + 0.5))
    many = has.sum(1)
    w = np.concatenate([np.flatnonzero(has[i]) for i in range(n)]).astype(np.uint16)
    monkeypatch.setattr(ranked, "DENSE", 64)
    for size in (40 * 8 * 79, 20 * 8 * 79):  # all of the frequent words, and half of them
        monkeypatch.setattr(ranked, "BITMAPS", size)
        index = ranked.inverted(w, np.cumsum(many) - many, many, np.arange(words))
        assert (index[3][1] >= 0).sum() == size // (8 * 79) and len(index[2]) == has[:, index[3][1] < 0].sum()
        asking = [(i, a := np.flatnonzero(has[i])[k % 3 :][: 8 - k % 5], idf[a]) for k, i in enumerate(range(0, n, 9))]
        for own, c, sums in ranked.search(*index[:3], n, asking, 20, index[3]):
            want = np.round((has[:, a := dict((x, y) for x, y, _ in asking)[own]] * idf[a]).sum(1), 6)
            want[own] = 0
            best = np.lexsort((np.arange(n), -want))[:20]
            best = best[want[best] > 0]
            assert list(c) == list(best) and np.allclose(sums, want[best])


def test_ranked_words_by_join_are_the_same(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, [f"w{(i * k) % 17}" for k in range(1, 12)]) for i in range(60)], "key long, words array<string>").select("key", F.array_distinct("words").alias("words"))
    lists = rows.select("key", F.transform("words", lambda x: F.xxhash64(x)).alias("w"))
    df = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    took = lambda: {r.key: (list(r.w), [round(x, 9) for x in r.idf]) for r in ranked.ranked_words(lists, df, 60, 8).collect()}
    want = took()
    monkeypatch.setattr(ranked, "VOCABULARY", 3)
    assert took() == want and len(want) == 60


def test_bigrams_of_pairs_over_groups_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = {f"k{i:02d}": "".join(rng.choice(list("abcde 中文字"), rng.integers(1, 40))) for i in range(50)}
    pairs = [(f"k{a:02d}", f"k{b:02d}", float(a)) for a in range(50) for b in rng.choice(50, 6, replace=False)]
    sets = {k: {t[i : i + 2] for i in range(len(t) - 1)} for k, t in texts.items()}
    want = {(a, b, raw, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0.0, 9)) for a, b, raw in pairs}
    monkeypatch.setattr(ranked, "BLOCK", 3)
    asked = spark.createDataFrame(pairs, "key string, other string, raw double")
    got = ranked.shared_grams(asked, spark.createDataFrame(list(texts.items()), "key string, low string"), 50)
    assert {(r.key, r.other, r.raw, round(r.jg, 9)) for r in got.collect()} == want and len(want) == 300
