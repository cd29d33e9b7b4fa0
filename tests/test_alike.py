import math

import numpy as np
from pyspark.sql import functions as F

from engram.operators import maintain as M
from engram.operators import ranked


def made(n=240):
    """Entries of few words, some with entities, some strongly felt; of every third there is a copy, whole or changed a little."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        words = [f"w{'abcdefghijklmnopqrstuvwxyz'[x]}{'xyz'[x % 3]}q" for x in rng.integers(0, 26, rng.integers(3, 12))]
        row = (" ".join(words), [f"E{x}" for x in rng.integers(0, 9, rng.integers(0, 4))], float(rng.choice([0.0, 0.1, 0.5, 0.9])))
        rows.append(row)
        if i % 3 == 0:
            rows.append(row if i % 2 else (row[0] + " more", row[1][:1], row[2] + 0.1))
    return [(f"k{i:04d}", *r) for i, r in enumerate(rows)]


def scored(rows, limit):
    """All pairs by the formula alone."""
    terms = [set(t for t in r[1].split() if t != "more") | ({"more"} if "more" in r[1] else set()) for r in rows]
    df = {}
    for t in terms:
        for w in t:
            df[w] = df.get(w, 0) + 1
    n = len(rows)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items() if d > 1}
    asked = [sorted((w for w in t if df[w] > 1), key=lambda w: (df[w], w))[:8] for t in terms]
    grams = [{r[1][i : i + 2] for i in range(len(r[1]) - 1)} for r in rows]
    named = [{e.lower() for e in r[2]} for r in rows]
    j = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    out = {}
    for a in range(n):
        for b in range(a + 1, n):
            t = min(round(max(sum(idf[w] for w in asked[x] if w in terms[y]) for x, y in ((a, b), (b, a))), 6) / 20, 1.0)
            jw, je, jg, gap = j(terms[a], terms[b]), j(named[a], named[b]), j(grams[a], grams[b]), abs(rows[a][3] - rows[b][3])
            felt = rows[a][3] > 0.3 or rows[b][3] > 0.3
            f = (0.0 if gap > 0.8 else 0.4 * jw + 0.3 * (1 - gap) + 0.2 * t + 0.1 * jg) if felt else 0.4 * je + 0.3 * t + 0.2 * jw + 0.1 * jg
            f = f / 2 if named[a] and named[b] and not je else f
            if round(f, 6) >= limit:
                out[rows[a][0], rows[b][0]] = round(f, 6)
    return out


def test_pairs_are_all_that_reach_the_limit(spark, monkeypatch):
    monkeypatch.setattr(ranked, "CLASSES", 100)  # several shards
    table = made()
    want = scored(table, M.DEFAULT.dedup_threshold)
    rows = spark.createDataFrame([(*r, None) for r in table], "key string, content string, entities array<string>, intensity double, created timestamp")
    members = M.dedup_members(rows).cache()
    pairs = M.dedup_pairs(members.where("first"))
    one, two = members.select("id", "key"), members.select(F.col("id").alias("o"), F.col("key").alias("other"))
    got = {}
    for r in pairs.join(one, "id").join(two, "o").collect():
        if r.key != r.other:
            got.setdefault(tuple(sorted((r.key, r.other))), []).append(r.score)
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(v - want[k]) < 2e-6 for k, x in got.items() for v in x)


def test_rarest_by_join_is_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [f"w{(i * k) % 17}" for k in range(1, 12)]) for i in range(60)], "id long, words array<string>").select("id", F.array_distinct("words").alias("words"))
    lists = rows.select("id", F.transform("words", lambda x: F.xxhash64(x)).alias("w"))
    df = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    took = lambda: {r.id: (list(r.rare), [round(x, 9) for x in r.idf]) for r in ranked.rarest(lists, df, 60, 8).collect()}
    want = took()
    monkeypatch.setattr(ranked, "VOCABULARY", 3)
    assert took() == want and len(want) == 60


def test_matched_counts_what_scores_reach(spark):
    rows = spark.createDataFrame([(*r, None) for r in made(120)], "key string, content string, entities array<string>, intensity double, created timestamp")
    scores = [r.score for r in M.dedup_scores(rows).collect()]
    (got,) = M.dedup_matched(rows).collect()
    assert (got.compared, got.matched) == (len(scores), sum(x >= M.DEFAULT.dedup_threshold for x in scores)) and 0 < got.matched < got.compared
    assert tuple(M.dedup_matched(rows.where(F.lit(False))).first()) == (0, 0)


def test_pairs_without_a_chance_are_left_out_where_they_are_found(spark, monkeypatch):
    rows = spark.createDataFrame([(*r, None) for r in made(120)], "key string, content string, entities array<string>, intensity double, created timestamp")
    sides = M.dedup_sides(rows)
    every = {(r.key, r.other): r for r in M.dedup_ranked(sides).collect()}
    assert {k: round(r.raw, 6) for k, r in every.items()} == {(r.key, r.other): round(r.raw, 6) for r in M.dedup_candidates(rows).collect()}
    some = M.dedup_ranked(sides, keep=M.may_match(M.DEFAULT)).collect()
    left = {(r.key, r.other): r for r in some if r.key is not None}
    chance = {k for k, r in every.items() if M.may_match(M.DEFAULT)(*(np.array([x]) for x in (r.jw, r.je, min(r.raw / 20, 1.0), r.s, r.s2, r.both)))[0]}
    assert left.keys() == chance and 0 < len(left) < len(every) and all(r == every[k] for k, r in left.items())
    assert sum(r.raw for r in some if r.key is None) == len(every)
    want = tuple(M.dedup_matched(rows).first())
    for m in (ranked, M):
        monkeypatch.setattr(m, "SHARD", 50)
    assert tuple(M.dedup_matched(rows).first()) == want
