import random

import numpy as np

from engram.llm import neardup, similar

VECTORS = "key string, embedding array<float>, cls string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], "clash", "clash") for k, v in rows], VECTORS)


def brute(rows, dim, k, least):
    ok = {}
    for key, v in rows:
        if key is not None and v is not None and len(v) == dim and np.isfinite(v).all() and np.any(v):
            ok[key] = np.asarray(np.float32(v), np.float64)
    keys = sorted(ok)
    if not keys:
        return set()
    x = np.array([ok[k] / np.linalg.norm(ok[k]) for k in keys])
    c = np.round(x @ x.T, 12)
    np.fill_diagonal(c, -9)
    return {(keys[i], keys[j]) for i in range(len(keys)) for j in np.argsort(-c[i], kind="stable")[:k] if c[i, j] >= least and i != j}


def test_exact_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8))
    rows = [(f"k{i:04d}", v) for i, v in enumerate(np.concatenate([base, base[:40] + rng.normal(0, 0.1, (40, 8)), base[:20] * 3]))]
    rows += [("bad1", None), ("bad2", []), ("bad3", [1.0] * 7), ("bad4", [0.0] * 8), ("bad5", [float("nan")] * 8), ("bad6", [float("inf")] + [1.0] * 7), (None, [1.0] * 8), rows[0]]
    for options in ({}, {"shard_rows": 40, "block_rows": 64, "sample_most": 100}):
        for k, least in ((5, -1.0), (5, 0.9), (1, 0.5)):
            got = {(r.key, r.neighbour) for r in similar.most_similar(vectors(spark, rows), "key", "embedding", 8, k, least, **options).collect()}
            assert got == brute(rows, 8, k, least)


def test_copies_take_the_smallest_keys(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0, 0.0]) for i in range(60)] + [("z", [1.0, 2.0, 0.1]), ("y", [-1.0, 0.0, 0.0])]
    got = {}
    for r in similar.most_similar(vectors(spark, rows), "key", "embedding", 3, 5, 0.9).collect():
        got.setdefault(r.key, set()).add(r.neighbour)
    five = {f"c{i:03d}" for i in range(5)}
    assert got["c050"] == five and got["c000"] == {f"c{i:03d}" for i in range(1, 6)} and got["z"] == five and "y" not in got
    pairs = similar.similar_pairs(vectors(spark, rows), "key", "embedding", 3, 5, 0.9).collect()
    assert len(pairs) == len(set(pairs)) and all(p.key_a < p.key_b for p in pairs)


def test_multiples_of_one_direction(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=8)
    rows = [(f"k{i:03d}", v * s) for i, s in enumerate(rng.uniform(0.1, 9, 700))] + [(f"m{i:03d}", v * 2.0**i) for i in range(30)] + [("z", v + 0.05)] + [(f"r{i}", rng.normal(size=8)) for i in range(40)]
    order = rng.permutation(len(rows))
    for factor in (1.0, 4.0):
        got = {}
        for r in similar.most_similar(vectors(spark, [rows[i] for i in order]), "key", "embedding", 8, 5, 0.9, factor).collect():
            got.setdefault(r.key, set()).add(r.neighbour)
        first = [f"k{i:03d}" for i in range(6)]
        assert all(got[k] == set([x for x in first if x != k][:5]) for k, _ in rows if k[0] in "km")
    want = brute(rows, 8, 5, 0.9)
    assert {("z", n) for n in got["z"]} == {p for p in want if p[0] == "z"}


def test_ties_at_the_last_place_go_to_the_smallest_numbers():
    x = np.repeat(np.eye(4), 100, 0)
    ids, cos = similar.VantageTree(x, leaf=16).search(np.eye(4) * 0.6 + 0.4 / np.sqrt(2) * np.roll(np.eye(4), 1, 1), 7, -1.0, 1.0)
    assert (ids == np.arange(4)[:, None] * 100 + np.arange(7)).all()
    ids, _ = similar.VantageTree(x, leaf=16).search(x, 3, 0.5, 1.0)
    assert (ids == np.repeat(np.arange(4) * 100, 100)[:, None] + np.arange(3)).all()


def test_no_vectors(spark):
    assert similar.most_similar(vectors(spark, []), "key", "embedding", 8).count() == 0
    assert similar.most_similar(vectors(spark, [("a", [1.0] * 8)]), "key", "embedding", 8).count() == 0


def test_relaxed_search_compares_less_and_finds_most():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(100, 4)) @ rng.normal(size=(4, 32))
    x = np.repeat(centres, 20, 0) + rng.normal(0, 0.1, (2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = {(i, j) for i, row in enumerate(np.argsort(-(x @ x.T), axis=1)[:, :6]) for j in row}
    found, work = [], []
    for factor in (1.0, 3.0):
        tree = similar.VantageTree(x, 64)
        ids, _ = tree.search(x, 6, -1.0, factor)
        found.append(len(true & {(i, int(j)) for i, row in enumerate(ids) for j in row}) / len(true))
        work.append(tree.compared)
    assert found[0] > 0.9999 and found[1] >= 0.9 and work[1] < work[0] < len(x) ** 2


MEMORY = "content_hash string, content string, entities array<string>, id string, band bigint, text string"


def memory(spark, rows):
    return spark.createDataFrame([(h, t, e, "clash", 1, "clash") for h, t, e in rows], MEMORY)


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)] + ["数据", "流水线", "Größe"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rows[rng.randrange(len(rows))][1].split(" ")
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(8, 40))]
        rows.append((f"h{i:04d}", " ".join(w), rng.choice([None, [], ["a"], ["A ", "b"], ["c"], ["a", "b", None]])))
    return rows


def brute_pairs(rows, least=0.6, entities=0.5, short=60):
    kept = {}
    for h, t, e in rows:
        if h is not None and t is not None and len(neardup.fold(t)) >= short:
            f = neardup.fold(t)
            kept[h] = ({f[i : i + 5] for i in range(len(f) - 4)}, {x.strip().lower() for x in e or [] if x and x.strip()})
    out = set()
    for a in kept:
        for b in kept:
            if a < b:
                (x, p), (y, q) = kept[a], kept[b]
                if len(x & y) / len(x | y) >= least and (not p | q or len(p & q) / len(p | q) >= entities):
                    out.add((a, b))
    return out


def test_pairs_against_brute_force(spark):
    rows = texts()
    rows += [("n1", None, ["a"]), (None, rows[0][1], None), ("e1", "", None), ("s1", "too short", None), rows[5], ("copy", rows[3][1].upper() + " !!", rows[3][2]), ("long", rows[0][1] * 500, ["a"]), ("long2", rows[0][1] * 500 + " x", ["a"])]
    want = brute_pairs(rows)
    assert len(want) > 30
    for cap in (256, 3):
        got = [(r.id_a, r.id_b) for r in neardup.near_pairs(memory(spark, rows), "content_hash", "content", "entities", cap=cap).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want)
    assert ("long", "long2") in got


def test_groups(spark):
    rows = texts(60)
    rows += [(f"copy{i}", rows[7][1].upper() + " " * i, rows[7][2]) for i in range(9)] + [(f"again{i}", rows[11][1], rows[11][2]) for i in range(4)]
    pairs = {(r.id_a, r.id_b) for r in neardup.near_pairs(memory(spark, rows), "content_hash", "content", "entities").collect()}
    group = {h: h for h, _, _ in rows}
    for _ in range(60):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    got = {r.id: (r.group_id, r.links) for r in neardup.near_groups(memory(spark, rows), "content_hash", "content", "entities").collect()}
    assert got == {h: (g, sum(h in p for p in pairs)) for h, g in group.items()}


def test_copies_of_one_text_stay_one_class(spark):
    text = "the same long text about staging, certificates and a nightly backup, again and again"
    rows = [(f"c{i:05d}", text + "!" * (i % 7), None) for i in range(20000)] + [(f"x{i}", text.replace("nightly", f"weekly{i}"), None) for i in range(3)] + [("o", "an entirely different text that is also long enough to be compared with others", None)]
    got = {r.id: (r.group_id, r.links) for r in neardup.near_groups(memory(spark, rows), "content_hash", "content", "entities").collect()}
    assert len(got) == len(rows) and got["o"] == ("o", 0)
    assert all(v == ("c00000", 20002) for k, v in got.items() if k != "o")


def test_hot_bands_lose_no_pair(spark):
    head = "every one of these texts begins with the very same long introduction that a template wrote "
    rows = [(f"t{i:03d}", head + f"number {i} {chr(97 + i % 26) * 12}", None) for i in range(90)]
    want = brute_pairs(rows)
    assert len(want) > 2000
    for most in (100_000, 0):
        bands = neardup.signed(memory(spark, rows), "content_hash", "content", "entities", 60, neardup.MinMax())
        from pyspark.sql import functions as F

        found = neardup.candidate_pairs(bands.select("id", "n", "e", "s1", "s2", F.explode("bands").alias("band")), 0.6, 0.5, cap=8, broadcast_most=most)
        assert want <= {(r.a, r.b) for r in found.collect()}


def test_no_texts(spark):
    assert neardup.near_pairs(memory(spark, []), "content_hash", "content", "entities").count() == 0
    assert neardup.near_groups(memory(spark, [("a", None, None)]), "content_hash", "content", "entities").count() == 0


def test_min_max_is_unbiased():
    a, b = "".join(random.Random(1).choice("abcd") for _ in range(400)), "".join(random.Random(1).choice("abcd") for _ in range(400))[:300] + "x" * 3 + "".join(random.Random(2).choice("abcd") for _ in range(90))
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    s, n = neardup.MinMax(2000).signatures([a, b])
    assert list(n) == [len(x), len(y)]
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.03
