import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.llm import leaks, packing


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(0, 40)))
def test_plan_is_a_packing(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    runs, bins = packing.plan(counts, capacity)
    load, seen = np.zeros(bins, int), {}
    for s, first, many, at in runs:
        load[at : at + many] += s
        seen.setdefault(s, []).extend(range(first, first + many))
    assert (load <= capacity).all() and (load > 0).all()
    assert {s: sorted(v) for s, v in seen.items()} == {s: list(range(n)) for s, n in counts.items() if n}
    # best fit and pairs leave at most one container half empty, whatever the sizes
    assert (load * 2 <= capacity).sum() <= 1


def test_lanes_follow_the_rows():
    assert [packing.lanes_for(n) for n in (0, 10**6, 10**9, 10**12)] == [64, 64, 1000, 1024]


def test_large_sizes_pair():
    runs, bins = packing.plan({60: 3, 40: 3, 35: 2}, 100)
    assert bins == 4


def test_pack(spark):
    sized = spark.createDataFrame([("a", 25), ("a", 25), ("b", 0), ("c", 10), ("d", 4), (None, 6), ("e", 1), ("f", 0)], "id string, tokens long")
    rows = packing.pack(sized, 10).collect()
    load = {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.tokens
    assert max(load.values()) <= 10 and len(load) == 8
    assert sorted((r.piece, r.tokens) for r in rows if r.id == "a") == [(0, 10), (0, 10), (1, 10), (1, 10), (2, 5), (2, 5)]
    assert sum(r.id in ("b", "f") for r in rows) == 2
    assert packing.pack(sized.where("false"), 10).count() == 0
    assert {r.container for r in packing.pack(sized.where("tokens = 0"), 10).collect()} == {0}


def test_pack_is_repeatable_and_tight(spark):
    sized = spark.range(3000).selectExpr("cast(id as string) as id", "1 + pmod(hash(id), 300) as tokens").selectExpr("id", "cast(tokens as long) as tokens")
    a, b = ({(r.id, r.container) for r in packing.pack(sized.repartition(n), 512).collect()} for n in (3, 7))
    assert a == b
    total = sized.groupBy().sum("tokens").first()[0]
    assert total / (512 * len({c for _, c in a})) > 0.99


def test_texts(spark):
    long = "word and 数据 " * 20000
    df = spark.createDataFrame([(1, "hello world", "clash"), (2, None, "x"), (3, "", "x"), (4, long, "x")], "doc_id long, text string, tokens string")
    own = packing.encoding(packing.vocabulary(packing.TOKENIZER))
    assert {r.id: r.tokens for r in packing.token_counts(df, "doc_id", "text").collect()} == {"1": len(own.encode_ordinary("hello world")), "2": 0, "3": 0, "4": len(own.encode_ordinary(long))}
    rows = packing.pack_texts(df, "doc_id", "text", 512).collect()
    assert sum(r.tokens for r in rows if r.id == "4") == len(own.encode_ordinary(long))


def text_of(rng, n):
    t = np.concatenate([[0], rng.integers(0, 4, n), [0]])
    return np.concatenate([[0], np.tile(np.r_[rng.integers(1, 3, 20), 0], 10)]) if n % 3 == 0 else t


@pytest.mark.parametrize("seed", range(12))
def test_index_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    t = text_of(rng, int(rng.integers(3, 400)))
    seps = np.cumsum(t == 0)
    suffix = [tuple((0, seps[j]) if t[j] == 0 else (1, t[j]) for j in range(i, len(t))) for i in range(len(t))]
    assert list(leaks.suffix_array(t)) == sorted(range(len(t)), key=lambda i: suffix[i])
    index = leaks.FMIndex(t)
    phrases = rng.integers(1, 6, (40, 3))
    found, lo, hi = index.search(phrases)
    for q in range(len(phrases)):
        want = [i for i in range(len(t) - 2) if (t[i : i + 3] == phrases[q]).all()]
        k = np.nonzero(found == q)[0]
        assert (sorted(index.locate(np.arange(lo[k[0]], hi[k[0]]))) if len(k) else []) == want


def test_wavelet_matrix():
    v = np.random.default_rng(0).integers(0, 37, 500)
    w = leaks.WaveletMatrix(v)
    at, c = np.random.default_rng(1).integers(0, 501, 200), np.random.default_rng(2).integers(0, 37, 200)
    assert list(w.rank(c, at)) == [int((v[:a] == x).sum()) for a, x in zip(at, c)]
    symbols, ranks = w.access(np.arange(500))
    assert (symbols == v).all() and list(ranks) == [int((v[:i] == v[i]).sum()) for i in range(500)]


def test_units():
    assert leaks.units("Ａb-1 数据x­​y ① é") == ["ab", "1", "数", "据", "xy", "1", "é"]


def brute(docs, items, window):
    split = lambda s: leaks._UNIT.findall("".join(c for c in unicodedata.normalize("NFKC", s).lower() if unicodedata.category(c) != "Cf"))
    out = set()
    for d, t in docs:
        u = split(t or "")
        for i, s in items:
            v = split(s or "")
            mine = {tuple(v[k : k + window]) for k in range(len(v) - window + 1)}
            if any(tuple(u[k : k + window]) in mine for k in range(len(u) - window + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)] + list("数据流水线索引")
    make = lambda n: " ".join(rng.choice(words, n))
    items = [(i, make(int(rng.integers(3, 40)))) for i in range(20)] + [(98, None), (99, ""), (97, "too short")]
    docs = []
    for d in range(60):
        t = make(int(rng.integers(0, 80)))
        if d % 3 == 0:
            s = items[int(rng.integers(20))][1].split(" ")
            k = int(rng.integers(0, len(s)))
            t += " " + " ,".join(s[k : k + int(rng.integers(4, 30))]).upper().replace("W", "W​") + " " + make(3)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, make(3) + " " + (items[0][1] + " ") * 3000), (103, docs[0][1]), (None, items[1][1] if len(items[1][1].split()) > 9 else items[2][1])]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, item_id string, start int")
    it = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items, 5)
    assert len(want) > 10
    for options in ({}, {"shard_units": 50}, {"block_units": 300}, {"block_units": 300, "blocks_a_pass": 1}):
        rows = leaks.leaks(df, it, window=5, **options).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert leaks.leaks(df.where("false"), it).count() == leaks.leaks(df, it.where("false")).count() == 0


def test_short_runs_are_separators():
    t = np.array([1, 2, 0, 0, 3, 4, 5, 0, 6, 7, 8, 9])
    assert list(leaks.long_runs(t, 3)) == [0, 0, 0, 0, 3, 4, 5, 0, 6, 7, 8, 9] and list(leaks.long_runs(t, 4)) == [0] * 8 + [6, 7, 8, 9]
    assert list(leaks.long_runs(np.zeros(0, int), 3)) == [] and list(leaks.long_runs(np.ones(2, int), 2)) == [1, 1]


def test_spans_merge(spark):
    df = spark.createDataFrame([(1, "x a b c d e f y a b c")], "doc_id long, text string")
    it = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d")], "item_id long, text string")
    got = sorted((r.item_id, r.start, r.end) for r in leaks.leaked_spans(df, it, window=3).collect())
    assert got == [(1, 1, 7), (1, 8, 11), (2, 2, 5)]
