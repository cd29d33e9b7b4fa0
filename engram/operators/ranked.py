"""Exact ranked lists of entries that share rare words: postings packed by shard of entries, searched for blocks of entries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.session import cut

#: Entries of one shard of the postings; entries that ask in one task, at least and at most.
SHARD, BLOCK, ASKED = 1_500_000, 25_000, 500_000
#: A word is a bitmap if one entry of so many has it, as far as so many bytes hold them.
DENSE, BITMAPS = 256, 256_000_000


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``id``, a monotonic number fixed before, made dense in the same order; the driver sees a count a partition."""
    part = F.shiftright("id", 33)
    before, first = 0, {}
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):
        first[r["part"]], before = before, before + r["count"]
    if not first:
        return rows
    base = F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(max(first) + 1)])
    return rows.withColumn("id", F.element_at(base, part.cast("int") + 1) + F.col("id").bitwiseAND((1 << 33) - 1))


def _ones(maps: list[np.ndarray], spare: np.ndarray) -> list[np.ndarray]:
    """Bit planes, lowest first, of how many of the bitmaps hold each place. Adders take three of a weight to one, and two of a weight to one; results lie in rows of ``spare``."""
    free, temp, planes = list(range(2, len(spare))), spare[0], []
    level = [(m, -1) for m in maps]
    while level:
        above = []
        while len(level) > 1:
            (a, x), (b, y) = level.pop(), level.pop()
            i, j = free.pop(), free.pop()
            np.bitwise_and(a, b, out=spare[j])
            np.bitwise_xor(a, b, out=spare[i])
            if level:
                c, z = level.pop()
                np.bitwise_and(spare[i], c, out=temp)
                np.bitwise_or(spare[j], temp, out=spare[j])
                np.bitwise_xor(spare[i], c, out=spare[i])
                free.extend([z] if z >= 0 else [])
            free.extend(k for k in (x, y) if k >= 0)
            level.insert(0, (spare[i], i))
            above.append((spare[j], j))
        planes.append(level[0][0])
        level = above
    return planes


def _least(planes: list[np.ndarray], k: int, out: np.ndarray) -> np.ndarray:
    """Bitmap of the places whose count, given by bit planes, is at least k, which is 1 or more."""
    begun = False
    for j, b in enumerate(planes):
        if k - 1 >> j & 1:
            if begun:
                np.bitwise_and(b, out, out=out)
        elif begun:
            np.bitwise_or(b, out, out=out)
        else:
            np.copyto(out, b)
            begun = True
    if not begun:
        out[:] = 0
    return out


def _places(bitmap: np.ndarray) -> np.ndarray:
    """Places of the bits that are set."""
    some = np.flatnonzero(bitmap != 0)
    at, bit = np.nonzero(np.unpackbits(bitmap[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return some[at] * 64 + bit


def bitmaps(words: np.ndarray, starts: np.ndarray, docs: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of ``cells`` words of 64 bits for words of many entries, as far as memory allows, and for each word its row or -1."""
    many = np.diff(starts)
    thick = frequent(many, cells)
    row = np.full(len(words), -1)
    row[thick] = np.arange(len(thick))
    bank = np.zeros((len(thick), cells), np.uint64)
    for at, i in enumerate(thick.tolist()):
        bits = np.zeros(64 * cells, np.uint8)
        bits[docs[starts[i] : starts[i + 1]]] = 1
        bank[at] = np.packbits(bits, bitorder="little").view(np.uint64)
    return bank, row


def frequent(many: np.ndarray, cells: int) -> np.ndarray:
    """Which words, held by so many entries, are bitmaps: the most frequent, as far as memory allows."""
    first = np.argsort(-many, kind="stable")[: BITMAPS // (8 * max(cells, 1))]
    return first[many[first] * DENSE > 64 * cells]


def search(words: np.ndarray, starts: np.ndarray, docs: np.ndarray, size: int, asking: Iterable[tuple[int, np.ndarray, np.ndarray]], most: int, made: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each (entry, words, weights), weights falling: the ``most`` other entries of the highest sum of weights, ties to the smaller one.

    Words are taken rarest first. Once the sums reached so far are above all that the words left can add, entries that
    have none of the words taken can't be among the best, and the others are looked up in the words left. Words of many
    entries are bitmaps: how many of them an entry has is counted for 64 entries at once, and weights are summed only for
    entries with so many words that they can be among the best. made: bitmaps of words, and for each word its row or -1; the
    others stand in docs."""
    acc = np.zeros(size)
    cells = -(-size // 64)
    bank, row = made or bitmaps(words, starts, docs, cells)
    spare, hold = np.empty((24, cells), np.uint64), np.empty((2, cells), np.uint64)
    guess = 4

    for own, asked, weights in asking:
        at = np.searchsorted(words, asked)
        has = at < len(words)
        has[has] = words[at[has]] == asked[has]
        at, weights = at[has], weights[has]
        rows = row[at]
        thin, thick = rows < 0, rows >= 0
        lists = [docs[starts[i] : starts[i + 1]] for i in at[thin]]
        rows, dense, weights = rows[thick], weights[thick], weights[thin]
        rest = dense.sum()
        left = np.r_[np.cumsum(weights[::-1])[::-1], 0.0] + rest
        at_rows = rows[:, None]
        looked = lambda c: dense @ (bank[at_rows, c >> 6] >> (c & 63).astype(np.uint64) & np.uint64(1)).astype(np.float64)
        met, total, c, low = [], 0, None, -1.0
        for k in range(len(lists) + 1):
            # No sum reached so far is above that of the words taken.
            if total > most and (k == len(lists) or len(lists[k]) > 256 and left[0] > 2 * left[k]):
                seen = np.concatenate(met) if len(met) > 1 else met[0]
                met = [seen]
                sums = acc[seen]
                if 0 <= own < size and acc[own]:
                    sums = np.where(seen == own, 0.0, sums)
                low = np.partition(sums, len(sums) - most)[len(sums) - most]
                if low > left[k] + 1e-5:
                    c = np.sort(seen[sums >= low - left[k] - 1e-5])
                    sums = acc[c]
                    for x, y in zip(lists[k:], weights[k:]):
                        i = np.searchsorted(x, c)
                        i[i == len(x)] = 0
                        sums = sums + np.where(x[i] == c, y, 0.0)
                    if len(rows):
                        sums = sums + looked(c)
                    break
            if k < len(lists):
                d = lists[k]
                now = acc[d]
                fresh = d[now == 0]
                acc[d] = now + weights[k]
                met.append(fresh)
                total += len(fresh)
        if c is None:
            c = np.concatenate(met) if met else np.zeros(0, np.int64)
            sums = acc[c]
            if len(rows):
                # No more than what the words left can add is missing.
                able = sums >= low - rest - 1e-5
                c = c[able]
                sums = sums[able] + looked(c)
                best = sums[c != own]
                low = np.partition(best, len(best) - most)[len(best) - most] if len(best) >= most else -1.0
                reach = np.cumsum(dense)
                if reach[-1] >= low - 1e-5:
                    planes = _ones([bank[r] for r in rows], spare)
                    k, k0 = min(guess, len(rows)), 0
                    ge = _least(planes, k, hold[0])
                    while k > 1 and np.count_nonzero(ge) <= most:
                        k -= 1
                        ge = _least(planes, k, hold[0])
                    while k < len(rows) and np.count_nonzero(up := _least(planes, k + 1, hold[1])) > most:
                        k += 1
                        hold = hold[::-1]
                        ge = up
                    guess = k
                    extra = _places(ge)
                    while True:
                        new = extra[acc[extra] == 0]
                        c, sums = np.r_[c, new], np.r_[sums, looked(new)]
                        best = sums[c != own]
                        if len(best) >= most:
                            low = np.partition(best, len(best) - most)[len(best) - most]
                        need = int(np.searchsorted(reach, low - 1e-5)) + 1 if low > 0 else 1
                        if k0 or need >= k:
                            break
                        k0 = need
                        more = _least(planes, need, hold[1])
                        extra = _places(np.bitwise_and(more, ~ge))
        for d in met:
            acc[d] = 0.0
        other = c != own
        c, sums = c[other], sums[other]
        if len(c) > most:
            near = sums >= np.partition(sums, len(sums) - most)[len(sums) - most] - 1e-5
            c, sums = c[near], sums[near]
        sums = np.round(sums, 6)
        first = np.lexsort((c, -sums))[:most]
        yield own, c[first], sums[first]


def shared_words(lists: DataFrame, n: int, most: int, keep: Callable | None = None) -> DataFrame:
    """(key, other, raw): for each key of lists (key, w, idf) the ``most`` best others in each shard of some of n entries; w are numbers of words, those asked for first, as many as idf has values.

    If lists has len, s and e as well (how many words there are in all, strength, entities), so have the pairs (jw, je, s, s2,
    both): Jaccard similarities of words and entities, the strengths, and whether both have entities. Of ``keep`` (jw, je, t, s,
    s2, both), t the text score, pairs are left out for which it is false, also with 1 for jw; rows without a key then count the pairs."""
    spark = lists.sparkSession
    shards = max(1, -(-n // SHARD))
    blocks = max(1, min(-(-n // BLOCK), max(-(-n // ASKED), -(-spark.sparkContext.defaultParallelism // shards))))
    # Cells are few and large: keys are chosen so that they spread evenly over tasks.
    keys = balanced(spark, shards * blocks)
    kind = lists.schema["key"].dataType.simpleString()
    whole = "e" in lists.columns
    about = ["len", "s", "named", "e"] if whole else []
    kinds = {"many": "<u4", "idf": "<f8", "len": "<u4", "s": "<f8", "named": "<u4", "e": "<i8"}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, key = b.column("place").to_numpy(), b.column("key")
            (w, many), (idf, asked) = _lists(b.column("w")), _lists(b.column("idf"))
            if whole:
                e, named = _lists(b.column("e"))
                length, s = (b.column(x).to_numpy() for x in ("len", "s"))
            first = slice(None) if whole else np.arange(len(w)) - np.repeat(np.cumsum(many) - many, many) < np.repeat(asked, many)
            wide = "<u2" if not len(w) or w.max() < 1 << 16 else "<u4"
            shard, block = place % shards, (place >> 20) % blocks
            for asks, groups, some, size in ((False, shard, slice(None), many), (True, block, first, many if whole else asked)):
                for g in np.unique(groups):
                    here = groups == g
                    one = {"many": size[here], "asked": asked[here] if asks else asked[:0], "w": w[some][np.repeat(here, size)], "idf": idf[np.repeat(here, asked)] if asks else idf[:0]}
                    if whole:
                        one |= {"len": length[here], "s": s[here], "named": named[here], "e": e[np.repeat(here, named)]}
                    row = [pa.array([asks]), pa.ListArray.from_arrays(pa.array([0, int(here.sum())], pa.int32()), key.filter(pa.array(here))), pa.array([wide == "<u2"])]
                    row += [pa.array([v.astype(wide if x == "w" else kinds.get(x, "<u4")).tobytes()], pa.binary()) for x, v in one.items()]
                    for cell in range(int(g), shards * blocks, shards) if not asks else range(int(g) * shards, (int(g) + 1) * shards):
                        yield pa.RecordBatch.from_arrays([pa.array([keys[cell]], pa.int64()), *row], ["cell", "asks", "keys", "short", *one])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["many", "asked", "w", "idf", *about]
        kept: dict[bool, list[list]] = {x: [[] for _ in ("key", *names)] for x in (False, True)}
        for b in batches:
            for asks, k, short, *row in zip(b.column("asks").to_pylist(), b.column("keys"), b.column("short").to_pylist(), *(b.column(x).to_pylist() for x in names)):
                kept[asks][0].append(k.values)
                for x, to, v in zip(names, kept[asks][1:], row):
                    to.append(np.frombuffer(v, ("<u2" if short else "<u4") if x == "w" else kinds.get(x, "<u4")))
        if not kept[False][0] or not kept[True][0]:
            return
        key, asking = (pa.concat_arrays(kept[x][0]) for x in (False, True))
        held, asks = ({x: np.concatenate(v) for x, v in zip(names, kept.pop(k)[1:])} for k in (False, True))
        # Entries are numbered in the order of keys.
        order = pc.sort_indices(key)
        key, order = key.take(order), order.to_numpy()
        starts = (np.cumsum(held["many"], dtype=np.int64) - held["many"])[order]
        many = held["many"][order].astype(np.int64)
        ends, asked = np.r_[0, np.cumsum(asks["many"], dtype=np.int64)], asks["asked"].astype(np.int64)
        cuts = np.r_[0, np.cumsum(asked)]
        words = asks["w"][np.arange(cuts[-1]) + np.repeat(ends[:-1] - cuts[:-1], asked)]
        index = inverted(held["w"], starts, many, np.unique(words))
        own = pc.index_in(asking, value_set=key).fill_null(-1).to_numpy()
        each = ((int(own[i]), words[cuts[i] : cuts[i + 1]], asks["idf"][cuts[i] : cuts[i + 1]]) for i in range(len(own)))
        found = search(*index[:3], len(key), each, most, index[3])
        if whole:
            named = held["named"][order].astype(np.int64)
            first = (np.cumsum(held["named"], dtype=np.int64) - held["named"])[order]
            length, s = held["len"][order], held["s"][order]
            mine = asks["named"].astype(np.int64)
            mine_at = np.cumsum(mine) - mine
        else:
            held.clear()
        for i in range(0, len(own), 1024):
            part = list(islice(found, 1024))
            who = np.repeat(np.arange(i, i + len(part)), [len(c) for _, c, _ in part])
            c, raw = np.concatenate([c for _, c, _ in part]), np.concatenate([s for _, _, s in part])
            more = []
            if whole:
                pairs, na, nb = len(c), mine[who], named[c]
                same = equal(asks["e"], mine_at[who], na, held["e"], first[c], nb)
                je = np.where((na > 0) & (nb > 0), same / np.maximum(na + nb - same, 1), 0.0)
                rest = [je, asks["s"][who], s[c], (na > 0) & (nb > 0)]
                size, size2 = asks["len"][who].astype(np.int64), length[c].astype(np.int64)
                low, high = np.minimum(size, size2), np.maximum(size, size2)
                t = np.minimum(raw / 20, 1.0)
                if keep:
                    ok = keep(np.where(low > 0, low / np.maximum(high, 1), 0.0), je, t, *rest[1:])
                    who, c, raw, t, size, size2, rest = who[ok], c[ok], raw[ok], t[ok], size[ok], size2[ok], [x[ok] for x in rest]
                same = common(asks["w"], ends[who], asks["many"][who].astype(np.int64), held["w"], starts[c], many[c])
                jw = same / np.maximum(size + size2 - same, 1)
                if keep:
                    ok = keep(jw, rest[0], t, *rest[1:])
                    who, c, raw, jw, rest = who[ok], c[ok], raw[ok], jw[ok], [x[ok] for x in rest]
                more = [pa.array(x) for x in (jw, *rest)]
            out = [asking.take(pa.array(who)), key.take(pa.array(c)), pa.array(raw), *more]
            if keep:
                out = [pa.concat_arrays([x, pa.array([float(pairs) if k == 2 else None], x.type)]) for k, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays(out, ["key", "other", "raw", "jw", "je", "s", "s2", "both"][: len(out)])

    packed = lists.select("key", F.xxhash64("key").alias("place"), *[c for c in ("w", "idf", "len", "s", "e") if c in lists.columns])
    packed = packed.mapInArrow(pack, f"cell long, asks boolean, keys array<{kind}>, short boolean, " + ", ".join(f"{x} binary" for x in ("many", "asked", "w", "idf", *about)))
    return packed.groupBy("cell").applyInArrow(run, f"key {kind}, other {kind}, raw double" + ", jw double, je double, s double, s2 double, both boolean" * whole)


def _spans(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places of many items from each start on, one after another."""
    return np.arange(many.sum()) + np.repeat(starts - np.cumsum(many) + many, many)


def equal(x: np.ndarray, a: np.ndarray, na: np.ndarray, y: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For each pair of short lists, from a on in x and from b on in y, how many items are the same: each is held against each."""
    left = np.repeat(_spans(a, na), np.repeat(nb, na))
    pair = np.repeat(np.arange(len(a)), na * nb)
    return np.bincount(pair[x[left] == y[_spans(np.repeat(b, na), np.repeat(nb, na))]], minlength=len(a))


def common(x: np.ndarray, a: np.ndarray, na: np.ndarray, y: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """For each pair of lists of small numbers, from a on in x and from b on in y, how many are the same. Pairs of one a stand together."""
    same = np.zeros(len(a), np.int64)
    mark = np.zeros(int(max(x.max(initial=0), y.max(initial=0))) + 1, bool)
    # An empty list begins where the next one does.
    cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (na[1:] != na[:-1])]) if len(a) else np.zeros(0, np.int64)
    ends = np.r_[0, np.cumsum(nb)]
    items = y[_spans(b, nb)]
    hits = np.zeros(len(items), bool)
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)]):
        own = x[a[i] : a[i] + na[i]]
        mark[own] = True
        np.take(mark, items[ends[i] : ends[j]], out=hits[ends[i] : ends[j]])
        mark[own] = False
    total = np.r_[0, np.cumsum(hits)]
    same[:] = total[ends[1:]] - total[ends[:-1]]
    return same


def inverted(w: np.ndarray, starts: np.ndarray, many: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Words that are asked for, where their lists start, the entries in them, and the bitmaps of frequent ones with each word's row: of entries whose words lie in w from starts on, so many."""
    n, cells = len(many), -(-len(many) // 64)
    top = int(max(w.max(initial=0), asked.max(initial=0))) + 1
    name = np.full(top, -1, np.int32)
    name[asked] = np.arange(len(asked))
    held = np.bincount(w, minlength=top)[asked]
    thick = frequent(held, cells)
    row = np.full(len(asked) + 1, -1)
    row[thick] = np.arange(len(thick))
    bank = np.zeros((len(thick), cells), np.uint64)
    view, step, thin = bank.view(np.uint8), 1 << 14, []
    for i in range(0, n, step):
        m = many[i : i + step]
        at = name[w[np.arange(m.sum()) + np.repeat(starts[i : i + step] - np.cumsum(m) + m, m)]]
        doc = np.repeat(np.arange(len(m), dtype=np.int32), m)
        to = row[at]  # the last one, -1, for words that aren't asked for
        bits = np.zeros((len(thick), 64 * -(-len(m) // 64)), bool)
        bits[to[to >= 0], doc[to >= 0]] = True
        view[:, i // 8 : i // 8 + bits.shape[1] // 8] = np.packbits(bits, axis=1, bitorder="little")
        rest = (to < 0) & (at >= 0)
        thin.append(at[rest].astype(np.int64) << 32 | (doc[rest] + i))
    both = np.sort(np.concatenate([np.zeros(0, np.int64), *thin]))
    return asked, np.r_[0, np.cumsum(np.bincount(both >> 32, minlength=len(asked)))], both & 0xFFFFFFFF, (bank, row[:-1])


def grams(text: str) -> np.ndarray:
    """Distinct character bigrams as numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(c[:-1] << 21 | c[1:])


def bigrams(texts: DataFrame) -> DataFrame:
    """(id, g): of texts (id, low) the distinct character bigrams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [grams(t) for t in b.column("low").to_pylist()]
            ends = pa.array(np.r_[0, np.cumsum([len(g) for g in sets])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["id", "g"])

    return texts.mapInArrow(run, "id long, g array<long>")


def jaccards(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of the sets at places a and b; 0 if either is empty. Pairs of one a stand together."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat, starts = pd.factorize(np.concatenate([*sets, np.zeros(0, np.int64)]))[0], np.cumsum(sizes) - sizes
    return _jaccard(common(flat, starts[a], sizes[a], flat, starts[b], sizes[b]), sizes[a], sizes[b])


def _jaccard(same: np.ndarray, size: np.ndarray, size2: np.ndarray) -> np.ndarray:
    return np.where((size == 0) | (size2 == 0), 0.0, same / np.maximum(size + size2 - same, 1))


def shared_grams(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """pairs (key, other, ...) with jg, the Jaccard similarity of the bigrams of both, from texts (key, low) of n entries.

    A cell holds the pairs of a block of entries with a group of others, the texts of the group, and those of the block."""
    spark = pairs.sparkSession
    groups = max(1, -(-n // (6 * BLOCK)))
    blocks = max(1, min(-(-n // BLOCK), max(-(-n // ASKED), -(-spark.sparkContext.defaultParallelism // groups))))
    cells = balanced(spark, blocks * groups)
    place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    most = 1 << 9

    def pack(names: dict[str, Callable[[pa.RecordBatch], tuple[np.ndarray, Callable]]]) -> Callable:
        """Rows that go to the same cells in one, as Arrow data; names: what they are there, with a number for these cells, and the cells."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rest = b.drop_columns(["x", "y"])
                for what, of in names.items():
                    at, to = of(b)
                    for c in np.unique(at).tolist():
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                            out.write_batch(rest.filter(pa.array(at == c)))
                        data = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                        for k in to(c):
                            yield pa.RecordBatch.from_arrays([pa.array([cells[k]], pa.int64()), pa.array([what]), data], ["cell", "what", "data"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {"p": [], "a": [], "b": []}
        for b in batches:
            for what, data in zip(b.column("what").to_pylist(), b.column("data")):
                kept[what].extend(pa.ipc.open_stream(data.as_buffer()))
        if not kept["p"]:
            return
        asks = pa.Table.from_batches(kept["p"]).combine_chunks()
        (sides, lows), (others, olows) = ((t.column("key").combine_chunks(), t.column("low").combine_chunks()) for t in (pa.Table.from_batches(kept.pop(x)).combine_chunks() for x in ("a", "b")))
        a = pc.index_in(asks.column("key").combine_chunks(), value_set=sides).to_numpy()
        b = pc.index_in(asks.column("other").combine_chunks(), value_set=others).to_numpy()
        # Bigrams as small numbers, of all others at once.
        numbers: dict[int, int] = {}
        used, b = np.unique(b, return_inverse=True)
        flat, sizes = small(olows.take(pa.array(used)), numbers)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(a, kind="stable")
        asks, a, b = asks.take(pa.array(order)), a[order], b[order]
        asked, a = np.unique(a, return_inverse=True)
        lows = lows.take(pa.array(asked))
        cuts = np.searchsorted(a, np.arange(0, len(asked) + most, most))
        for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                own, many = small(lows.slice(k * most, most), numbers)
                x, y = a[i:j] - k * most, b[i:j]
                same = common(own, (np.cumsum(many) - many)[x], many[x], flat, starts[y], sizes[y])
                part = asks.slice(i, j - i).append_column("jg", pa.array(_jaccard(same, many[x], sizes[y])))
                yield from part.to_batches()

    put = "cell long, what string, data binary"
    column = lambda b, c: b.column(c).to_numpy()
    one = {"p": lambda b: (column(b, "x") * groups + column(b, "y"), lambda k: [k])}
    both = {"a": lambda b: (column(b, "x"), lambda x: range(x * groups, (x + 1) * groups)), "b": lambda b: (column(b, "y"), lambda y: range(y, blocks * groups, groups))}
    asks = pairs.select(place("key", blocks).alias("x"), place("other", groups).alias("y"), *pairs.columns).mapInArrow(pack(one), put)
    sides = texts.select(place("key", blocks).alias("x"), place("key", groups).alias("y"), "key", "low").mapInArrow(pack(both), put)
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in pairs.schema.fields)
    return asks.unionByName(sides).groupBy("cell").applyInArrow(run, types + "jg double")


def small(texts: pa.Array, numbers: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams of each text, one after another, as numbers that ``numbers`` gives, and how many each has."""
    flat, sizes = [np.zeros(0, np.uint16)], []
    for i in range(0, len(texts), 512):
        some = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts.slice(i, 512).to_pylist()]
        many = np.array([max(len(c) - 1, 0) for c in some], np.int64)
        chars = np.concatenate(some).astype(np.int64)
        at = _spans(np.cumsum([len(c) for c in some]) - [len(c) for c in some], many)
        values, place = np.unique(chars[at] << 21 | chars[at + 1], return_inverse=True)
        to = np.array([numbers.setdefault(v, len(numbers)) for v in values.tolist()], np.int64)
        both = np.sort(np.repeat(np.arange(len(some)), many) << 32 | (to[place] if len(to) else place))
        both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
        flat.append((both & 0xFFFFFFFF).astype(np.uint16 if len(numbers) < 1 << 16 else np.int32))
        sizes.append(np.bincount(both >> 32, minlength=len(some)))
    return np.concatenate(flat), np.concatenate([np.zeros(0, np.int64), *sizes])


#: Words up to which the vocabulary is read on the driver and sent to the tasks; a larger one is joined.
VOCABULARY = 1_000_000
#: Classes of one shard, and of one asking block at most, of ``alike``; words of 64 bits of a signature.
CLASSES, ASKING, SIGN = 400_000, 250_000, 8


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a batch's lists one after another, and their lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _known(df: DataFrame, n: int) -> tuple[DataFrame, pd.DataFrame | None]:
    """Words of df (word, df) with hash and idf; and on the driver, rarest first, if they are few enough."""
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = df.select("df", "word", F.xxhash64("word").alias("hash"), idf.alias("idf"))
    some = known.limit(VOCABULARY + 1).orderBy("df", "word").select("hash", "idf").toPandas()
    return known, some if len(some) <= VOCABULARY else None


def ranked_words(lists: DataFrame, df: DataFrame, n: int, most: int) -> DataFrame:
    """(key, w, idf): of lists (key, w), w hashes of words, the places in the order of (df, word) of those that are in df (word, df), rising, and idf of the first ``most``. Other columns stay."""
    known, some = _known(df, n)
    others = [c for c in lists.columns if c not in ("key", "w")]
    if some is None:
        placed = numbered(cut(known.orderBy("df", "word").select("hash", "idf", F.monotonically_increasing_id().alias("id"))))
        met = lists.select("key", F.explode("w").alias("hash")).join(placed, "hash")
        all_of = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), "idf"))).alias("a"))
        found = all_of.select("key", F.col("a.id").alias("w"), F.slice(F.col("a.idf"), 1, most).alias("idf"))
        return found.join(lists.select("key", *others), "key") if others else found
    hashes, weights = some["hash"].to_numpy(np.int64), some["idf"].to_numpy(np.float64)
    place = np.argsort(hashes)
    sent = lists.sparkSession.sparkContext.broadcast((weights, place.astype(np.int32), hashes[place]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, place, ordered = sent.value
        for b in batches:
            flat, many = _lists(b.column("w"))
            row = np.repeat(np.arange(len(many)), many)
            at = np.minimum(np.searchsorted(ordered, flat), max(len(ordered) - 1, 0))
            has = ordered[at] == flat if len(ordered) else np.zeros(len(flat), bool)
            row, rank = row[has], place[at[has]] if len(ordered) else at[has]
            both = np.sort(row << 32 | rank)
            row, rank = both >> 32, both & 0xFFFFFFFF
            few = np.bincount(row, minlength=len(many))
            starts = np.r_[0, np.cumsum(few)]
            first = rank[np.arange(len(row)) - starts[row] < most]
            ends = pa.array(np.r_[0, np.cumsum(np.minimum(few, most))].astype(np.int32))
            lists_of = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(rank.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weights[first]))]
            yield pa.RecordBatch.from_arrays([b.column("key"), *lists_of, *(b.column(c) for c in others)], ["key", "w", "idf", *others])

    types = "".join(f", {c} {lists.schema[c].dataType.simpleString()}" for c in others)
    return lists.select("key", "w", *others).mapInArrow(run, f"key {lists.schema['key'].dataType.simpleString()}, w array<int>, idf array<double>{types}")


def rarest(lists: DataFrame, df: DataFrame, n: int, most: int) -> DataFrame:
    """(id, rare, idf): of lists (id, w), w hashes of words, the ``most`` rarest words that are in df (word, df), ties to the smaller word, in this order."""
    known, some = _known(df, n)
    if some is None:
        met = lists.select("id", F.explode("w").alias("hash")).join(known, "hash")
        first = met.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "word"))).where(F.col("r") <= most)
        all_of = F.array_sort(F.collect_list(F.struct("r", "hash", "idf")))
        return first.groupBy("id").agg(all_of.alias("a")).select("id", F.col("a.hash").alias("rare"), F.col("a.idf").alias("idf"))
    hashes, weights = some["hash"].to_numpy(np.int64), some["idf"].to_numpy(np.float64)
    place = np.argsort(hashes)
    sent = lists.sparkSession.sparkContext.broadcast((hashes, weights, place, hashes[place]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, place, ordered = sent.value
        for b in batches:
            flat, many = _lists(b.column("w"))
            row = np.repeat(np.arange(len(many)), many)
            at = np.minimum(np.searchsorted(ordered, flat), max(len(ordered) - 1, 0))
            has = ordered[at] == flat if len(ordered) else np.zeros(len(flat), bool)
            row, rank = row[has], place[at[has]] if len(ordered) else at[has]
            both = np.sort(row << 32 | rank)
            row, rank = both >> 32, both & 0xFFFFFFFF
            few = np.bincount(row, minlength=len(many))
            starts = np.r_[0, np.cumsum(few)]
            rank = rank[np.arange(len(row)) - starts[row] < most]
            ends = pa.array(np.r_[0, np.cumsum(np.minimum(few, most))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(hashes[rank])), pa.ListArray.from_arrays(ends, pa.array(weights[rank]))], ["id", "rare", "idf"])

    return lists.select("id", "w").mapInArrow(run, "id long, rare array<long>, idf array<double>")


def balanced(spark, cells: int) -> list[int]:
    """A key for each cell, such that no partition of a shuffle by key gets more cells than it must."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left: dict[int, list[int]] = {}
    for i, at in spark.range(max(64 * parts, 8 * cells)).select("id", F.pmod(F.hash("id"), F.lit(parts))).collect():
        left.setdefault(at, []).append(i)
    spare = iter(range(max(64 * parts, 8 * cells), 1 << 62))
    return [left[c % parts].pop() if left.get(c % parts) else next(spare) for c in range(cells)]


def _bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which word of a signature a hash belongs to, and its bit there."""
    return x & (SIGN - 1), np.uint64(1) << (x >> 8 & 63).astype(np.uint64)


def near(ids: np.ndarray, side: dict[str, np.ndarray], asking: dict[str, np.ndarray], limit: float, gap: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking class the places of those of ``side``, not before it in the order of ids, with which it may reach the limit of ``fusion_score``.

    Both hold, by class: id, more (it has several entries), fresh, s, len (words), sign, es and named (entities, one after another, and
    how many), rare and idf (likewise by asked). No words can be the same than bits of one signature that aren't missing in the other,
    and no rare word is shared whose bit is missing. Classes that both have entities but none in common reach no limit above 0.5."""
    n, low = len(ids), limit - 1e-5
    s, many, named, sign, fresh = side["s"], side["len"], side["named"], side["sign"], side["fresh"]
    doc = np.repeat(np.arange(n, dtype=np.int32), named)
    order = np.argsort(side["es"], kind="stable")
    values, starts = np.unique(side["es"][order], return_index=True)
    posts, starts = doc[order], np.r_[starts, len(doc)]
    strong = np.abs(s) > 0.3
    # Without entities on one side, only what is strongly felt can reach a limit above 0.6.
    bare = limit <= 0.6 + 1e-5
    s, size = s.astype(np.float32), many.astype(np.float32)
    every = {k: np.flatnonzero(v).astype(np.int32) for k, v in {(True, True): named == 0, (True, False): (named == 0) & (strong | bare), (False, True): np.ones(n, bool), (False, False): strong | bare}.items()}
    lists = {k: (c, s[c], size[c], strong[c], np.zeros(len(c), np.float32)) for k, c in every.items()}
    all_fresh = bool(fresh.all())
    spare = (many - side["bits"]).astype(np.float32)
    cnt = np.zeros(n, np.int16)
    firsts = np.searchsorted(ids, asking["id"])
    e_ends, r_ends, own_ends = (np.r_[0, np.cumsum(x)] for x in (asking["named"], asking["asked"], side["asked"]))
    at = np.minimum(np.searchsorted(values, asking["es"]), max(len(values) - 1, 0))
    at = np.where(values[at] == asking["es"], at, -1) if len(values) else np.full(len(asking["es"]), -1)
    rare_at, rare_bit = _bits(asking["rare"])
    own_at, own_bit = _bits(side["rare"])
    for a, (own, p) in enumerate(zip(asking["id"].tolist(), firsts.tolist())):
        s1, len1, named1, sign1 = asking["s"][a], int(asking["len"][a]), int(asking["named"][a]), asking["sign"][a]
        if len1 == 0:
            continue
        if not asking["more"][a] and p < n and ids[p] == own:
            p += 1
        felt1 = abs(s1) > 0.3
        met = []
        for e in at[e_ends[a] : e_ends[a + 1]].tolist():
            if e >= 0:
                d = posts[starts[e] : starts[e + 1]]
                d = d[np.searchsorted(d, p) :]
                before = cnt[d]
                met.append(d[before == 0])
                cnt[d] = before + 1
        rest = lists[named1 > 0, felt1]
        first = np.searchsorted(rest[0], p)
        sides = [tuple(x[first:] for x in rest)] if first < len(rest[0]) else []
        if met:
            c = np.concatenate(met)
            k = cnt[c].astype(np.float32)
            cnt[c] = 0
            sides.append((c, s[c], size[c], strong[c], k / (named[c] + np.float32(named1) - k)))
        left = []
        for c, s2, size2, felt, je in sides:
            # Of the score: what doesn't come from words and texts, and the weights of words and of rare words.
            d = np.abs(s2 - s1)
            base = 0.4 - 0.3 * d
            base[d > gap + 1e-5] = -1.0
            ww, wt = np.float32(0.4), np.float32(0.2)
            if not felt1:
                base = np.where(felt, base, 0.1 + 0.4 * je)
                ww, wt = np.where(felt, ww, np.float32(0.2)), np.where(felt, wt, np.float32(0.3))
            ok = np.flatnonzero(base + wt + ww * (np.minimum(size2, len1) / np.maximum(size2, len1)) >= low)
            if not all_fresh and not asking["fresh"][a]:
                ok = ok[fresh[c[ok]]]
            if len(ok):
                left.append((c[ok], base[ok], *((np.broadcast_to(ww, len(ok)), np.broadcast_to(wt, len(ok))) if felt1 else (ww[ok], wt[ok]))))
        if not left:
            continue
        c, base, ww, wt = left[0] if len(left) == 1 else map(np.concatenate, zip(*left))
        sign2 = sign.take(c, axis=0)
        sign2 &= sign1
        counts = np.bitwise_count(sign2)
        bits1 = int(np.bitwise_count(sign1).sum())
        # Eight counts are added by one product, whose top byte is their sum, if that fits.
        both = (counts.view(np.uint64)[:, 0] * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.float32) if bits1 < 256 else counts.sum(1, dtype=np.int32).astype(np.float32)
        same = np.minimum(np.float32(len1 - bits1), spare[c]) + both
        base = base + ww * (same / np.maximum(size[c] + len1 - same, 1))
        ok = np.flatnonzero((base + wt >= low) & (same > 0))
        if not len(ok):
            continue
        c, base, wt = c[ok], base[ok], wt[ok]
        x, y = r_ends[a], r_ends[a + 1]
        text = ((sign2[ok][:, rare_at[x:y]] & rare_bit[x:y]) != 0) @ asking["idf"][x:y]
        # The other's rare words in this one.
        asked = side["asked"][c]
        z = np.arange(asked.sum()) + np.repeat(own_ends[c] - np.cumsum(asked) + asked, asked)
        back = np.bincount(np.repeat(np.arange(len(c)), asked), side["idf"][z] * ((sign1[own_at[z]] & own_bit[z]) != 0), minlength=len(c))
        c = c[base + wt * np.minimum(np.maximum(text, back) / 20, 1.0) >= low]
        if len(c):
            yield own, c


def alike(classes: DataFrame, n: int, limit: float, gap: float) -> DataFrame:
    """(id, o): pairs of classes (id, more, fresh, s, w, e, rare, idf), id not above o, that ``near`` leaves; n is their number."""
    shards = max(1, -(-n // CLASSES))
    blocks = max(6, 12 // shards, -(-n // ASKING))
    keys = balanced(classes.sparkSession, shards * blocks)
    kinds = {"id": "<i8", "more": "?", "fresh": "?", "s": "<f8", "len": "<i4", "named": "<i4", "asked": "<i4", "es": "<i8", "rare": "<i8", "idf": "<f8", "sign": "<u8"}
    by_list = {"es": "named", "rare": "asked", "idf": "asked"}

    def pack(groups: int, cells: Callable[[int], list[int]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = {x: b.column(x).to_numpy(zero_copy_only=False) for x in ("id", "more", "fresh", "s")}
                w, col["len"] = _lists(b.column("w"))
                col["es"], col["named"] = _lists(b.column("e"))
                col["rare"], col["asked"] = _lists(b.column("rare"))
                col["idf"] = _lists(b.column("idf"))[0]
                sign = np.zeros((b.num_rows, SIGN), np.uint64)
                part, bit = _bits(w)
                np.bitwise_or.at(sign, (np.repeat(np.arange(b.num_rows), col["len"]), part), bit)
                col["sign"] = sign
                place = (col["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % groups
                for g in np.unique(place):
                    here = place == g
                    one = {x: np.ascontiguousarray((v[np.repeat(here, col[by_list[x]])] if x in by_list else v[here]).astype(kinds[x])).tobytes() for x, v in col.items()}
                    for cell in cells(int(g)):
                        yield pa.RecordBatch.from_pylist([{"cell": cell, **one}], schema=pa.schema([("cell", pa.int64()), *[(x, pa.binary()) for x in kinds]]))

        return run

    def unpack(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        side = {x: np.concatenate([np.frombuffer(v, t) for v in pdf[x]]) for x, t in kinds.items()}
        side["sign"] = side["sign"].reshape(-1, SIGN)
        return side

    def run(posts: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(posts) or not len(asks):
            return pd.DataFrame({"id": [], "o": []})
        side, asking = unpack(posts), unpack(asks)
        order = np.argsort(side["id"])
        for x, m in by_list.items():
            ends = np.cumsum(side[m])
            many = side[m][order]
            side[x] = side[x][np.arange(many.sum()) + np.repeat((ends - side[m])[order] - np.cumsum(many) + many, many)]
        side |= {x: side[x][order] for x in kinds if x not in by_list}
        side["bits"] = np.bitwise_count(side["sign"]).sum(1, dtype=np.int32)
        found = list(near(side["id"], side, asking, limit, gap))
        ids = np.repeat(np.array([i for i, _ in found], np.int64), [len(c) for _, c in found])
        return pd.DataFrame({"id": ids, "o": side["id"][np.concatenate([np.zeros(0, np.int32), *[c for _, c in found]])]})

    schema = ", ".join(["cell long", *[f"{x} binary" for x in kinds]])
    posts = classes.mapInArrow(pack(shards, lambda y: [keys[x * shards + y] for x in range(blocks)]), schema)
    asks = classes.mapInArrow(pack(blocks, lambda x: keys[x * shards : (x + 1) * shards]), schema)
    return posts.groupBy("cell").cogroup(asks.groupBy("cell")).applyInPandas(run, "id long, o long")
