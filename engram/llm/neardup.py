"""Near-duplicate records by min-max hashing.

A record's text is folded (lower case, every run of other characters than letters and digits one space, ends trimmed) and
cut into substrings of ``width`` characters. Each of ``permutations`` multiply-add permutations of 32 bits is evaluated
once per substring, and both its minimum and its maximum are kept: two signature values for one evaluation, each of which
two texts share with probability J, and whose average varies less than that of as many minima, since the two ends of one
permutation are (slightly) negatively dependent. Bands of ``rows`` values bring candidates together: with 100
permutations and 4 values to a band there are 50 bands, which miss a pair of J = 0.6 with probability
(1 - 0.6^4)^50 < 0.1 % and one of J = 0.8 practically never.

Records of equal folded text and equal entities form a class. Only classes are compared, each by its smallest key; copies
cost one row of membership each, and are expanded only where pairs of records are asked for.

Candidates meet by the band's key, a few bands a pass, so that the disk never holds more of them than that. A row of a
band is packed into few bytes, and a bucket's rows are compared as arrays: their sizes, a signature of their entities (no
more entities can be the same than its bits allow, so it loses nothing) and a 128-bit sketch (2 bits of 64 minima), so that
of a bucket only plausible pairs are emitted, not all; a pair of J = 0.6 passes it but for 1 in 10^4. Buckets of more than
``cap`` classes are cut into chunks, which meet each other in separate tasks, so that no bucket is ever skipped and none is
compared in one task. Survivors are checked exactly, on texts that are read again.

Defined results: texts are keyed by ``key``; of several rows of one key the greatest text and list count; null keys and
texts, and those folded to fewer than ``least`` characters, belong to no pair; two empty entity sets count as equal; an
empty table gives an empty result. Pairs have id_a < id_b. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.terms import term_list
from engram.operators.components import components
from engram.session import cut, cut_and_clear

#: Bands of each text that meet in one pass, at least; and rows of bands that a pass may have beyond that.
STEP, PASS_ROWS = 5, 2_000_000

_OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def substring_hashes(text: str, width: int) -> np.ndarray:
    """A well mixed 32-bit hash of each substring of ``width`` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


class MinMax:
    """Min-max signatures of many texts at once."""

    def __init__(self, permutations: int = 100, rows: int = 4, width: int = 5, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 2**32, permutations, dtype=np.uint32)
        self.permutations, self.rows, self.width = permutations, rows, width

    def signatures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x 2 permutations: the minima, then the maxima; distinct substrings). Each text has at least one substring."""
        sigs = np.empty((len(texts), 2 * self.permutations), np.uint32)
        sizes = np.empty(len(texts), np.int32)
        group, total, first = [], 0, 0
        for i, t in enumerate(texts):
            h = np.unique(substring_hashes(t, self.width))
            sizes[i] = len(h)
            group.append(h)
            total += len(h)
            if total >= 8192 or i == len(texts) - 1:
                starts = np.cumsum([0, *(len(x) for x in group[:-1])])
                values = np.concatenate(group)[None, :] * self.a[:, None] + self.b[:, None]
                sigs[first : i + 1, : self.permutations] = np.minimum.reduceat(values, starts, axis=1).T
                sigs[first : i + 1, self.permutations :] = np.maximum.reduceat(values, starts, axis=1).T
                group, total, first = [], 0, i + 1
        return sigs, sizes

    def bands(self, sigs: np.ndarray) -> np.ndarray:
        """A 32-bit key of each band, in which the band's number is mixed. Keys that are equal by chance only cost a comparison."""
        count = sigs.shape[1] // self.rows
        values = sigs[:, : count * self.rows].reshape(len(sigs), count, self.rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), values.shape[:2]).copy()
        for r in range(self.rows):
            h = (h ^ values[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def sketch(self, sigs: np.ndarray) -> np.ndarray:
        """Two words of 32 x 2 bits of the first 64 minima."""
        bits = ((sigs[:, :64] * np.uint32(0x85EBCA6B)) >> np.uint32(30)).astype(np.uint64)
        shift = np.arange(32, dtype=np.uint64) * np.uint64(2)
        return np.stack([(bits[:, :32] << shift).sum(1, dtype=np.uint64), (bits[:, 32:] << shift).sum(1, dtype=np.uint64)], 1).view(np.int64)


def one_each(df: DataFrame, key: str, text: str, entities: str) -> DataFrame:
    """(id, text, entities): one row for each key with a text. Only keys of several rows are moved with their texts."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(entities).alias("entities"))
    again = few(rows.groupBy("id").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("id"))
    merged = rows.join(again, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"), F.max("entities").alias("entities"))
    one = rows.join(again, "id", "left_anti").unionByName(merged)
    return one.select("id", "text", F.array_sort(F.array_distinct(term_list(F.col("entities")))).alias("entities"))


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Fixed rows for a join: broadcast if they are a checked number, else shuffled, whatever their size is thought to be."""
    rows = cut(df)
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


def signed(df: DataFrame, key: str, text: str, entities: str, least: int, maker: MinMax) -> DataFrame:
    """(id, cls, n, e, g, s1, s2, bands): one row for each key with a text that is long enough; g has a bit for each of its entities."""
    # Lower case may lengthen a text (at most threefold), folding only shortens it.
    one = one_each(df, key, text, entities).where(F.length("text") >= least // 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            folded = [fold(t) for t in pdf.text]
            keep = [i for i, t in enumerate(folded) if len(t) >= max(least, maker.width)]
            if not keep:
                continue
            texts = [folded[i] for i in keep]
            sigs, sizes = maker.signatures(texts)
            sketch = maker.sketch(sigs)
            part = pdf.iloc[keep]
            names = [[x.encode("utf-8", "surrogatepass") for x in es] for es in part.entities]
            bits = np.array([sum({1 << (zlib.crc32(x) & 63) for x in es}) for es in names], np.uint64).view(np.int64)
            cls = [hashlib.md5(b"\x1f".join([t.encode("utf-8", "surrogatepass"), *es])).digest() for t, es in zip(texts, names)]
            yield pd.DataFrame({"id": part.id.values, "cls": cls, "n": sizes, "e": np.array([len(es) for es in names], np.int32), "g": bits, "s1": sketch[:, 0], "s2": sketch[:, 1], "bands": list(maker.bands(sigs))})

    return one.mapInPandas(run, "id string, cls binary, n int, e int, g long, s1 long, s2 long, bands array<int>")


class Classes:
    """Signed records, their classes, and the pairs of classes that reach the thresholds."""

    def __init__(self, df: DataFrame, key: str, text: str, entities: str, jaccard: float, entity_jaccard: float, least: int, width: int, permutations: int, rows: int, cap: int) -> None:
        maker = MinMax(permutations, rows, width)
        every = cut_and_clear(signed(df, key, text, entities, least, maker).withColumn("num", F.monotonically_increasing_id()))
        sizes = every.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
        #: (id, rep, size) of the members of classes with copies; few or many, they are rows, never lists.
        self.members = cut_and_clear(every.select("id", "cls").join(sizes.where("size > 1").hint("merge"), "cls").select("id", "rep", "size"))
        leads = every.join(few(self.members.where("id <> rep").select("id")), "id", "left_anti").select("num", "n", "e", "g", "s1", "s2", "bands")
        found, step = None, max(STEP, PASS_ROWS // max(1, every.count()))
        for k in range(0, 2 * permutations // rows, step):
            bands = leads.select(F.col("num").alias("id"), "n", "e", "g", "s1", "s2", F.explode(F.slice("bands", k + 1, step)).alias("band"))
            met = cut_and_clear(candidate_pairs(bands, jaccard, entity_jaccard, cap))
            found = met if found is None else found.unionByName(met)
        name = lambda s: every.select(F.col("num").alias(s), F.col("id").alias(f"id_{s}")).hint("merge")
        named = found.distinct().join(name("a"), "a").join(name("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        self.pairs = cut_and_clear(exact_pairs(cut_and_clear(named), one_each(df, key, text, entities), jaccard, entity_jaccard, width))


def _fields(width: int) -> np.dtype:
    """A packed row of a band; keys are numbers, or bytes of this width."""
    return np.dtype([("id", f"S{width}" if width else "<i8"), ("band", "<u4"), ("n", "<u4"), ("e", "<u4"), ("g", "<u8"), ("s1", "<u8"), ("s2", "<u8")])


def candidate_pairs(bands: DataFrame, jaccard: float, entity_jaccard: float, cap: int = 2048, slots: int = 30, broadcast_most: int = 0) -> DataFrame:
    """Distinct (a, b), a < b, that share a band and whose sizes, entities and sketches allow both thresholds. ``bands`` may lack g. Nothing is broadcast, whatever ``broadcast_most`` says."""
    kind = dict(bands.dtypes)["id"]
    tasks = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * tasks

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf.id.to_numpy() if kind == "bigint" else np.array([x.encode() for x in pdf.id])
            width = 0 if kind == "bigint" else ids.dtype.itemsize
            x = np.zeros(len(pdf), _fields(width))
            x["id"] = ids
            for c in pdf.columns.drop("id"):
                x[c] = pdf[c].to_numpy().astype(np.int64).view(np.uint64)
            part = x["band"] % parts
            order = np.argsort(part, kind="stable")
            x, part = x[order], part[order]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            yield pd.DataFrame({"part": part[starts].astype(np.int64), "width": width, "rows": [x[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(x)])]})

    odd = np.uint64(0x5555555555555555)

    def fits(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of rows those that may reach the thresholds; the cheapest and sharpest test comes first."""
        g, h, e, f = c["g"][i], c["g"][j], c["e"][i], c["e"][j]
        same = np.minimum(e - np.bitwise_count(g & ~h), f - np.bitwise_count(h & ~g))
        ok = same * (1 + entity_jaccard) >= (e + f) * entity_jaccard - 1e-9
        i, j = i[ok], j[ok]
        n, m = c["n"][i], c["n"][j]
        ok = (np.minimum(n, m) >= np.maximum(n, m) * jaccard) & (c["id"][i] != c["id"][j])
        i, j = i[ok], j[ok]
        differ = np.zeros(len(i), np.int64)
        for s in ("s1", "s2"):
            x = c[s][i] ^ c[s][j]
            differ += np.bitwise_count((x | (x >> np.uint64(1))) & odd)
        ok = differ <= 64 - slots
        return i[ok], j[ok]

    def columns(x: np.ndarray) -> dict[str, np.ndarray]:
        return {c: np.ascontiguousarray(x[c]).astype(np.int64) if c in ("n", "e") else np.ascontiguousarray(x[c]) for c in x.dtype.names}

    def within(x: np.ndarray) -> np.ndarray:
        """(2, pairs): keys of the pairs of rows of one band that fit. Rows are in order of bands."""
        c = columns(x)
        last = np.searchsorted(c["band"], c["band"], side="right")
        at, out, d = np.arange(len(x)), [], 1
        while len(at := at[at + d < last[at]]):
            # Several distances at once, while few rows are left.
            steps = min(max(1, 65536 // len(at)), int((last[at] - at).max()) - d)
            i, j = np.repeat(at, steps), (at[:, None] + np.arange(d, d + steps)).ravel()
            ok = j < last[i]
            out.append(np.stack([c["id"][k] for k in fits(c, i[ok], j[ok])]))
            d += steps
        return ordered(out)

    def ordered(found: list[np.ndarray]) -> np.ndarray:
        if not found:
            return np.zeros((2, 0), np.int64)
        a, b = np.concatenate(found, 1)
        return np.where(a < b, [a, b], [b, a])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(r, _fields(w)) for w, r in zip(pdf.width, pdf.rows)])
        x = x[np.argsort(x["band"], kind="stable")]
        starts = np.flatnonzero(np.r_[True, x["band"][1:] != x["band"][:-1]])
        many = np.diff(np.r_[starts, len(x)])
        width = max(pdf.width)
        out = []
        for i, m in zip(starts[many > cap], many[many > cap]):
            chunks = [x[k : min(k + cap, i + m)].tobytes() for k in range(i, i + m, cap)]
            out += [(int(x["band"][i]) * 31 + p * len(chunks) + q, width, chunks[p], chunks[q] if q > p else b"") for p in range(len(chunks)) for q in range(p, len(chunks))]
        small = np.repeat((many > 1) & (many <= cap), many)
        found = within(x[small])
        if found.size:
            out.append((int(pdf.part.iloc[0]), width, None, found.tobytes()))
        return pd.DataFrame(out, columns=["task", "width", "one", "other"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, one, other in zip(pdf.width, pdf.one, pdf.other):
                if one is None:
                    a, b = np.frombuffer(other, _fields(width)["id"]).reshape(2, -1)
                elif not len(other):
                    a, b = within(np.frombuffer(one, _fields(width)))
                else:
                    x = np.frombuffer(one + other, _fields(width))
                    c, first = columns(x), len(one) // x.dtype.itemsize
                    found = []
                    for i in range(0, first, 256):
                        rows = np.arange(i, min(i + 256, first))
                        pair = fits(c, np.repeat(rows, len(x) - first), np.tile(np.arange(first, len(x)), len(rows)))
                        found.append(np.stack([c["id"][k] for k in pair]))
                    a, b = ordered(found)
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b} if not width else {"a": [k.decode() for k in a], "b": [k.decode() for k in b]})

    packed = bands.mapInPandas(pack, "part long, width int, rows binary")
    found = packed.groupBy("part").applyInPandas(meet, "task long, width int, one binary, other binary")
    return found.repartition(tasks, "task").mapInPandas(finish, f"a {kind}, b {kind}").distinct()


def exact_pairs(pairs: DataFrame, rows: DataFrame, jaccard: float, entity_jaccard: float, width: int) -> DataFrame:
    """(a, b, jaccard, entity_jaccard) of the pairs that reach both thresholds; rows are (id, text, entities)."""
    # Entities first, on rows without texts: few pairs are left for which texts must be sent.
    rows = rows.join(few(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
    same = F.size(F.array_intersect("entities_a", "entities_b"))
    both = F.size("entities_a") + F.size("entities_b") - same
    near = F.when(both == 0, F.lit(1.0)).otherwise(same / both)
    of = lambda s, c: rows.select(F.col("id").alias(s), F.col(c).alias(f"{c}_{s}")).hint("merge")
    close = pairs.join(of("a", "entities"), "a").join(of("b", "entities"), "b").select("a", "b", near.alias("entity_jaccard")).where(F.col("entity_jaccard") >= entity_jaccard)
    joined = close.join(of("a", "text"), "a").join(of("b", "text"), "b")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept: dict[str, set[str]] = {}

            def parts(i: str, t: str) -> set[str]:
                if i not in kept:
                    f = fold(t)
                    kept[i] = {f[k : k + width] for k in range(len(f) - width + 1)}
                return kept[i]

            j = np.empty(len(pdf))
            for k, (ia, ib, ta, tb) in enumerate(zip(pdf.a, pdf.b, pdf.text_a, pdf.text_b)):
                x, y = parts(ia, ta), parts(ib, tb)
                same = len(x & y)
                j[k] = same / (len(x) + len(y) - same)
            yield pd.DataFrame({"a": pdf.a, "b": pdf.b, "jaccard": j, "entity_jaccard": pdf.entity_jaccard})[j >= jaccard]

    return joined.select("a", "b", "text_a", "text_b", "entity_jaccard").mapInPandas(exact, "a string, b string, jaccard double, entity_jaccard double")


def near_pairs(
    df: DataFrame, key: str, text: str, entities: str, jaccard: float = 0.6, entity_jaccard: float = 0.5, least: int = 60, width: int = 5, permutations: int = 100, rows: int = 4, cap: int = 2048
) -> DataFrame:
    """(id_a, id_b, jaccard, entity_jaccard) of all pairs that reach both thresholds, copies too."""
    c = Classes(df, key, text, entities, jaccard, entity_jaccard, least, width, permutations, rows, cap)
    named = lambda pairs, a, b: pairs.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"), "jaccard", "entity_jaccard")
    if c.members.isEmpty():
        return named(c.pairs, "a", "b")
    # A class without copies stands for itself.
    of = lambda s: c.members.select(F.col("rep").alias(s), F.col("id").alias(f"id_{s}"))
    across = c.pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"x": F.coalesce("id_a", "a"), "y": F.coalesce("id_b", "b")})
    # Copies of one class meet in chunks, so that a large class is spread over tasks.
    chunks = F.ceil(F.col("size") / 1024).cast("int")
    left = c.members.select("rep", F.col("id").alias("x"), F.pmod(F.xxhash64("id"), chunks).cast("int").alias("chunk"))
    right = c.members.select("rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    within = left.join(right, ["rep", "chunk"]).where("x < y").withColumns({"jaccard": F.lit(1.0), "entity_jaccard": F.lit(1.0)})
    return named(across, "x", "y").unionByName(named(within, "x", "y"))


def near_groups(
    df: DataFrame, key: str, text: str, entities: str, jaccard: float = 0.6, entity_jaccard: float = 0.5, least: int = 60, width: int = 5, permutations: int = 100, rows: int = 4, cap: int = 2048
) -> DataFrame:
    """(id, group_id, links): every key that has a text, its group (the smallest key linked to it, over any number of steps) and its number of links. Copies aren't expanded into pairs."""
    c = Classes(df, key, text, entities, jaccard, entity_jaccard, least, width, permutations, rows, cap)
    labels, _ = components(c.pairs, "a", "b")
    sizes = c.members.where("id = rep").select("rep", "size")
    both = c.pairs.select("a", F.col("b").alias("rep")).unionByName(c.pairs.select(F.col("b").alias("a"), F.col("a").alias("rep")))
    # A record is linked to the other members of its class and to all members of the classes linked to it.
    across = both.join(sizes, "rep", "left").groupBy(F.col("a").alias("rep")).agg(F.sum(F.coalesce("size", F.lit(1))).alias("across"))
    ids = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id")).distinct()
    own = ids.join(c.members, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), (F.coalesce("size", F.lit(1)) - 1).alias("copies"))
    out = own.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(across, "rep", "left")
    return out.select("id", F.coalesce("component", "rep").alias("group_id"), (F.col("copies") + F.coalesce("across", F.lit(0))).alias("links"))
