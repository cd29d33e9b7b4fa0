"""The most similar vectors of every vector, by vantage-point trees.

The distance is the chord between unit vectors, d^2 = 2 - 2 cos, which is a metric. The top of the tree is fitted on a
bounded sample (``sample_most`` vectors or 16 a shard, taken by hash of their class): each node has a vantage point and the
median distance to it. Its leaves are the shards; every vector is indexed in its shard, and goes as a query to each shard
that the triangle inequality doesn't exclude. In a shard (and block of queries) a vantage-point tree over all its vectors
is built and searched for a whole block at a time; leaves are compared by a matrix product in single precision, and what
may reach a place is computed again in double precision.

Pruning is relaxed by ``factor``: a side is skipped where it lies further from the query's distance than tau / factor, tau
being the distance of the k-th best so far (or that of ``min_cosine``). Factor 1 restores exact search.

Cosines count to 12 decimals; equal ones go to the smaller key. Rows of one direction (equal unit vectors) form one class,
which bears the name of its smallest key, is indexed and searched once, and is expanded at the end, each member to k rows.
In the order (cosine, smallest key) a class outside the first k can't hold any of the k keys that are asked for, as each
class before it has a key that comes first; so k classes are kept, and no tie is lost however many there are. Directions
that differ by rounding only (a vector and its multiples in 32 bits) are classes of their own that no median divides: a
node whose vectors all lie within ``BALL`` is a ball, whose members take its smallest keys without being compared.

Scale: shards of more than twice ``shard_rows`` are cut into parts, queries of a shard into blocks of ``block_rows``, so no
task holds more than one part and one block. The driver holds the sample and the sizes of at most 2^depth_most shards.

Defined results: usable vectors have ``dim`` finite components, not all zero; others are left out, as are null keys; of
several usable vectors of one key the greatest counts; a key is never its own neighbour; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators.search import best
from engram.session import cut

#: Unit vectors this close to a third one have a cosine of 1 to 12 decimals.
BALL = 2e-7
DECIMALS = 12


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, vector as array<double>) of usable vectors, one per key."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == dim)).where(finite & F.exists(v, lambda x: x != 0.0))
    return ok.select(F.col(key).alias("key"), v.alias("v")).groupBy("key").agg(F.max("v").alias("v"))


def _unit(blobs, dim: int) -> np.ndarray:
    """Unit vectors of packed ones. Vectors of 32-bit numbers are packed as such, which loses nothing."""
    blobs = list(blobs)
    kind = np.float32 if blobs and len(blobs[0]) == 4 * dim else np.float64
    x = np.frombuffer(b"".join(blobs), kind).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class TopTree:
    """The part of the tree above the shards, as arrays in heap order; node i has children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 3) -> None:
        self.depth, rng = depth, np.random.default_rng(seed)
        nodes = 2**depth - 1
        self.points, self.radii = np.zeros((nodes, sample.shape[1] if len(sample) else 1)), np.full(nodes, 2.0)
        held = {0: np.arange(len(sample))}
        for i in range(nodes):
            ids = held.pop(i, np.zeros(0, int))
            if len(ids) > 1:
                vp = int(rng.choice(ids))
                d = chord(sample[ids], sample[vp][None])[:, 0]
                self.points[i], self.radii[i] = sample[vp], np.median(d)
                held[2 * i + 1], held[2 * i + 2] = ids[d <= self.radii[i]], ids[d > self.radii[i]]

    def route(self, x: np.ndarray, reach: float) -> np.ndarray:
        """(row, shard) pairs of the shards within reach of each row; reach < 0: only the row's own."""
        at = [(np.arange(len(x)), 0)]
        for _ in range(self.depth):
            down = []
            for rows, node in at:
                d = chord(x[rows], self.points[node][None])[:, 0]
                r = self.radii[node]
                inner, outer = (d <= r, d > r) if reach < 0 else (d - r <= reach + 1e-7, r - d <= reach + 1e-7)
                down += [(rows[inner], 2 * node + 1), (rows[outer], 2 * node + 2)]
            at = down
        first = 2**self.depth - 1
        return np.concatenate([np.stack([rows, np.full(len(rows), node - first)], 1) for rows, node in at])


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class VantageTree:
    """A vantage-point tree over unit vectors in order of their keys, searched for many queries at once."""

    def __init__(self, x: np.ndarray, leaf: int = 256, seed: int = 5) -> None:
        self.x, self.x32, self.leaf, self.rng = x, x.astype(np.float32), leaf, np.random.default_rng(seed)
        self.compared = 0
        self.root = self._build(np.arange(len(x)))

    def _build(self, ids: np.ndarray):
        """A leaf is a list of numbers in order, a node (vantage point, median, inner, outer), a ball (a member, its numbers)."""
        if len(ids) <= self.leaf:
            return ids
        vp = int(self.rng.choice(ids))
        d = chord(self.x[ids], self.x[vp][None])[:, 0]
        if d.max() <= 10 * BALL and self._near(self.x[ids], vp).all():
            return vp, ids
        mu = float(np.median(d))
        inner, outer = ids[d <= mu], ids[d > mu]
        if not len(outer):
            return ids
        return vp, mu, self._build(inner), self._build(outer)

    def _near(self, x: np.ndarray, vp: int) -> np.ndarray:
        return np.linalg.norm(x - self.x[vp], axis=1) <= BALL

    def search(self, q: np.ndarray, k: int, min_cosine: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines), n x k, the highest cosine and of equal ones the smallest number first; -1 and -inf where fewer reach min_cosine."""
        self.q, self.q32 = q, q.astype(np.float32)
        self.ids, self.cos = np.full((len(q), k), -1), np.full((len(q), k), -np.inf)
        self.k, self.floor, self.factor = k, min_cosine, factor
        self._visit(self.root, np.arange(len(q)))
        return self.ids, self.cos

    def _visit(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            self._compare(node, rows)
            return
        if len(node) == 2:
            vp, ids = node
            inside = self._near(self.q[rows], vp)
            first = np.broadcast_to(ids[: self.k], (int(inside.sum()), min(self.k, len(ids))))
            self._keep(rows[inside], first, np.ones(first.shape))
            self._compare(ids, rows[~inside])
            return
        vp, mu, inner, outer = node
        d = chord(self.q[rows], self.x[vp][None])[:, 0]
        near = d <= mu
        self._visit(inner, rows[near])
        self._visit(outer, rows[~near])
        # Distances to the k-th best have shrunk by now.
        tau = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(self.cos[rows, -1], self.floor))) / self.factor + 2e-6
        self._visit(inner, rows[~near & (d - mu <= tau)])
        self._visit(outer, rows[near & (mu - d <= tau)])

    def _compare(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.compared += len(ids) * len(rows)
        for c in range(0, len(ids), 2048):
            part_ids = ids[c : c + 2048]
            for s in range(0, len(rows), 4096):
                part = rows[s : s + 4096]
                sims = self.q32[part] @ self.x32[part_ids].T
                hit = part[sims.max(1) >= np.maximum(self.cos[part, -1], self.floor) - 1e-5]
                if len(hit):
                    exact = np.round(self.q[hit] @ self.x[part_ids].T, DECIMALS)
                    best = np.argsort(-exact, axis=1, kind="stable")[:, : self.k]
                    self._keep(hit, part_ids[best], np.take_along_axis(exact, best, 1))

    def _keep(self, rows: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> None:
        """Merges what was found into the best of the rows."""
        cos = np.hstack([self.cos[rows], np.where(cos >= self.floor, cos, -np.inf)])
        ids = np.hstack([self.ids[rows], ids])
        best = np.lexsort((ids, -cos), axis=1)[:, : self.k]
        self.cos[rows] = np.take_along_axis(cos, best, 1)
        self.ids[rows] = np.where(np.isfinite(self.cos[rows]), np.take_along_axis(ids, best, 1), -1)


def similar_classes(classes: DataFrame, dim: int, k: int, min_cosine: float, factor: float, shard_rows: int | None = None, block_rows: int | None = None, sample_most: int = 8192, depth_most: int = 14) -> DataFrame:
    """(q, b, cosine): of each class (named by its smallest key) its k best others of at least min_cosine."""
    packed = classes.select("cls", "v")
    n = packed.count()
    # Rows are copied n^2 (1 / block_rows + 1 / shard_rows) times at most: both as large as memory allows (some 150 MB a task),
    # but small enough that a small table still makes a dozen tasks.
    fitting = min(65536, max(4096, -(-n // 4)))
    shard_rows, block_rows = shard_rows or fitting, block_rows or fitting
    depth = min(depth_most, max(0, math.ceil(math.log2(max(1, n) / shard_rows))))
    tree = TopTree(_sample(packed, n, max(sample_most, 16 << depth) if depth else 0, dim), depth)
    reach = math.sqrt(max(0.0, 2 - 2 * min_cosine)) / factor

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                raw = np.stack(pdf.v.values).astype(np.float64)
                small = raw.astype(np.float32)
                blobs = [r.tobytes() for r in (small if (small == raw).all() else raw)]
                unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
                home, to = tree.route(unit, -1.0), tree.route(unit, reach)
                to = to[np.lexsort((to[:, 1], to[:, 0]))]
                shards = np.split(to[:, 1].astype(np.int32), np.searchsorted(to[:, 0], np.arange(1, len(raw))))
                yield pd.DataFrame({"cls": pdf["cls"], "vec": blobs, "home": home[np.argsort(home[:, 0]), 1].astype(np.int32), "shards": shards})

    # One row a class; copies of queries are made behind the checkpoint.
    routed = cut(packed.mapInPandas(route, "cls string, vec binary, home int, shards array<int>"))
    count = lambda c: {r.shard: r.n for r in routed.select(c.alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most 2^depth_most shards: their sizes are small tables, and may be broadcast.
    held, asked = count(F.col("home")), count(F.explode("shards"))
    parts_of = lambda n, size: max(1, math.ceil(n / size))
    sizes = [(s, parts_of(held.get(s, 0), 2 * shard_rows), parts_of(asked.get(s, 0), block_rows)) for s in sorted(held | asked)]
    cuts = F.broadcast(classes.sparkSession.createDataFrame(sizes, "shard int, parts int, blocks int"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)

    def spread(shard, query: bool, part, block) -> DataFrame:
        rows = routed.select(shard.alias("shard"), F.lit(query).alias("query"), "cls", "vec", F.xxhash64("cls").alias("h")).join(cuts, "shard")
        return rows.withColumn("part", part).withColumn("block", block).select("shard", "part", "block", "query", "cls", "vec")

    base = spread(F.col("home"), False, F.pmod("h", "parts").cast("int"), F.explode(every("blocks")))
    asks = spread(F.explode("shards"), True, F.explode(every("parts")), F.pmod("h", "blocks").cast("int"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "b": [], "cosine": []}
        b, q = rows[~rows["query"]], rows[rows["query"]]
        if len(b) and len(q):
            b = b.sort_values("cls")
            # One more than k: the query finds itself.
            ids, cos = VantageTree(_unit(b.vec.values, dim)).search(_unit(q.vec.values, dim), k + 1, min_cosine, factor)
            i, j = np.nonzero(ids >= 0)
            out = {"q": q["cls"].values[i], "b": b["cls"].values[ids[i, j]], "cosine": cos[i, j]}
        out = pd.DataFrame(out)
        return out[out.q != out.b].astype({"cosine": "float64"})

    found = base.unionByName(asks).groupBy("shard", "part", "block").applyInPandas(search, "q string, b string, cosine double")
    return best(found, ["q"], [F.desc("cosine"), F.asc("b")], k).drop("place")


def _sample(packed: DataFrame, n: int, most: int, dim: int) -> np.ndarray:
    """At most ``most`` unit vectors, by hash; the filter keeps about twice as many of the whole table for the driver to choose from."""
    if not most:
        return np.zeros((0, dim))
    whole = 1 << 40
    share = min(whole, math.ceil(2 * most / max(1, n) * whole))
    rows = packed.where(F.pmod(F.xxhash64("cls"), F.lit(whole)) < share).orderBy(F.xxhash64("cls"), "cls").limit(most).collect()
    return _unit([np.asarray(r.v, np.float64).tobytes() for r in rows], dim) if rows else np.zeros((0, dim))


def direction(v: Column) -> Column:
    """A name for the unit vector: equal for a vector and its multiples, as far as they divide without rounding."""
    # -0.0 + 0.0 = 0.0: equal vectors have equal strings.
    name = lambda high, norm: F.md5(F.array_join(F.transform(v, lambda x: (x / high / norm + F.lit(0.0)).cast("string")), ","))
    norm = lambda high: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x / high) * (x / high)))
    return _let(F.array_max(F.transform(v, F.abs)), lambda high: _let(norm(high), lambda n: name(high, n)))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once and not once for each element that uses it."""
    return F.transform(F.array(value), body)[0]


def most_similar(df: DataFrame, key: str, vector: str, dim: int, k: int = 5, min_cosine: float = -1.0, factor: float = 1.0, **sizes: int) -> DataFrame:
    """(key, neighbour, cosine): for each usable key the k others of the highest cosine, of those the ones that reach min_cosine."""
    rows = usable_vectors(df, key, vector, dim).withColumn("dir", direction(F.col("v")))
    # A direction may hold a third of all rows: each input partition sends on its k + 1 smallest keys.
    few = best(rows, ["dir"], [F.asc("key")], k + 1)
    entry = lambda c: F.array_sort(F.collect_list(c))
    classes = cut(few.groupBy("dir").agg(entry("key").alias("keys"), F.min_by("v", "key").alias("v")).withColumn("cls", F.col("keys")[0]))
    found = similar_classes(classes, dim, k, min_cosine, factor, **sizes)
    offer = lambda cosine, keys: F.transform(keys, lambda x: F.struct((-cosine).alias("far"), x.alias("key")))
    near = found.join(classes.select(F.col("cls").alias("b"), "keys"), "b").groupBy(F.col("q").alias("cls")).agg(F.flatten(F.collect_list(offer(F.col("cosine"), F.col("keys")))).alias("near"))
    none = F.array().cast("array<struct<far:double,key:string>>")
    offers = classes.join(near, "cls", "left").select("dir", F.concat(offer(F.lit(1.0), F.col("keys")), F.coalesce("near", none)).alias("offers"))
    # Rows of a hot direction meet one row of offers; adaptive execution splits them.
    mine = rows.select("key", "dir").join(offers, "dir")
    chosen = F.slice(F.array_sort(F.filter("offers", lambda x: x["key"] != F.col("key"))), 1, k)
    out = mine.select("key", F.explode(chosen).alias("o")).select("key", F.col("o.key").alias("neighbour"), (-F.col("o.far")).alias("cosine"))
    return out.where(F.col("cosine") >= min_cosine)


def similar_pairs(df: DataFrame, key: str, vector: str, dim: int, k: int = 5, min_cosine: float = 0.9, factor: float = 1.0, **sizes: int) -> DataFrame:
    """Distinct (key_a, key_b), key_a < key_b, of which at least one takes the other."""
    near = most_similar(df, key, vector, dim, k, min_cosine, factor, **sizes)
    return near.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()
