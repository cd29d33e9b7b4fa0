"""Filling containers of fixed capacity with texts, measured in tokens.

The plan is made for sizes, not for texts: sizes are whole numbers up to the capacity, so the table of size and count
has at most ``capacity`` rows, however many texts there are. Texts longer than the capacity are first cut into pieces of
full capacity and a rest.

* Large sizes (above a third): at most two fit beside each other, so they are matched greedily, from the largest down,
  each with the largest other large size that fits beside it; what finds none stands alone.
* Smaller sizes, from the largest down, go to the smallest gap that still holds them (best fit), and open new containers
  when no gap does.

Both steps move as many containers of a kind at a time as there are, so the plan's length depends on the capacity
alone. It is a list of runs "the texts number i .. i+q-1 of size s go to containers b .. b+q-1". Each text then
gets its number within its size without collecting a size into one task: sizes are split into ``lanes`` (more for more texts) by a
hash of the id, numbered within their lane, and shifted by the counts of the lanes before. The run is found by
binary search. The same input gives the same packing.

Defined results: null texts count as empty; empty texts have size 0, need no room and are spread over the containers in
turn; if there is nothing but empty texts, container 0 takes them; repeated ids are packed each on their own; an empty
table gives an empty result. Extra columns are not carried along.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engram.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
VOCABULARY_MOST = 50_000_000
#: Splits before byte pairs are merged: contractions, words, numbers, other characters, white space.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver, so that executors need no file of that name. Its size is checked before it is sent to them."""
    with open(path, "rb") as f:
        held = f.read(VOCABULARY_MOST + 1)
    if len(held) > VOCABULARY_MOST:
        raise ValueError(f"{path}: more than {VOCABULARY_MOST} bytes")
    return held


@functools.lru_cache(maxsize=2)
def encoding(held: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.splitlines())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_column: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of every row; whole texts are encoded."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoding(held.value)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "tokens": np.array([len(own.encode_ordinary(t)) if t else 0 for t in pdf.text], np.int64)})

    return df.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, "id string, tokens long")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first number, how many, first container), and the number of containers. Sizes are 1 .. capacity."""
    left = {s: c for s, c in counts.items() if c > 0 and s > 0}
    taken = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of containers (first, how many)
    open_gaps: list[int] = []

    def put(size: int, many: int, first: int) -> None:
        runs.append((size, taken[size], many, first))
        taken[size] += many
        left[size] -= many

    def leave(gap: int, first: int, many: int) -> None:
        if gap > 0 and many > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, many))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        if not left[s]:
            large.pop()
            continue
        k = bisect_left(large, capacity - s + 1) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        if k < 0:
            many, other = left[s], 0
            put(s, many, bins)
        else:
            other = large[k]
            many = left[s] // 2 if other == s else min(left[s], left[other])
            if many == 0:  # a single one of a size that pairs with itself: the next smaller will do
                k = next((j for j in range(k - 1, -1, -1) if left[large[j]]), -1)
                other, many = (large[k], 1) if k >= 0 else (0, 1)
            put(s, many, bins)
            if other:
                put(other, many, bins)
        leave(capacity - s - other, bins, many)
        bins += many
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            g = bisect_left(open_gaps, s)
            if g == len(open_gaps):
                each = capacity // s
                many = -(-left[s] // each)
                full, rest = divmod(left[s], each)
                for _ in range(each):  # layer by layer; the last container may hold fewer
                    if full:
                        put(s, full, bins)
                for _ in range(rest):
                    put(s, 1, bins + full)
                leave(capacity - each * s, bins, full)
                if rest:
                    leave(capacity - rest * s, bins + full, 1)
                bins += many
                continue
            gap = open_gaps[g]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(g)
            q = min(many, left[s])
            each = min(gap // s, left[s] // q)
            for _ in range(each):
                put(s, q, first)
            leave(gap - each * s, first, q)
            if many > q:
                leave(gap, first + q, many - q)
    return runs, bins


def lanes_for(rows: int) -> int:
    """Lanes by the number of texts: one size may hold any share of them, and a lane should hold no more than about a million."""
    return min(1024, max(64, -(-rows // 1_000_000)))


def pack(sized: DataFrame, capacity: int, lanes: int = 64) -> DataFrame:
    """(id, piece, tokens, container) of (id, tokens): pieces of texts longer than the capacity are numbered from 0."""
    full = F.floor(F.col("tokens") / capacity).cast("long")
    rest = F.col("tokens") - full * capacity
    sizes = F.when(F.col("tokens") <= capacity, F.array("tokens")).otherwise(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>"))))
    lane = F.pmod(F.xxhash64("id", "piece"), F.lit(lanes)).cast("int")
    pieces = sized.select("id", F.posexplode(sizes).alias("piece", "tokens")).withColumn("lane", lane)
    numbered = cut(pieces.withColumn("number", F.row_number().over(Window.partitionBy("tokens", "lane").orderBy("id", "piece")) - 1))
    # At most (capacity + 1) x lanes rows, whatever the input.
    table = numbered.groupBy("tokens", "lane").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts: dict[int, int] = {}
    shift: dict[int, np.ndarray] = {}
    for r in table.sort_values(["tokens", "lane"]).itertuples():
        shift.setdefault(r.tokens, np.zeros(lanes, np.int64))[r.lane] = counts.get(r.tokens, 0)
        counts[r.tokens] = counts.get(r.tokens, 0) + r.n
    runs, bins = plan(counts, capacity)
    by_size: dict[int, list[tuple[int, int]]] = {}
    for s, start, _, first in runs:
        by_size.setdefault(s, []).append((start, first))
    held = sized.sparkSession.sparkContext.broadcast(({s: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for s, v in by_size.items()}, shift, max(1, bins)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, before, total = held.value
        for pdf in batches:
            out = np.empty(len(pdf), np.int64)
            tokens, lane_of, number = pdf.tokens.values, pdf.lane.values, pdf.number.values
            order = np.argsort(tokens, kind="stable")
            edges = np.nonzero(np.diff(tokens[order]))[0] + 1
            for rows in np.split(order, edges):
                if not len(rows):
                    continue
                s = int(tokens[rows[0]])
                rank = number[rows] + before[s][lane_of[rows]]
                if s == 0:
                    out[rows] = rank % total
                else:
                    at, first = starts[s]
                    k = np.searchsorted(at, rank, side="right") - 1
                    out[rows] = first[k] + rank - at[k]
            yield pd.DataFrame({"id": pdf.id, "piece": pdf.piece, "tokens": tokens, "container": out})

    return numbered.mapInPandas(assign, "id string, piece int, tokens long, container long")


def pack_texts(df: DataFrame, id_column: str, text: str, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece, tokens, container) for the texts of a table."""
    return pack(token_counts(df, id_column, text, tokenizer), capacity, lanes_for(df.select(id_column).count()))
