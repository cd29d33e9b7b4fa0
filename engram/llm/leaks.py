"""Evaluation passages that leak into training documents, by an FM-index per shard.

Texts are cut into units: after NFKC, lower case and removal of format characters, a unit is one Han character or an
unbroken run of other letters and digits. Test phrases are all windows of ``window`` consecutive units of the items.

Each task streams its documents into shards of about ``shard_units`` indexed units. The alphabet of a shard is the
units that occur in any test phrase; every other unit, and every document's end, is a separator, of which one stands for
several in a row. Runs between separators that are shorter than a phrase are separators too. (A phrase holds no separator,
so nothing can be lost by this, and the index needs memory only for what a phrase could touch. Every unit of every
document is read and mapped.) Over that text stand a suffix array by prefix
doubling, its Burrows-Wheeler transform in a wavelet matrix with rank tables, and sampled suffix positions: each 16th
and every first position after a separator, so that a walk never has to cross one. All phrases are searched backward at
once, a vector of intervals per step; what is found is located by walking to samples; windows of one document and item
that overlap or touch are merged to spans.

Scale: no document leaves its task before it matches; only spans are returned. Items are held in blocks of at most
``block_units`` units, of which a pass over the documents, which cuts them into units once, takes ``blocks_a_pass``; their number
follows the test material, not the corpus. A
document is never cut; one longer than a shard is a shard of its own.

Defined results: null or empty texts and items with fewer than ``window`` units match nothing; items that share a phrase are
all reported; repeated document rows are reported once in leaks(); null ids are kept as null; an empty table on either
side gives an empty result. Other columns are never read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HAN = "⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_UNIT = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")
_FORMAT = re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") + "]")


def units(text: str) -> list[str]:
    """The units of a text, in order."""
    return _UNIT.findall(_FORMAT.sub("", unicodedata.normalize("NFKC", text).lower()))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order. 0 is a separator, each its own symbol, in order of position; text ends with one."""
    n = len(text)
    at = np.nonzero(text == 0)[0]
    left = at[np.searchsorted(at, np.arange(n))] - np.arange(n)  # distance to the next separator
    pack, bits = np.zeros(n, np.int64), max(1, int(text.max()).bit_length())
    width = max(1, min(62 // bits, n))
    alive = np.ones(n, bool)
    for i in range(width):
        pack <<= bits
        alive &= left > i
        m = n - i
        pack[:m] |= np.where(alive[:m], text[i:], 0).astype(np.int64)
    order = np.argsort(pack, kind="stable")
    ended = left < width
    fresh = np.ones(n, bool)
    fresh[1:] = (np.diff(pack[order]) != 0) | ended[order[1:]] | ended[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = width
    while True:
        alone = fresh & np.append(fresh[1:], True)
        slots = np.nonzero(~alone)[0]
        if not len(slots):
            return order
        ids = order[slots]
        key = rank[ids] * n + rank[ids + h]
        by = np.argsort(key, kind="stable")
        ids, key = ids[by], key[by]
        order[slots] = ids
        new = np.ones(len(slots), bool)
        new[1:] = np.diff(key) != 0
        fresh[slots] = new
        rank[ids] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= 2


class WaveletMatrix:
    """Rank and access over integers, by levels from the highest bit; values of a level with bit 0 go first on the next."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.ranks, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        # Where each value's run begins below the last level.
        self.begin = self.descend(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ranks, self.zeros)):
            up = ones[at]
            at = np.where((symbols >> (self.levels - 1 - k)) & 1, zeros + up, at - up)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self.descend(symbols, at) - self.begin[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbols, place = np.zeros(len(at), np.int64), at
        for ones, zeros in zip(self.ranks, self.zeros):
            up = ones[place]
            bit = ones[place + 1] - up
            symbols = symbols * 2 + bit
            place = np.where(bit == 1, zeros + up, place - up)
        return symbols, place - self.begin[symbols]


class FMIndex:
    """Full-text index of a text of integers, in which 0 separates; the text begins and ends with 0."""

    def __init__(self, text: np.ndarray, sample: int = 16) -> None:
        order = suffix_array(text)
        before = text[order - 1]
        self.bwt = WaveletMatrix(before)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bwt.levels))])
        marked = (order % sample == 0) | (before == 0)
        self.marks = np.zeros(len(text) + 1, np.int32)
        np.cumsum(marked, out=self.marks[1:])
        self.samples = order[marked].astype(np.int32)
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, from, to) of the phrases that occur; phrases is a matrix of symbols, all of the text's alphabet."""
        alive = np.nonzero((phrases < len(self.first) - 1).all(1))[0]
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), self.size)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            lo, hi = self.first[c] + self.bwt.rank(c, lo), self.first[c] + self.bwt.rank(c, hi)
            ok = lo < hi
            alive, lo, hi = alive[ok], lo[ok], hi[ok]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the index."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            have = self.marks[rows + 1] > self.marks[rows]
            out[todo[have]] = self.samples[self.marks[rows[have]]] + steps
            todo, rows = todo[~have], rows[~have]
            symbols, ranks = self.bwt.access(rows)
            rows = self.first[symbols] + ranks
            steps += 1
        return out


class Phrases:
    """All windows of a block of items, and the alphabet."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        self.window, self.numbers = window, {}
        rows, owner = [], []
        for item, text in items:
            u = [self.numbers.setdefault(x, len(self.numbers) + 1) for x in units(text or "")]
            for i in range(len(u) - window + 1):
                rows.append(u[i : i + window])
                owner.append(item)
        matrix = np.array(rows, np.int64).reshape(-1, window)
        self.matrix, which = np.unique(matrix, axis=0, return_inverse=True)
        which = np.asarray(which).reshape(-1)
        order = np.argsort(which, kind="stable")
        self.owners = np.array(owner, np.int64)[order]
        self.bounds = np.searchsorted(which[order], np.arange(len(self.matrix) + 1))


def expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    lengths = ends - starts
    which = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[which], which


def long_runs(mapped: np.ndarray, window: int) -> np.ndarray:
    """The units with runs between separators that are shorter than a phrase set to 0."""
    edges = np.concatenate([[-1], np.nonzero(mapped == 0)[0], [len(mapped)]])
    return np.where(np.repeat(np.diff(edges) > window, np.diff(edges))[: len(mapped)], mapped, 0)


def shard_spans(docs: list, texts: list[np.ndarray], phrases: Phrases) -> pd.DataFrame:
    """Spans of one shard; texts are mapped units, 0 for those outside the alphabet."""
    parts, unit, doc = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for d, t in enumerate(texts):
        keep = np.append(t, 0) != 0
        keep[1:] |= keep[:-1]  # the first separator after kept units stays
        at = np.nonzero(keep)[0]
        parts.append(np.append(t, 0)[at])
        unit.append(at)
        doc.append(np.full(len(at), d))
    text, unit, doc = (np.concatenate(x) for x in (parts, unit, doc))
    none = pd.DataFrame({"doc_id": [], "item_id": [], "start": [], "end": []})
    if len(text) <= phrases.window:
        return none
    index = FMIndex(text)
    found, lo, hi = index.search(phrases.matrix)
    if not len(found):
        return none
    rows, which = expand(lo, hi)
    places = index.locate(rows)
    owners, hit = expand(phrases.bounds[found[which]], phrases.bounds[found[which] + 1])
    d, item, start = doc[places[hit]], phrases.owners[owners], unit[places[hit]]
    order = np.lexsort((start, item, d))
    d, item, start = d[order], item[order], start[order]
    new = np.ones(len(d), bool)
    new[1:] = (np.diff(d) != 0) | (np.diff(item) != 0) | (start[1:] > start[:-1] + phrases.window)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(d)) - 1
    return pd.DataFrame({"doc_id": pd.array([docs[x] for x in d[first]], dtype="Int64"), "item_id": item[first], "start": start[first], "end": start[last] + phrases.window})


def leaked_spans(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, shard_units: int = 1_000_000, block_units: int = 500_000, blocks_a_pass: int = 4) -> DataFrame:
    """(doc_id, item_id, start, end): merged spans, in units of the document, that hold text of the item."""
    known = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    # A unit has at least one character: blocks by characters are blocks of at most as many units.
    size = known.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_units))
    narrow = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for first in range(0, blocks, blocks_a_pass):
        held = []
        for b in range(first, min(blocks, first + blocks_a_pass)):
            mine = known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
            held.append(Phrases([(r.i, r.t) for r in mine], window))
        part = _pass_spans(narrow, [p for p in held if len(p.matrix)], shard_units)
        out = part if out is None else out.unionByName(part)
    return out


def _pass_spans(narrow: DataFrame, phrases: list[Phrases], shard_units: int) -> DataFrame:
    held = narrow.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Of each block the documents and units that wait for the shard to be full, and how many are indexed.
        waiting = [[p, [], [], 0] for p in held.value]
        for pdf in batches:
            for d, t in zip(pdf.doc_id.astype("Int64"), pdf.text):
                u = units(t)
                for w in waiting:
                    look = w[0].numbers.get
                    mapped = long_runs(np.fromiter((look(x, 0) for x in u), np.int64, len(u)), w[0].window)
                    if not mapped.any():
                        continue
                    w[1].append(None if d is pd.NA else int(d))
                    w[2].append(mapped)
                    w[3] += int(np.count_nonzero(mapped))
                    if w[3] >= shard_units:
                        yield shard_spans(w[1], w[2], w[0])
                        w[1:] = [], [], 0
        for p, docs, texts, _ in waiting:
            if docs:
                yield shard_spans(docs, texts, p)

    if not phrases:
        return narrow.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, end long")
    return narrow.mapInPandas(run, "doc_id long, item_id long, start long, end long")


def leaks(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id), each pair once."""
    return leaked_spans(documents, items, **options).select("doc_id", "item_id").distinct()
