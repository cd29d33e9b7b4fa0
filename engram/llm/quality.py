"""Text quality statistics and the structural kind of each document.

All counts are made with numpy over a batch of whole texts at once: every character is looked up in a table of classes, and
lines, words and their types fall out of where the class changes. Lines of a document that have the same shape (length,
ending, dividers, share of letters) form a segment. Of each segment these distributions are held: character
classes, word types (with function words of English, German and Chinese), word lengths, shape, repetition of lines, and lines with garbled
characters.

A segment gets the kind of the structural profile nearest to it by Jensen-Shannon divergence (weighted sum over the
distributions). The document's kind is the one that most of its characters belong to; a text without any visible character
is junk. Profiles are fitted on the segments of hand-labelled documents, of which at most ``labels_most`` are taken, by
hash of their id: labels that other documents speak against are left out (wrong labels; prose that introduces a
table), the others of each kind, for prose of each language, are clustered to a few profiles, each shared by several documents.

Scale: one pass over the texts, no shuffle; the fit sees only the labelled documents and brings back only their segments'
counts (at most ``labels_most`` x 48 rows).

Defined results: null texts count as empty: all statistics 0, kind junk; any line ends divide lines, blank lines don't
count; without usable labels for at least two kinds every visible text is prose; repeated rows are repeated; an empty table
gives an empty result; lang and n_chars aren't read, as they may be wrong.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")

#: Function words of English and German, and function characters of Chinese.
ENGLISH = "the a an and or of to in on for with by at from as is was are were be been that this these those it its not no but if so than then after before until while because although though unless we they he she you i our their my your his her which who what when where how there here has have had do does did will would can could should may might must over under about into within without since despite together during behind near next still again nobody one both each".split()
GERMAN = "der die das den dem des ein eine einen einem einer eines und oder aber nicht mit von vom zu zum zur im in am an auf aus bei bis für ist war sind waren wird wurde werden hat hatte haben dass daß weil denn obwohl sodass wenn als wie nach vor über unter seit um durch ohne gegen trotz während hinter sich es er sie wir ihr noch nur auch schon sehr danach später".split()
CHINESE = "的了是在不和也就都而及与着或这那有被把为以从到对将但还又再很最没我你他她它们个之其所于由给让比等吗呢吧啊说要会能可"

LOWER, UPPER, LETTER, HAN_FUNCTION, HAN, DIGIT, SPACE, FINAL, COMMA, DIVIDER, BRACKET, BULLET, SYMBOL, GARBLED, BREAK = range(15)
CLASSES = 14
WORD_TYPES, LENGTHS, SHAPES = 7, 5, 48
#: The word type of German function words; English ones have 0.
GERMAN_WORD = 6
#: Where each distribution lies in a segment's row of counts, and what its divergence weighs.
PARTS = ((0, CLASSES, 2.0), (CLASSES, WORD_TYPES, 1.5), (CLASSES + WORD_TYPES, LENGTHS, 1.0), (CLASSES + WORD_TYPES + LENGTHS, SHAPES, 1.0), (CLASSES + WORD_TYPES + LENGTHS + SHAPES, 2, 4.0), (CLASSES + WORD_TYPES + LENGTHS + SHAPES + 2, 2, 4.0))
WIDTH = PARTS[-1][0] + PARTS[-1][1]


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, GARBLED, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] == "L":
            out[c] = LETTER
        elif k[0] == "N":
            out[c] = DIGIT
        elif k[0] in "PS":
            out[c] = SYMBOL
        elif k == "Zs":
            out[c] = SPACE
        elif k[0] == "M":
            out[c] = LETTER
    for lo, hi in ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        out[lo : hi + 1] = HAN
    out[ord("a") : ord("z") + 1] = LOWER
    out[ord("A") : ord("Z") + 1] = UPPER
    out[0xA1:0xC0] = GARBLED  # what UTF-8 read as Latin-1 is full of
    for chars, k in ((CHINESE, HAN_FUNCTION), (".!?。！？…", FINAL), (",;:，；：、", COMMA), ("\t|│┃¦", DIVIDER), ("()[]{}\"'“”‘’「」《》（）【】<>", BRACKET), ("-*+•·#=_~/\\–—>", BULLET), ("\n\r\x0b\x0c  ", BREAK), ("�□▯ÃÂÐÑÿþ", GARBLED)):
        out[[ord(c) for c in chars]] = k
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cf":
            out[c] = LOWER  # soft hyphens and the like are seen as part of the word they stand in
    return out


def _key(word: str) -> int:
    return sum(ord(c) << (8 * i) for i, c in enumerate(word))


FUNCTION_KEYS = np.array(sorted({_key(w) for w in ENGLISH + GERMAN if len(w) <= 8}), np.uint64)
ONLY_GERMAN = np.isin(FUNCTION_KEYS, np.array([_key(w) for w in set(GERMAN) - set(ENGLISH) if len(w) <= 8], np.uint64))


def measure(texts: list[str]) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Statistics of each text; (doc, chars) of each segment; the segments' counts."""
    table, count = class_table(), len(texts)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    cls = table[codes].copy()
    blank = cls == SPACE
    cls[1:][blank[1:] & blank[:-1]] = DIVIDER  # runs of spaces divide columns
    breaks = cls == BREAK
    line_of = np.cumsum(breaks) - breaks
    starts = np.concatenate([[0], np.nonzero(breaks)[0][:-1] + 1])
    lines = len(starts)
    doc_of = np.searchsorted(np.cumsum(lengths), starts, side="right")
    m = np.bincount(line_of * 15 + cls, minlength=lines * 15).reshape(lines, 15)[:, :CLASSES]
    visible = m.sum(1) - m[:, SPACE] - m[:, DIVIDER]
    # Leading spaces are an indent, not dividers, and trailing ones are nothing: ends are those of visible characters.
    place = np.arange(len(codes), dtype=np.int64)
    seen = ~(breaks | blank | (codes == 9))
    last = np.maximum.reduceat(np.where(seen, place, -1), starts)
    first = np.minimum.reduceat(np.where(seen, place, len(codes)), starts)
    some = visible > 0
    end = np.where(some, cls[np.maximum(last, 0)], SPACE)
    dots = np.where(some & (end == BRACKET), cls[np.maximum(last - 1, 0)], end)
    ended = dots == FINAL
    indent = np.where(some, first - starts, 0)
    dividers = np.maximum(0, m[:, DIVIDER] - np.maximum(0, indent - 1))

    # Words: runs of letters and digits other than Han.
    word = (cls <= LETTER) | (cls == DIGIT)
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    ws, we = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    wl = we - ws
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    digits, uppers = (upto(x) for x in (cls == DIGIT, cls == UPPER))
    nd, nu = digits[we] - digits[ws], uppers[we] - uppers[ws]
    low = np.where(cls == UPPER, codes + 32, codes)
    key = np.zeros(len(ws), np.uint64)
    fits = np.nonzero(wl <= 8)[0]
    for j in range(8):
        mine = fits[wl[fits] > j]
        c = low[ws[mine] + j].astype(np.uint64)
        key[mine] |= np.where(c < 256, c, 255) << np.uint64(8 * j)
    at = np.minimum(np.searchsorted(FUNCTION_KEYS, key), len(FUNCTION_KEYS) - 1)
    common = (FUNCTION_KEYS[at] == key) & (wl <= 8)
    kind = np.select([common & ONLY_GERMAN[at], common, nd == wl, nd > 0, wl > 20, nu > 0], [GERMAN_WORD, 0, 3, 4, 5, 2], 1)
    size = np.digitize(wl, (2, 4, 7, 11))
    wline = line_of[ws]
    wt = np.bincount(wline * WORD_TYPES + kind, minlength=lines * WORD_TYPES).reshape(lines, WORD_TYPES)
    wz = np.bincount(wline * LENGTHS + size, minlength=lines * LENGTHS).reshape(lines, LENGTHS)

    # Shape of a line.
    han = m[:, HAN] + m[:, HAN_FUNCTION]
    room = visible + han
    letters = m[:, LOWER] + m[:, UPPER] + m[:, LETTER] + han
    length = np.digitize(room, (30, 70))
    many = np.digitize(dividers + m[:, COMMA], (1, 3)) + (dividers >= 2) * 1
    shape = ((length * 2 + ended) * 4 + np.minimum(many, 3)) * 2 + (letters * 2 >= visible)

    # Repetition: a line's hash against those of its document.
    offset = place - starts[line_of]
    mix = (codes.astype(np.uint64) + np.uint64(0x9E37)) * (offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
    mix ^= mix >> np.uint64(29)
    mix[breaks] = 0
    print_ = np.add.reduceat(mix, starts)
    use = np.nonzero(some)[0]
    d = doc_of[use]
    order = np.lexsort((print_[use], d))
    fresh = np.ones(len(use), bool)
    fresh[1:] = (np.diff(d[order]) != 0) | (np.diff(print_[use][order]) != 0)
    again = np.empty(len(use), bool)
    again[order] = ~fresh

    spoilt = m[use][:, GARBLED] > 0
    rows = np.concatenate([m[use], wt[use], wz[use], np.zeros((len(use), SHAPES), np.int64), again[:, None], ~again[:, None], spoilt[:, None], ~spoilt[:, None]], 1)
    rows[np.arange(len(use)), PARTS[3][0] + shape[use]] = visible[use]
    rows[:, -4:] *= visible[use][:, None]
    seg = d * SHAPES + shape[use]
    order = np.argsort(seg, kind="stable")
    cut = np.nonzero(np.diff(np.concatenate([[-1], seg[order]])))[0]
    counts = np.add.reduceat(rows[order], cut, axis=0) if len(use) else np.zeros((0, WIDTH), np.int64)
    segments = pd.DataFrame({"doc": d[order][cut], "chars": np.add.reduceat(room[use][order], cut) if len(use) else []})

    total = lambda x, by: np.bincount(by, weights=x, minlength=count)
    words = total(wt.sum(1) + han, doc_of)
    inside = total(letters + m[:, DIGIT], doc_of)
    marks = total(visible, doc_of)
    shown = total(some.astype(float), doc_of)
    safe = lambda a, b: np.divide(a, b, out=np.zeros(count), where=b > 0)
    stats = pd.DataFrame(
        {
            "words": words.astype(np.int64),
            "mean_word_length": safe(inside, words),
            "symbol_ratio": safe(marks - inside, marks),
            "punctuated_lines": safe(total(ended.astype(float), doc_of), shown),
            "common_words": safe(total(wt[:, 0] + wt[:, GERMAN_WORD] + m[:, HAN_FUNCTION], doc_of), words),
        }
    )
    return stats, segments, counts


def batches_of(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``most`` characters together (a longer text alone)."""
    first = chars = 0
    for i, t in enumerate(texts):
        if i > first and chars + len(t) > most:
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def distributions(counts: np.ndarray) -> np.ndarray:
    """Counts as distributions, side by side; a part without counts is spread evenly."""
    out = np.empty(counts.shape, np.float64)
    for lo, n, _ in PARTS:
        part = counts[:, lo : lo + n].astype(np.float64) + 0.02
        out[:, lo : lo + n] = part / part.sum(1, keepdims=True)
    return out


def entropy(x: np.ndarray) -> np.ndarray:
    """Weighted entropy of each row, in bits."""
    return -(x * np.log2(x)) @ WEIGHTS


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Weighted Jensen-Shannon divergences, in bits, of all rows of p from all rows of q."""
    own, other = entropy(p), entropy(q)
    return np.stack([entropy((p + q[k]) / 2) - (own + other[k]) / 2 for k in range(len(q))], 1)


WEIGHTS = np.concatenate([np.full(n, w) for _, n, w in PARTS])


def clusters(x: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
    """The cluster of each row, by k-means from distant beginnings."""
    centres = x[int(rng.integers(len(x)))][None]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(many, len(x)) and d.sum() > 1e-12:
        centres = np.concatenate([centres, x[int(rng.choice(len(x), p=d / d.sum()))][None]])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    for _ in range(20):
        to = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        centres = np.array([x[to == c].mean(0) if (to == c).any() else centres[c] for c in range(len(centres))])
    return to


def language(counts: np.ndarray) -> np.ndarray:
    """The language a segment's function words belong to: 0 English, 1 German, 2 Chinese; for segments without any, by script."""
    words = counts[:, CLASSES : CLASSES + WORD_TYPES]
    han = counts[:, HAN] + counts[:, HAN_FUNCTION]
    latin = counts[:, LOWER] + counts[:, UPPER] + counts[:, LETTER]
    return np.where(han * 2 > latin, 2, np.where(words[:, GERMAN_WORD] > words[:, 0], 1, 0))


class Profiles:
    """Structural profiles, fitted on labelled segments.

    Labels are checked first, each against those of other documents: the nearest segments vote (the nearer, the more, so
    that a few of the same rare shape outweigh many distant ones). A document whose segments speak against its label is left
    out whole, a segment that speaks against it (prose that introduces a table) by itself; the second round asks
    only what passed the first. What is left of each kind, for prose of each language, is clustered several times from
    different beginnings, to a number of clusters that follows the number of documents. A cluster that fewer than
    ``support`` documents share is no profile.
    """

    def __init__(self, counts: np.ndarray, kinds: np.ndarray, docs: np.ndarray, seed: int = 1, support: int = 2, restarts: int = 2, rounds: int = 2) -> None:
        rng = np.random.default_rng(seed)
        p = distributions(counts)
        root = np.sqrt(p * WEIGHTS)
        keep = self._agreeing(root, kinds, docs, counts[:, :CLASSES].sum(1), rounds)
        groups = np.where(kinds == 0, language(counts), 2 + kinds) if len(counts) else kinds
        rows, of = [], []
        for g in np.unique(groups[keep]):
            mine = np.nonzero(keep & (groups == g))[0]
            many = int(np.clip(len(np.unique(docs[mine])) // 6, 16, 40))
            for _ in range(restarts):
                to = clusters(root[mine], many, rng)
                for c in np.unique(to):
                    rows_of = mine[to == c]
                    if len(np.unique(docs[rows_of])) >= support:
                        rows.append(p[rows_of].mean(0))
                        of.append(max(0, g - 2))
        self.rows, self.kinds = np.array(rows).reshape(-1, WIDTH), np.array(of, int)
        self.usable = len(set(of)) >= 2

    @staticmethod
    def _agreeing(root: np.ndarray, kinds: np.ndarray, docs: np.ndarray, chars: np.ndarray, rounds: int) -> np.ndarray:
        """Which segments other documents' segments agree with."""
        keep, every = np.ones(len(root), bool), np.arange(len(root))
        names, doc = np.unique(docs, return_inverse=True)
        label = np.zeros(len(names), int)
        label[doc] = kinds
        for _ in range(rounds):
            base = np.nonzero(keep)[0]
            near_most = min(int(np.clip(len(names) // 100, 9, 15)), len(base) - 1)
            if near_most < 3:
                break
            votes = np.zeros((len(root), len(KINDS)))
            for s in range(0, len(root), 1024):
                part = root[s : s + 1024]
                d = (part**2).sum(1)[:, None] - 2 * part @ root[base].T + (root[base] ** 2).sum(1)
                d[docs[s : s + 1024, None] == docs[base][None]] = np.inf
                best = np.argpartition(d, near_most, axis=1)[:, :near_most]
                weight = 1 / (np.maximum(np.take_along_axis(d, best, 1), 0) + 0.02) ** 2
                votes[s : s + 1024] = np.stack([((kinds[base][best] == k) * weight).sum(1) for k in range(len(KINDS))], 1)
            # The label itself votes like a near segment at a squared distance of a half: where nothing is near, it stays.
            votes[every, kinds] += near_most / 0.52**2
            votes /= votes.sum(1, keepdims=True)
            whole = np.zeros((len(names), len(KINDS)))
            np.add.at(whole, doc, votes * chars[:, None])
            good = whole[np.arange(len(names)), label] >= whole.max(1)
            keep = good[doc] & (votes[every, kinds] >= votes.max(1))
        return keep

    def nearest(self, counts: np.ndarray) -> np.ndarray:
        """The kind of the nearest profile of each segment.

        With h the squared differences of roots, h / 4 <= divergence in nats <= h log 2 for each distribution and so for
        weighted sums: profiles whose h is more than 4 log 2 times the least can't be nearest, and aren't compared."""
        if not self.usable:
            return np.zeros(len(counts), int)
        out, roots = np.empty(len(counts), int), np.sqrt(self.rows * WEIGHTS)
        own = entropy(self.rows)
        for s in range(0, len(counts), 2048):
            p = distributions(counts[s : s + 2048])
            root = np.sqrt(p * WEIGHTS)
            h = (root**2).sum(1)[:, None] - 2 * root @ roots.T + (roots**2).sum(1)
            i, k = np.nonzero(h <= 4 * np.log(2) * h.min(1, keepdims=True) + 1e-9)
            d = entropy((p[i] + self.rows[k]) / 2) - (entropy(p)[i] + own[k]) / 2
            order = np.lexsort((k, d, i))
            first = order[np.searchsorted(i, np.arange(len(p)))]  # i is in order, and stays so
            out[s : s + 2048] = self.kinds[k[first]]
        return out


def assess(texts: list[str], profiles: Profiles) -> pd.DataFrame:
    """Statistics and kind of each text."""
    out = []
    for lo, hi in batches_of(texts):
        stats, segments, counts = measure(texts[lo:hi])
        votes = np.zeros((hi - lo, len(KINDS)))
        np.add.at(votes, (segments["doc"].values.astype(int), profiles.nearest(counts)), segments["chars"].values)
        stats["kind"] = np.where(votes.sum(1) > 0, np.array(KINDS, object)[votes.argmax(1)], "junk")
        out.append(stats)
    return pd.concat(out) if out else pd.DataFrame()


def fit_profiles(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, label: str, labels_most: int = 2000) -> Profiles:
    known = labels.select(F.col(label_id).alias("i"), F.lower(F.trim(label)).alias("kind")).where(F.col("i").isNotNull() & F.col("kind").isin(*KINDS))
    # One label a document, a bounded number of documents: the result is at most labels_most rows.
    known = known.groupBy("i").agg(F.mode("kind", True).alias("kind")).orderBy(F.xxhash64("i"), "i").limit(labels_most)
    chosen = documents.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(known), "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.text.tolist()
            for lo, hi in batches_of(texts):
                _, segments, counts = measure(texts[lo:hi])
                at = segments["doc"].values.astype(int) + lo
                yield pd.DataFrame({"i": pdf.i.values[at], "kind": pdf["kind"].values[at], "counts": list(counts.astype(np.float64))})

    rows = chosen.select("i", "text", "kind").mapInPandas(run, "i long, kind string, counts array<double>").toPandas()
    rows = rows.sort_values(["i", "counts"], key=lambda s: s.map(tuple) if s.name == "counts" else s)
    counts = np.stack(rows.counts.values) if len(rows) else np.zeros((0, WIDTH))
    return Profiles(counts, rows.kind.map({k: n for n, k in enumerate(KINDS)}).values.astype(int), rows.i.values)


def text_quality(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "kind", labels_most: int = 2000) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_ratio, punctuated_lines, common_words, kind) of every document."""
    held = documents.sparkSession.sparkContext.broadcast(fit_profiles(documents, labels, doc_id, text, label_id, label, labels_most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = assess([t if t is not None else "" for t in pdf.text], held.value)
                out.insert(0, "doc_id", pdf.doc_id.values)
                yield out

    schema = "doc_id long, words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, kind string"
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)
