"""Personal information in free text: email addresses, phone numbers, identity numbers, street addresses and names.

A character-level bidirectional LSTM scores each character for each tag (outside, or beginning or inside of one of the
five kinds), a CRF with learnt transitions decodes the best sequence of tags. Both are plain numpy here; the weights
beside this file were trained by ``python -m engram.llm.pii_train`` from labelled spans. Inputs of a character are its
embedding (full-width forms count as their plain ones, Han characters outside the vocabulary share hashed ones) and
flags: its class and whether the word it stands in, or it itself, is in the table of name parts.

Texts longer than a window are cut into overlapping windows. Each is decoded by itself; then all findings of a text
are reconciled: where findings overlap, the one furthest from a cut of its own window wins, so that what one
window saw only in part gives way to what another saw whole. At last each finding's ends are set to those of the address,
number or name that its characters form (a title, a bracket, a full stop are taken off). That moves ends; whether there is
a finding is the tagger's decision alone.

Scale: one pass over the texts without a shuffle; memory is bounded by the batch of windows. Work is linear in characters.

Defined results: null and empty texts have no findings and stay as they are; texts of any length are read whole; repeated
rows give their findings once; null ids stay null; an empty table gives an empty result. Only the named columns are
read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: 0 is outside; 1 + 2k begins kind k, 2 + 2k continues it.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STEP = 208, 160
FLAGS = 9
HAN_BUCKETS = 32
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
#: The table of name parts is broadcast; a longer one is refused.
PARTS_MOST = 200_000
_WORD = re.compile(r"[^\W\d_]+")

#: Full-width forms and their plain ones, one to one.
PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D}


_WIDE = re.compile("[" + "".join(map(chr, PLAIN)) + "]")


def plain(text: str) -> str:
    """The text with full-width forms replaced; of the same length."""
    return text.translate(PLAIN) if _WIDE.search(text) else text


class Encoder:
    """Characters to numbers and flags."""

    def __init__(self, chars: str, parts: list[tuple[str, str]]) -> None:
        self.chars = chars
        self.number = {c: i + 2 + HAN_BUCKETS for i, c in enumerate(chars)}
        self.size = len(chars) + 2 + HAN_BUCKETS
        self.family = {t.lower() for t, r in parts if t and r == "family" and len(t) > 1}
        self.given = {t.lower() for t, r in parts if t and r == "given"}
        self.surnames = {t for t, r in parts if t and r == "family" and len(t) == 1}

    def char(self, c: str) -> int:
        n = self.number.get(c)
        if n is None:
            n = self.number[c] = 2 + ord(c) % HAN_BUCKETS if "㐀" <= c <= "鿿" else 1
        return n

    def code(self, c: str) -> int:
        """Number and flags of a character in one."""
        return self.char(c) << FLAGS | self.flag(c)

    @functools.cached_property
    def table(self) -> np.ndarray:
        """Codes of the first 65,536 characters, full-width forms as plain ones."""
        return np.array([self.code(chr(PLAIN.get(c, c))) for c in range(0x10000)], np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, flags as bits of one number)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = self.table[np.minimum(points, 0xFFFF)]
        for k in np.nonzero(points > 0xFFFF)[0]:
            codes[k] = self.code(text[k])
        low = plain(text)
        for m in _WORD.finditer(low):
            w = m.group().lower()
            if w in self.family:
                codes[m.start() : m.end()] |= 64
            if w in self.given:
                codes[m.start() : m.end()] |= 128
        return codes >> FLAGS, codes & ((1 << FLAGS) - 1)

    def flag(self, c: str) -> int:
        """Class bits of a character."""
        kind = 1 if c.isdigit() else 2 if c.isupper() else 4 if c.islower() else 8 if "㐀" <= c <= "鿿" else 16 if c.isspace() else 32
        return kind | (256 if c in self.surnames else 0)


class Tagger:
    """The trained model."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        w, h = self.w, self.w["fh"].shape[0]
        bits = ((np.arange(1 << FLAGS)[:, None] >> np.arange(FLAGS)) & 1).astype(np.float32)
        # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2: with halved weights of three gates one tanh does all four.
        scale = np.concatenate([np.full(3 * h, 0.5), np.ones(h)]).astype(np.float32)
        self.by_char = {d: w["emb"] @ w[d + "x"][: w["emb"].shape[1]] * scale for d in "fb"}
        self.by_flags = {d: (bits @ w[d + "x"][w["emb"].shape[1] :] + w[d + "0"]) * scale for d in "fb"}
        self.recur = {d: w[d + "h"] * scale for d in "fb"}
        self.hidden = h

    def emissions(self, ids: np.ndarray, flags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores, time x windows x tags, of windows x time."""
        n, t, h = len(ids), ids.shape[1], self.hidden
        # What characters and flags add is looked up once for each of their combinations.
        codes = ids.astype(np.int64) << FLAGS | flags
        seen = np.zeros(len(self.by_char["f"]) << FLAGS, bool)
        seen[codes] = True
        kinds = np.nonzero(seen)[0]
        place = np.empty(len(seen), np.int32)
        place[kinds] = np.arange(len(kinds))
        at = np.ascontiguousarray(place[codes].T)
        scores = np.broadcast_to(self.w["out0"], (t, n, TAGS)).copy()
        z, gates, new = np.empty((n, 4 * h), np.float32), np.empty((n, 3 * h), np.float32), np.empty((n, h), np.float32)
        for d in "fb":
            inputs = self.by_char[d][kinds >> FLAGS] + self.by_flags[d][kinds & ((1 << FLAGS) - 1)]
            state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            out = self.w["out"][:h] if d == "f" else self.w["out"][h:]
            for k in range(t) if d == "f" else range(t - 1, -1, -1):
                np.matmul(state, self.recur[d], out=z)
                z += inputs[at[k]]
                np.tanh(z, out=z)
                np.multiply(z[:, : 3 * h], 0.5, out=gates)
                gates += 0.5
                cell *= gates[:, h : 2 * h]
                np.multiply(gates[:, :h], z[:, 3 * h :], out=new)
                cell += new
                np.tanh(cell, out=state)
                state *= gates[:, 2 * h :]
                if d == "b":  # nothing is carried in from the padding
                    off = lengths <= k
                    if off.any():
                        state[off], cell[off] = 0, 0
                scores[k] += state @ out
        return scores

    def plain_windows(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Windows whose best sequence is surely outside everywhere.

        A run of m characters inside adds at most the sum of what each gains over outside, and m + 1 <= 2m transitions, of which
        each gains at most g; if every character's gain is below -2g, no run pays."""
        trans, start = self.w["trans"], self.w["start"]
        g = max(0.0, float(trans.max() - trans[0, 0]), float(start.max() - start[0]))
        gain = scores[:, :, 1:].max(2) - scores[:, :, 0]
        return ((gain < -2 * g - 1e-3) | (np.arange(len(scores))[:, None] >= lengths[None])).all(0)

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags of each window, by Viterbi."""
        t, n, _ = scores.shape
        trans = self.w["trans"]
        best = scores[0] + self.w["start"]
        back = np.zeros((t, n, TAGS), np.int8)
        for k in range(1, t):
            every = best[:, :, None] + trans[None]
            back[k] = every.argmax(1)
            new = np.take_along_axis(every, back[k][:, None, :].astype(np.int64), 1)[:, 0] + scores[k]
            live = (lengths > k)[:, None]
            best = np.where(live, new, best)
            back[k][lengths <= k] = np.arange(TAGS)
        tags = np.empty((n, t), np.int8)
        tags[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[k][np.arange(n), tags[:, k]]
        return tags

    def spans(self, encoder: Encoder, texts: list[str], batch: int = 512) -> list[list[tuple[int, int, int]]]:
        """(start, end, kind) of each text, reconciled over its windows, before their ends are set."""
        jobs, coded = [], []
        for i, text in enumerate(texts):
            coded.append(encoder.encode(text))
            n = len(text)
            starts = [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]
            jobs += [(min(WINDOW, n - s), i, s) for s in starts if n]
        jobs.sort()
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        held: list[tuple[np.ndarray, list[tuple[int, int, int]]]] = []
        open_count = 0
        for at in range(0, len(jobs), batch):
            part = jobs[at : at + batch]
            t = part[-1][0]
            ids, flags = np.zeros((len(part), t), np.int32), np.zeros((len(part), t), np.int32)
            lengths = np.array([j[0] for j in part])
            for r, (n, i, s) in enumerate(part):
                ids[r, :n], flags[r, :n] = coded[i][0][s : s + n], coded[i][1][s : s + n]
            scores = self.emissions(ids, flags, lengths)
            open_ = np.nonzero(~self.plain_windows(scores, lengths))[0]
            held.append((scores[:, open_], [part[r] for r in open_]))
            open_count += len(open_)
            # The few windows that may hold something are decoded together.
            if open_count < 4 * batch and at + batch < len(jobs):
                continue
            left = [job for _, mine in held for job in mine]
            if not left:
                continue
            t = max(x.shape[0] for x, _ in held)
            lengths = np.array([j[0] for j in left])
            scores = np.concatenate([np.pad(x, ((0, t - len(x)), (0, 0), (0, 0))) for x, _ in held], 1)
            held, open_count = [], 0
            tags = self.decode(scores, lengths)
            for r in np.nonzero((tags > 0).any(1))[0]:
                n, i, s = left[r]
                for a, b, kind in tag_spans(tags[r, :n]):
                    # Distance from the nearest cut; the text's own ends are no cuts.
                    margin = min(a if s else WINDOW, n - b if s + n < len(texts[i]) else WINDOW)
                    found[i].append((-margin, s + a, s + b, kind))
        return [reconcile(f) for f in found]


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of a sequence of tags; an inside without its beginning begins one."""
    out, start, kind = [], -1, -1
    for k, tag in enumerate([*tags.tolist(), 0]):
        here = (tag - 1) // 2 if tag else -1
        if start >= 0 and (here != kind or tag % 2):
            out.append((start, k, kind))
            start = -1
        if tag and start < 0:
            start, kind = k, here
    return out


def reconcile(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Findings (-margin, start, end, kind) of overlapping windows as spans that don't overlap."""
    kept: list[tuple[int, int, int]] = []
    for _, a, b, kind in sorted(set(found), key=lambda f: (f[0], f[1] - f[2], f[1])):
        if all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


_DOT = r"(?:\.|\s?[(\[]dot[)\]]\s?|\sdot\s)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\s?[(\[]at[)\]]\s?|\sat\s){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}")
NUMBER = re.compile(r"(?:\+\s?|\()?\d(?:[\d ()/.-]*\d)?")
TITLES = re.compile(r"^(?:Mrs?|Ms|Miss|Dr|Prof|Professor|Herrn?|Frau|Sir|Madam|Dear)\b\.?\s*")
AFTER = re.compile(r"(?:先生|女士)+$")
_INITIAL = re.compile(r"(?:^|[\s.,])[^\W\d_]\.$")
_UNIT_AFTER = re.compile(r"(?:,|\s(?:flat|apt|unit|floor|suite)\b).*$", re.IGNORECASE)


def trimmed(text: str, span: tuple[int, int, int]) -> tuple[int, int] | None:
    """The span with its ends set by the form of its kind. It only moves ends; what holds no character of its kind at all is nothing."""
    a, b, kind = span
    low, name = plain(text), KINDS[kind]

    def ends(first, last) -> tuple[int, int] | None:
        at = [k for k in range(a, b) if first(low[k])]
        to = [k for k in range(a, b) if last(low[k])]
        return (at[0], to[-1] + 1) if at and to and at[0] <= to[-1] else None

    if name == "email":
        lo, hi = max(0, a - 40), min(len(text), b + 40)
        hits = [(min(b, m.end()) - max(a, m.start()), m.start(), m.end()) for m in EMAIL.finditer(low, lo, hi)]
        hits = [h for h in hits if 2 * h[0] > b - a]
        return max(hits)[1:] if hits else ends(str.isalnum, str.isalnum)
    if name == "phone":
        # The number goes on as long as its digits do.
        while a > 0 and low[a - 1].isdigit() and low[a].isdigit():
            a -= 1
        while b < len(low) and low[b].isdigit() and low[b - 1].isdigit():
            b += 1
        hit = max(NUMBER.finditer(low, a, b), key=lambda m: len(m.group()), default=None)
        return hit.span() if hit else None
    if name == "id_number":
        while a > 0 and _plain_word(low[a - 1]) and _plain_word(low[a]):
            a -= 1
        while b < len(low) and _plain_word(low[b]) and _plain_word(low[b - 1]):
            b += 1
        hit = ends(lambda c: c.isascii() and c.isalnum(), lambda c: c.isascii() and c.isalnum())
        return hit if hit and any(c.isdigit() for c in low[slice(*hit)]) else None
    if name == "address":
        han = low.find("号", a, min(len(low), b + 1))
        if han >= 0 and any(c.isdigit() for c in low[a:han]):
            b = han + 1
        else:
            while b < len(low) and low[b].isdigit() and low[b - 1].isdigit():
                b += 1
            m = _UNIT_AFTER.search(low, a, b)
            if m and any(c.isdigit() for c in low[a : m.start()]):
                b = m.start()
        return ends(str.isalnum, lambda c: c.isalnum()) if any(c.isdigit() for c in low[a:b]) else None
    m = TITLES.match(low[a:b])
    if m:
        a += m.end()
    m = AFTER.search(low[a:b])
    if m:
        b = a + m.start()
    while a < b and not low[a].isalpha():
        a += 1
    while b > a and not (low[b - 1].isalpha() or low[b - 1] == "."):
        b -= 1
    if b > a and low[b - 1] == "." and not _INITIAL.search(low[a:b]):
        b -= 1
    return (a, b) if a < b else None


def _plain_word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def find(tagger: Tagger, encoder: Encoder, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of each text."""
    out = []
    for text, spans in zip(texts, tagger.spans(encoder, texts)):
        mine = []
        for s in spans:
            e = trimmed(text, s)
            if e and (not mine or e[0] >= mine[-1][1]):
                mine.append((*e, KINDS[s[2]]))
        out.append(mine)
    return out


def portions(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``most`` characters together (a longer text alone): the scores of their windows are held at once."""
    first = chars = 0
    for i, t in enumerate(texts):
        if i > first and chars + len(t) > most:
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def load(path: str | Path = WEIGHTS) -> tuple[Tagger, str]:
    with np.load(path) as f:
        weights = {k: f[k] for k in f.files}
    chars = "".join(map(chr, weights.pop("chars")))
    return Tagger(weights), chars


@functools.lru_cache(maxsize=2)
def _ready(parts: tuple[tuple[str, str], ...], path: str) -> tuple[Tagger, Encoder]:
    tagger, chars = load(path)
    return tagger, Encoder(chars, list(parts))


def name_parts(df: DataFrame, most: int = PARTS_MOST) -> tuple[tuple[str, str], ...]:
    """The table of name parts (token, role), of a checked size."""
    rows = df.select("token", F.lower("role")).where("token is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} name parts; broadcast is bounded")
    return tuple(sorted((r[0].strip(), r[1] or "") for r in rows))


def personal(df: DataFrame, rec_id: str, text: str, parts: DataFrame, weights: str | Path = WEIGHTS) -> DataFrame:
    """(rec_id, text, findings): findings is an array of (start, end, kind, mention), in order, not overlapping."""
    held = df.sparkSession.sparkContext.broadcast(name_parts(parts))
    path = str(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tagger, encoder = _ready(held.value, path)
            unique = {t: k for k, t in enumerate(dict.fromkeys(t for t in pdf.text if t))}
            texts, done = list(unique), []
            for lo, hi in portions(texts):
                done += find(tagger, encoder, texts[lo:hi])
            pdf["findings"] = [[{"start": a, "end": b, "kind": k, "mention": t[a:b]} for a, b, k in done[unique[t]]] if t else [] for t in pdf.text]
            yield pdf

    narrow = df.select(F.col(rec_id).cast("string").alias("rec_id"), F.col(text).alias("text"))
    return narrow.mapInPandas(run, "rec_id string, text string, findings array<struct<start:int,end:int,kind:string,mention:string>>")


def mentions(found: DataFrame) -> DataFrame:
    """(rec_id, kind, mention), each once."""
    return found.select("rec_id", F.explode("findings").alias("f")).select("rec_id", "f.kind", "f.mention").distinct()


def redact(found: DataFrame) -> DataFrame:
    """(rec_id, text, redacted): each finding replaced with its kind in brackets, the rest as it was."""
    # From the last to the first, so that places stay right; places count code points, as Spark's functions do.
    put = lambda acc, f: F.concat(F.substring(acc, F.lit(1), f["start"]), F.lit("["), F.upper(f["kind"]), F.lit("]"), F.substring(acc, f["end"] + 1, F.length(acc)))
    return found.select("rec_id", "text", F.aggregate(F.reverse("findings"), F.col("text"), put).alias("redacted"))
