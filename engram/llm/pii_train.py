"""Training of the tagger in ``pii``: python -m engram.llm.pii_train FOLDER [SECONDS] [WORKERS] [continue].

Labelled texts come from ``pii_texts``, which writes phrases, values and decoys of its own into a background without
personal information: sentences of the folder's documents. The messages and memory that the tagger is run on are not read (the weights
that are here saw some 160 of them in an earlier version of this file; see the README). Flags of
the table of name parts are dropped in part, and a third of the table is unknown to each worker's second encoder, since that
table is incomplete. With ``continue`` training goes on from the weights that are there.

Loss is the negative log-likelihood of the CRF; gradients are by hand through CRF, output layer and both LSTMs; Adam. Each
step averages the gradients of some worker processes, each with a batch of its own.
"""

from __future__ import annotations

import multiprocessing
import re
import sys
import time

import numpy as np
import pandas as pd

from engram.llm import pii
from engram.llm.pii import FLAGS, KINDS, TAGS, Encoder, Tagger, plain
from engram.llm.pii_texts import Texts


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n, np.int8)
    for a, b, kind in spans:
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def start_weights(size: int, rng: np.random.Generator, emb: int = 24, hidden: int = 48) -> dict[str, np.ndarray]:
    d = emb + FLAGS
    w = {"emb": rng.normal(0, 0.1, (size, emb)), "out": rng.normal(0, 0.1, (2 * hidden, TAGS)), "out0": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
    for k in "fb":
        w[k + "x"] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * hidden))
        w[k + "h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w[k + "0"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # open forget gates
    return {k: v.astype(np.float32) for k, v in w.items()}


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def step(w: dict[str, np.ndarray], ids: np.ndarray, flags: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss per window and gradients; ids, flags, tags are time x windows."""
    t, n = ids.shape
    h, e = w["fh"].shape[0], w["emb"].shape[1]
    bits = ((np.arange(1 << FLAGS)[:, None] >> np.arange(FLAGS)) & 1).astype(np.float32)
    x = np.concatenate([w["emb"][ids], bits[flags]], 2)
    live = np.arange(t)[:, None] < lengths[None]
    memory, states = {}, {}
    for d in "fb":
        zx = (x.reshape(t * n, -1) @ w[d + "x"] + w[d + "0"]).reshape(t, n, 4 * h)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        gates, cells, tanhs, hs = np.empty((t, n, 4 * h), np.float32), np.empty((t + 1, n, h), np.float32), np.empty((t, n, h), np.float32), np.empty((t + 1, n, h), np.float32)
        order = list(range(t) if d == "f" else range(t - 1, -1, -1))
        cells[0], hs[0] = cell, state
        for j, k in enumerate(order):
            z = zx[k] + state @ w[d + "h"]
            g = np.empty_like(z)
            g[:, : 3 * h] = 0.5 * np.tanh(0.5 * z[:, : 3 * h]) + 0.5
            g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cell = g[:, h : 2 * h] * cell + g[:, :h] * g[:, 3 * h :]
            th = np.tanh(cell)
            state = g[:, 2 * h : 3 * h] * th
            keep = live[k][:, None]
            cell, state = cell * keep, state * keep
            gates[j], tanhs[j], cells[j + 1], hs[j + 1] = g, th, cell, state
        memory[d] = (order, gates, cells, tanhs, hs)
        states[d] = hs[1:] if d == "f" else hs[1:][::-1]
    both = np.concatenate([states["f"], states["b"]], 2)
    scores = both @ w["out"] + w["out0"]

    # CRF: forward and backward in log space.
    trans = w["trans"]
    alpha = np.empty((t, n, TAGS), np.float32)
    alpha[0] = scores[0] + w["start"]
    for k in range(1, t):
        new = _log_sum(alpha[k - 1][:, :, None] + trans[None], 1) + scores[k]
        alpha[k] = np.where(live[k][:, None], new, alpha[k - 1])
    log_z = _log_sum(alpha[-1], 1)
    beta = np.zeros((t, n, TAGS), np.float32)
    g_trans = np.zeros_like(trans)
    for k in range(t - 2, -1, -1):
        m = scores[k + 1] + beta[k + 1]
        pair = trans[None] + m[:, None, :]
        beta[k] = np.where(live[k + 1][:, None], _log_sum(pair, 2), beta[k + 1])
        p = np.exp(alpha[k][:, :, None] + pair - log_z[:, None, None]) * live[k + 1][:, None, None]
        g_trans += p.sum(0)
    g_scores = np.exp(alpha + beta - log_z[None, :, None]) * live[:, :, None]
    rows = np.arange(n)
    gold = scores[0, rows, tags[0]] + w["start"][tags[0]]
    for k in range(1, t):
        gold = gold + np.where(live[k], scores[k, rows, tags[k]] + trans[tags[k - 1], tags[k]], 0)
        np.add.at(g_trans, (tags[k - 1][live[k]], tags[k][live[k]]), -1)
    kk, rr = np.nonzero(live)
    g_scores[kk, rr, tags[kk, rr]] -= 1
    grads = {"trans": g_trans, "start": g_scores[0].sum(0), "out": both.reshape(t * n, -1).T @ g_scores.reshape(t * n, -1), "out0": g_scores.sum((0, 1))}
    g_both = g_scores @ w["out"].T
    g_x = np.zeros_like(x)
    for d in "fb":
        order, gates, cells, tanhs, hs = memory[d]
        part = g_both[:, :, :h] if d == "f" else g_both[:, :, h:]
        gz = np.zeros((t, n, 4 * h), np.float32)
        g_state, g_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for j in range(t - 1, -1, -1):
            k = order[j]
            keep = live[k][:, None]
            gs, gc = (part[k] + g_state) * keep, g_cell * keep
            g = gates[j]
            i, f, o, c = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            gc = gc + gs * o * (1 - tanhs[j] ** 2)
            z = gz[k]
            z[:, :h] = gc * c * i * (1 - i)
            z[:, h : 2 * h] = gc * cells[j] * f * (1 - f)
            z[:, 2 * h : 3 * h] = gs * tanhs[j] * o * (1 - o)
            z[:, 3 * h :] = gc * i * (1 - c**2)
            g_cell = gc * f
            g_state = z @ w[d + "h"].T
        before = hs[:-1] if d == "f" else hs[:-1][::-1]
        flat = gz.reshape(t * n, -1)
        grads[d + "h"] = before.reshape(t * n, -1).T @ flat
        grads[d + "x"] = x.reshape(t * n, -1).T @ flat
        grads[d + "0"] = flat.sum(0)
        g_x += (flat @ w[d + "x"].T).reshape(x.shape)
    g_emb = np.zeros_like(w["emb"])
    np.add.at(g_emb, ids.reshape(-1), g_x.reshape(t * n, -1)[:, :e])
    grads["emb"] = g_emb
    return float((log_z - gold).sum() / n), {k: v / n for k, v in grads.items()}


def background_of(folder: str, most: int = 60000) -> list[str]:
    """Sentences and lines of the folder's documents, of 8 to 200 characters."""
    texts = pd.read_parquet(f"{folder}/documents.parquet", columns=["text"]).text.dropna()
    pieces = sorted({p for t in texts for p in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|[\r\n]+", t[:4000]) if 8 <= len(p) <= 200 and "@" not in p})
    return [pieces[i] for i in np.random.default_rng(2).permutation(len(pieces))[:most]]


def batch_of(encoder: Encoder, make, rng: np.random.Generator, size: int) -> tuple[np.ndarray, ...]:
    """(numbers, flags, tags), time x windows, and lengths, of windows of ``size`` texts."""
    jobs = []
    for _ in range(size):
        text, spans = make()
        length = int(rng.integers(60, 161))
        lo = int(rng.integers(0, max(1, len(text) - length + 1)))
        if spans and len(text) > length and rng.random() < 0.7:  # around a span
            s = spans[int(rng.integers(len(spans)))]
            lo = int(np.clip(s[0] - rng.integers(0, length), 0, len(text) - length))
        ids, flags = encoder.encode(text[lo : lo + length])
        if rng.random() < 0.25:
            flags = flags & ~(64 | 128 | 256)
        jobs.append((np.where(rng.random(len(ids)) < 0.01, 1, ids), flags, tags_of(len(text), spans)[lo : lo + length]))
    lengths = np.array([len(j[0]) for j in jobs])
    out = [np.zeros((int(lengths.max()), size), np.int64) for _ in range(3)]
    for r, job in enumerate(jobs):
        for whole, mine in zip(out, job):
            whole[: len(mine), r] = mine
    return *out, lengths


def worker(pipe, seed: int, parts, background: list[str], chars: str, size: int) -> None:
    rng, texts, encoder = np.random.default_rng(seed), Texts(parts, background, seed), Encoder(chars, parts)
    known = [p for p in parts if rng.random() < 0.67]
    encoders = (encoder, Encoder(chars, known))
    while (weights := pipe.recv()) is not None:
        pipe.send(step(weights, *batch_of(encoders[int(rng.integers(2))], texts.text, rng, size)))


def train(parts, background: list[str], seconds: float, workers: int = 8, size: int = 48, seed: int = 11, start: tuple | None = None, report=print) -> tuple[dict[str, np.ndarray], str]:
    """(weights, characters); ``start`` is what training goes on from."""
    if start:
        w, chars = start
    else:
        some = Texts(parts, background, seed)
        counts = pd.Series(list("".join(plain(some.text()[0]) for _ in range(20000)) + "".join(map(plain, background)))).value_counts()
        chars = "".join(sorted(c for c, k in counts.items() if k >= 20))
        w = start_weights(Encoder(chars, parts).size, np.random.default_rng(seed))
    report(f"{len(background)} background sentences, {len(chars)} characters")
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    pipes = []
    for k in range(workers):
        here, there = multiprocessing.Pipe()
        multiprocessing.Process(target=worker, args=(there, 100 + k, parts, background, chars, size), daemon=True).start()
        pipes.append(here)
    began, n, loss_sum = time.time(), 0, 0.0
    while (done := (time.time() - began) / seconds) < 1:
        for p in pipes:
            p.send(w)
        answers = [p.recv() for p in pipes]
        grads = {k: sum(a[1][k] for a in answers) / workers for k in w}
        loss_sum += sum(a[0] for a in answers) / workers
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        n += 1
        rate = 4e-3 * min(1, n / 50) * (1 - done) + 1e-4
        for k, g in grads.items():
            g = g * min(1, 5 / norm)
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            w[k] -= (rate * (mean[k] / (1 - 0.9**n)) / (np.sqrt(square[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
        if n % 50 == 0:
            report(f"{n} steps, {time.time() - began:.0f} s, loss a window {loss_sum / 50:.3f}")
            loss_sum = 0.0
    for p in pipes:
        p.send(None)
    return w, chars


def parts_of(folder: str) -> list[tuple[str, str]]:
    p = pd.read_parquet(f"{folder}/name_parts.parquet").dropna(subset=["token"])
    return sorted(set(zip(p.token.str.strip(), p.role.str.lower())))


def held_out(tagger: Tagger, encoder: Encoder, labelled: list[tuple[str, list[tuple[int, int, int]]]]) -> dict[str, tuple[int, int, int]]:
    """Of each kind: labelled, found, both."""
    out, found = {}, pii.find(tagger, encoder, [t for t, _ in labelled])
    for k, name in enumerate(KINDS):
        a = {(i, x, y) for i, (_, s) in enumerate(labelled) for x, y, c in s if c == k}
        b = {(i, x, y) for i, f in enumerate(found) for x, y, c in f if c == name}
        out[name] = (len(a), len(b), len(a & b))
    return out


def main() -> None:
    folder, seconds = sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 600
    workers = int(sys.argv[3]) if len(sys.argv) > 3 else 8
    parts, background = parts_of(folder), background_of(folder)
    cut = len(background) * 9 // 10
    start = None
    if "continue" in sys.argv:
        tagger, chars = pii.load()
        start = tagger.w, chars
    w, chars = train(parts, background[:cut], seconds, workers, start=start, report=lambda *x: print(*x, flush=True))
    w = {k: v.astype(np.float16 if k == "emb" else np.float32) for k, v in w.items()}
    np.savez_compressed(pii.WEIGHTS, chars=np.array([ord(c) for c in chars], np.int32), **w)
    tagger, chars = pii.load()
    test = Texts(parts, background[cut:], 999)
    for name, (a, b, both) in held_out(tagger, Encoder(chars, parts), [test.text() for _ in range(2000)]).items():
        print(f"{name}: {a} labelled, {b} found, {both} of them the same")


if __name__ == "__main__":
    main()
