"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its word vector (the vocabulary is that of the training sample: its words in at
least ``MIN_DOCS`` documents; other words share one) next
to the mean of its character-trigram vectors. Windows of ``WINDOW`` words, each overlapping the
next by half, run through a forward and a backward GRU; attention pools the states of a window
into one logit and a document's score is that of its highest window, so no part of a text is
left out. Training is multiple-instance: of each document only the highest window learns.

Input projections are computed once per distinct word of a slice and gathered per position, so
the recurrent steps are small matrix products over all windows of a slice at a time.

Defined cases: null and empty texts are one window of padding; texts of any length are scored
whole in bounded memory; repeated rows get equal scores; further columns are ignored; an empty
table gives an empty result; without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.common import mix, slices, span_hashes, spans, table
from skyloom.llm.labelled import held_out, training_sample

#: Bounds of the labelled rows that the model is fitted on: rows a class, and bytes of a text (a
#: longer one isn't learned from, so the driver holds 3,600 texts of that size at most).
SAMPLE = {0: 2400, 1: 1200}
TRAIN_BYTES = 1 << 16
THRESHOLD = 0.5
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
MIN_DOCS, CHAR_BUCKETS = 4, 8192
#: Bytes scored at a time.
SLICE = 1 << 18

_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a slice: per position the index of its distinct word, per row its count;
    per distinct word its hash and character trigrams (buckets and where each word's begin)."""

    index: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    trigrams: np.ndarray
    begin: np.ndarray


def read_words(data: np.ndarray, at: np.ndarray) -> Words:
    lower = _LOWER[data]
    start, end, counts = spans(_WORD[data], at)
    hashes, first, index = np.unique(span_hashes(lower, start, end), return_index=True, return_inverse=True)
    size = (end - start)[first]
    begin = np.concatenate([[0], np.cumsum(size + 1)])  # a word of n bytes has n + 1 trigrams with its two edges
    word = np.repeat(np.arange(len(size)), size + 1)
    offset = np.arange(begin[-1]) - begin[word] - 1
    place = start[first][word] + offset
    letter = lambda k: np.where((offset + k >= 0) & (offset + k < size[word]), lower[np.clip(place + k, 0, max(0, len(lower) - 1))] if len(lower) else 0, 1).astype(np.uint32)
    code = letter(0) * np.uint32(65599) + letter(1) * np.uint32(257) + letter(2) * np.uint32(40503)
    return Words(index, counts, hashes, ((code ^ code >> np.uint32(13)) % np.uint32(CHAR_BUCKETS)).astype(np.int32), begin)


def windows(counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (or ``pad``) of every window, and its row. Each row has one window at least; all
    its words are covered."""
    n = np.maximum(1, -(-np.maximum(counts - WINDOW, 0) // STRIDE) + 1)
    row = np.repeat(np.arange(len(counts)), n)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    offset = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    local = offset[:, None] + np.arange(WINDOW)
    return np.where(local < counts[row][:, None], first[row][:, None] + local, pad), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Parameters, forward pass and gradients. Gate order in the stacked matrices: z, r, n."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary  # sorted hashes; vector k + 1 is that of vocabulary[k], vector 0 of other words
        self.p = {"word": normal(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": normal(CHAR_BUCKETS, CHAR_DIM, scale=0.3), "va": normal(ATTEND, scale=0.3), "wa": normal(2 * HIDDEN, ATTEND, scale=0.3), "ba": np.zeros(ATTEND, np.float32), "wo": normal(2 * HIDDEN, scale=0.5), "bo": np.full(1, -1.0, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": normal(d, 3 * HIDDEN, scale=0.4), f"u{side}": normal(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p["word"][0] = 0

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == hashes, k + 1, 0)

    def inputs(self, w: Words) -> np.ndarray:
        """The input vector of each distinct word."""
        if not len(w.hashes):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        chars = np.add.reduceat(self.p["char"][w.trigrams], w.begin[:-1], axis=0) / np.diff(w.begin)[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][self.word_ids(w.hashes)], chars], axis=1)

    def forward(self, x: np.ndarray, index: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of the windows ``at`` (positions into ``index``; ``len(index)`` pads)."""
        ids = np.append(index, len(x))[at.T]  # time first
        pad = at.T == len(index)
        n = at.shape[0]
        states, tape = [], {}
        for side in "fb":
            gates = np.concatenate([x @ self.p[f"w{side}"] + self.p[f"b{side}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            gates[-1, :HIDDEN] = -40.0  # padding keeps the state
            u, h = self.p[f"u{side}"], np.zeros((n, HIDDEN), np.float32)
            out = np.empty((WINDOW, n, HIDDEN), np.float32)
            steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
            saved = []
            for t in steps:
                a, b = gates[ids[t]], h @ u
                zr = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
                if keep:
                    saved.append((t, h, z, r, c, b[:, 2 * HIDDEN :]))
                h = h + z * (c - h)
                out[t] = h
            states.append(out)
            tape[side] = saved
        s = np.concatenate(states, axis=2)
        act = np.tanh(s @ self.p["wa"] + self.p["ba"])
        e = np.where(pad, np.float32(-30.0), act @ self.p["va"])
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", weight, s)
        logit = pooled @ self.p["wo"] + self.p["bo"]
        return (logit, (ids, s, act, weight, pooled, tape)) if keep else logit

    def gradients(self, x: np.ndarray, w: Words, saved, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of sum(d * logit) for the windows of a forward pass with ``keep``."""
        ids, s, act, weight, pooled, tape = saved
        p, g = self.p, {}
        g["wo"], g["bo"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["wo"]
        ds = weight[:, :, None] * dp
        dw = np.einsum("nd,tnd->tn", dp, s)
        de = weight * (dw - (weight * dw).sum(axis=0))
        da = de[:, :, None] * p["va"] * (1 - act**2)
        g["va"] = np.einsum("tn,tna->a", de, act)
        g["wa"], g["ba"] = np.einsum("tnd,tna->da", s, da), da.sum(axis=(0, 1))
        ds += da @ p["wa"].T
        dx = np.zeros((len(x) + 1, x.shape[1]), np.float32)
        for k, side in enumerate("fb"):
            u, dh = p[f"u{side}"], np.zeros((ids.shape[1], HIDDEN), np.float32)
            dgate = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
            g[f"u{side}"] = np.zeros_like(u)
            for t, h, z, r, c, m in reversed(tape[side]):
                dh = dh + ds[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = dh * z * (1 - c**2)
                dz = dh * (c - h) * z * (1 - z)
                dr = dc * m * r * (1 - r)
                dz_r = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"u{side}"] += h.T @ dz_r
                np.add.at(dgate, ids[t], np.concatenate([dz, dr, dc], axis=1))
                dh = dh * (1 - z) + dz_r @ u.T
            g[f"w{side}"], g[f"b{side}"] = x.T @ dgate[:-1], dgate[:-1].sum(axis=0)
            dx[:-1] += dgate[:-1] @ p[f"w{side}"].T
        dx = dx[:-1]
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], self.word_ids(w.hashes), dx[:, :WORD_DIM])
        g["char"] = np.zeros_like(p["char"])
        size = np.diff(w.begin)
        np.add.at(g["char"], w.trigrams, np.repeat(dx[:, WORD_DIM:] / size[:, None].astype(np.float32), size, axis=0))
        return g

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The highest window logit of each row of a slice."""
        w = read_words(data, at)
        x = self.inputs(w)
        place, row = windows(w.counts, len(w.index))
        parts = [self.forward(x, w.index, place[k : k + 4096]) for k in range(0, len(place), 4096)]
        logit = np.concatenate(parts) if parts else np.zeros(0, np.float32)
        return np.maximum.reduceat(logit, np.searchsorted(row, np.arange(len(at) - 1))) if len(row) else logit


@dataclass
class Model:
    network: Network | None
    shift: float = 0.0

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(at) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(self.network.logits(data, at).astype(np.float64) + self.shift, -40, 40)))


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _distinct(texts: list[bytes], y: np.ndarray) -> np.ndarray:
    """Indices of documents that aren't copies of earlier ones: copies share one of four minima
    of their hashed five-word runs. A mislabelled text with many copies would count many times."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, t in enumerate(texts):
        w = read_words(*_join([t]))
        h = w.hashes[w.index]
        runs = h if len(h) < 5 else sum(h[k : len(h) - 4 + k] * np.uint64(2 * k + 3) for k in range(5))
        minima = [(k, int(mix(runs ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1)).min())) for k in range(4)] if len(h) else [(-1, 0)]
        if not any(m in seen for m in minima):
            out.append(i)
        seen.update(minima)
    return np.array(out, np.int64)


def _start_vectors(net: Network, hashes: list[np.ndarray], y: np.ndarray) -> None:
    """The first coordinate of a word vector starts from how many standard deviations more
    toxic documents hold the word than chance would have."""
    seen = np.zeros((2, len(net.vocabulary) + 1))
    for h, label in zip(hashes, y, strict=True):
        seen[label, np.unique(net.word_ids(h))] += 1
    n, share = seen.sum(axis=0), y.mean()
    z = (seen[1] - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    net.p["word"][1:, 0] = np.clip((z[1:] - 4) / 2, 0, 3)


def fit(texts: list[bytes], y: np.ndarray, steps: int = 320, batch: int = 36, rate: float = 0.01, seed: int = 11) -> Model:
    """Train on whole documents by Adam; the last fifth of them places the threshold. The loss of a
    toxic document is weighted by its probability to the power 0.7, so that labels which nothing
    in the text supports fade instead of being learned by heart."""
    if len(set(y.tolist())) < 2:
        return Model(None)
    use = _distinct(texts, y)
    texts, y = [texts[i] for i in use], y[use]
    if len(set(y.tolist())) < 2:
        return Model(None)
    own = np.flatnonzero(np.arange(len(y)) % 5 != 4)
    hashes = [read_words(*_join([texts[i]])).hashes for i in own]
    values, seen = np.unique(np.concatenate(hashes), return_counts=True)
    net = Network(values[seen >= MIN_DOCS])
    _start_vectors(net, hashes, y[own])
    rng = np.random.default_rng(seed)
    classes = [own[y[own] == k] for k in (0, 1)]
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(classes[0], batch * 2 // 3), rng.choice(classes[1], batch // 3)])
        data, at = _join([texts[i] for i in chosen])
        w = read_words(data, at)
        x = net.inputs(w)
        place, row = windows(w.counts, len(w.index))
        logit = np.concatenate([net.forward(x, w.index, place[k : k + 4096]) for k in range(0, len(place), 4096)])
        top = np.lexsort((logit, row))[np.searchsorted(row, np.arange(1, len(chosen) + 1)) - 1]
        out, saved = net.forward(x, w.index, place[top], keep=True)
        p = _sigmoid(out)
        d = ((p - y[chosen]) * np.where(y[chosen] == 1, p**0.7, 1.0) / len(chosen)).astype(np.float32)
        slow = min(1.0, 2 * (1 - step / steps) + 0.05)
        for k, g in net.gradients(x, w, saved, d).items():
            g = np.clip(g, -1, 1)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            net.p[k] -= rate * slow * (0.2 if k == "word" else 1.0) * move
    rest = np.setdiff1d(np.arange(len(y)), own)
    if len(set(y[rest].tolist())) < 2:
        rest = np.arange(len(y))
    return Model(net, _place(np.concatenate([net.logits(*_join([texts[i]])) for i in rest]), y[rest]))


def _place(logit: np.ndarray, y: np.ndarray) -> float:
    """Minus the cut with the fewest errors, half way to its neighbours; false alarms count twice."""
    order = np.argsort(logit)
    s, t = logit[order], y[order]
    errors = np.concatenate([[0], np.cumsum(t == 1)]) + 2 * np.concatenate([np.cumsum((t == 0)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    ends = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    cuts = (ends[best] + ends[best + 1]) / 2
    gap = ends[best + 1] - ends[best]
    return -float(cuts[np.argmax(gap)])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: dict[int, int] = SAMPLE) -> Model:
    """Fit on the bounded sample of the labelled rows outside the held-out fold."""
    short = docs.filter(F.octet_length("text") <= TRAIN_BYTES)
    rows = sorted(((r["doc_id"], r["text"].encode(), r["y"]) for r in training_sample(short, labels, label, sample).collect()), key=lambda r: r[0])
    return fit([r[1] for r in rows], np.array([r[2] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted for every document, and its columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *keep]
    text = "text" if "text" in keep else "__text"  # a kept text isn't sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(data, at) for _, data, at in slices(batch, text, SLICE)]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(values, pa.float64())], names=[*names, "score"])

    wide = docs.select(*names, *([] if "text" in keep else [F.col("text").alias("__text")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields[: len(names)]) + ", score double"
    scored = wide.mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
