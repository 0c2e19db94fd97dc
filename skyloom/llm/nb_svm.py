"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes log-count ratios.

Tokens are runs of letters, digits and bytes of 128 or more, or runs of other visible bytes.
Features are hashed indicators of single tokens, of neighbouring pairs and of binned shares
(repeated neighbours, distinct tokens, upper-case and symbol tokens), each scaled by its ratio and
the document's vector to unit length, in fitting and in scoring alike. Features that no training
row has are left out. The SVM is fitted by dual coordinate descent on a bounded sample (``SAMPLE``
rows a class) of the labelled rows outside the held-out fold, and its weights are drawn towards their
mean size, as the method has it; every document is then scored whole, in slices of bounded memory.

Defined cases: null and empty texts have no tokens and get the score of an empty document;
repeated rows get equal scores; further columns are ignored; an empty table gives an empty
result; without labelled rows of both classes every score is 0.5.
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

#: Labelled rows a class that the model is fitted on.
SAMPLE = {0: 3000, 1: 5000}
BITS = 20
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letter or digit, 2 other
_KIND[33:127] = 2
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_a:_b] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and kinds of the tokens of a slice."""
    kind = _KIND[data]
    found = [spans(kind == k, at) for k in (1, 2)]
    start = np.concatenate([f[0] for f in found])
    order = np.argsort(start, kind="stable")
    row = np.concatenate([np.repeat(np.arange(len(at) - 1), f[2]) for f in found])
    kinds = np.concatenate([np.full(len(f[0]), k, np.uint8) for k, f in zip((1, 2), found, strict=True)])
    return start[order], np.concatenate([f[1] for f in found])[order], row[order], kinds[order]


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indicators of a slice as sorted, distinct (row, feature) pairs."""
    n = len(at) - 1
    start, end, row, kind = _tokens(data, at)
    h = span_hashes(data, start, end)
    mask = np.uint64((1 << BITS) - 1)
    with_next = row[1:] == row[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])[with_next]
    keys = [row.astype(np.uint64) << np.uint64(BITS) | h & mask, row[1:][with_next].astype(np.uint64) << np.uint64(BITS) | pair & mask]
    total = np.bincount(row, minlength=n)
    alone = np.unique(keys[0])
    distinct = np.bincount((alone >> np.uint64(BITS)).astype(np.int64), minlength=n)
    second = np.concatenate([[False, False], (h[2:] == h[:-2]) & (row[2:] == row[:-2])])[: len(h)]
    again = np.concatenate([[False], (h[1:] == h[:-1]) & with_next])[: len(h)] | second
    upper = np.zeros(n)
    if len(h):
        upper = np.bincount(row, _UPPER[data[start]] & _UPPER[data[end - 1]] & (end - start > 1), minlength=n)
    shares = [np.bincount(row, again, minlength=n), distinct, upper, np.bincount(row, kind == 2, minlength=n)]
    for k, s in enumerate(shares):
        value = np.floor(8 * s / np.maximum(total, 1)).astype(np.uint64) + np.uint64(1000 * (k + 1))
        keys.append(np.arange(n, dtype=np.uint64) << np.uint64(BITS) | mix(value) & mask)
    size = np.minimum(np.log2(total + 1).astype(np.uint64), np.uint64(8)) + np.uint64(9000)  # indicators of length
    keys.append(np.arange(n, dtype=np.uint64) << np.uint64(BITS) | mix(size) & mask)
    found = np.unique(np.concatenate([alone, *keys[1:]]))
    return (found >> np.uint64(BITS)).astype(np.int64), (found & mask).astype(np.int64)


@dataclass
class Model:
    """``weights``: by feature, the SVM's weight times the ratio; ``squares``: the squared ratio."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.probability(self.margins(*features(data, at), len(at) - 1))

    def margins(self, row: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        """Margins of ``n`` rows from (row, feature) pairs."""
        length = np.sqrt(np.bincount(row, self.squares[f], minlength=n))
        return np.bincount(row, self.weights[f], minlength=n) / np.maximum(length, 1e-9) + self.bias


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the smoothed share of a feature in class 1 over its share in class 0; 0 for one that no row has."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for f, label in zip(rows, y, strict=True):
        counts[label][f] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    own = counts[:, seen] + alpha
    out = np.zeros(1 << BITS)
    out[seen] = np.log(own[1] / own[1].sum()) - np.log(own[0] / own[0].sum())
    return out


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dimensions: int, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2/2 + sum cost * hinge, one dual variable at a time."""
    w, b, alpha = np.zeros(dimensions), 0.0, np.zeros(len(y))
    sign = np.where(y == 1, 1.0, -1.0)
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            gradient = sign[i] * (w[f] @ v + b) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * v
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, b


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 0.1, blend: float = 0.75) -> Model:
    """NB-SVM on the rows' feature lists; a fifth of the rows only calibrates the margins."""
    if len(set(y.tolist())) < 2:
        return Model(*np.zeros((2, 1 << BITS), np.float32), 0.0, 0.0, 0.0)
    calibrates = np.arange(len(y)) % 5 == 4
    ratio = log_count_ratios([r for r, k in zip(rows, calibrates, strict=True) if not k], y[~calibrates])
    share = np.array([(y == k).mean() for k in (0, 1)])
    values = []
    for r in rows:  # unit length, so that long documents count no more than short ones
        v = ratio[r]
        values.append(v / max(1e-9, np.sqrt(v @ v)))
    own = np.flatnonzero(~calibrates)
    cost = c / (2 * share[y[own]]) * 10
    w, b = dual_coordinate_descent([rows[i] for i in own], [values[i] for i in own], y[own], cost, 1 << BITS)
    mean = np.abs(w).sum() / max(1, np.count_nonzero(ratio))
    model = Model((((1 - blend) * mean + blend * w) * ratio).astype(np.float32), (ratio**2).astype(np.float32), b, 0.0, 0.0)
    margin = model.margins(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows), len(rows))
    use = calibrates if len(set(y[calibrates].tolist())) == 2 else np.ones(len(y), bool)
    model.slope, model.shift = _platt(margin[use], y[use])
    return model


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration with smoothed targets, by Newton steps on standardised margins."""
    centre, scale = margin.mean(), margin.std() or 1.0
    x = np.stack([(margin - centre) / scale, np.ones(len(y))], 1)
    positive, negative = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * a)
        a += step
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0] / scale), float(a[1] - a[0] * centre / scale)


def _feature_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, at in slices(batch, "text"):
            row, f = features(data, at)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(at))), pa.int32()), pa.array(f.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2)], names=["doc_id", "f", "y"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: dict[int, int] = SAMPLE) -> Model:
    """Fit on the bounded sample; only its feature lists come to the driver."""
    found = training_sample(docs, labels, label, sample).select("doc_id", "text", "y").mapInArrow(_feature_lists, "doc_id long, f array<int>, y int")
    sample_ = found.toArrow().combine_chunks()  # columns, as lists of Python numbers would need ten times the memory
    f, y = sample_.column("f").combine_chunks(), sample_.column("y").to_numpy()
    at, flat = f.offsets.to_numpy(), f.values.to_numpy()
    order = np.argsort(sample_.column("doc_id").to_numpy(), kind="stable")
    return fit([flat[at[k] : at[k + 1]] for k in order], y[order].astype(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.scores(data, at) for _, data, at in slices(batch, "text")]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
