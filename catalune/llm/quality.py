"""Quality classifier: a factorisation machine over text features.

score(x) = sigmoid(b + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The last term holds all pairwise interactions at rank ``FACTORS`` and costs
time linear in the features (the sum-of-squares identity). Features are hashed
lower-case words (log counts, unit length), structure statistics in quantised
bins, and length metadata computed from the text. Labels, language, source and
ids are never features.

The model is fitted on the driver from features of at most ``train_rows``
labelled rows outside the held-out fold (``common.training_ids``); scoring
covers every whole text. Null texts are empty texts; an empty text gets the
score of its (few) structure bins. Without usable labels every score is 0.5.
Extra columns are ignored; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import held_out, training_ids

WORD_BITS = 16
FACTORS = 8
BINS = 16
TRAIN_ROWS = 8000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = tb.byte_table(bytes(i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"?-()"))
_STOP = tb.byte_table(b".,;:?!")
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_LINE = tb.byte_table(b"\n")
_HEAD = ~((np.arange(256) & 0xC0) == 0x80)
#: (table of bytes, name); each gives a share of the bytes of the text.
_SHARES = (_UPPER, _DIGIT, _MARK, _STOP, _HIGH, _LINE, tb.SPACE)
STATS = len(_SHARES) + 7
SIZE = (1 << WORD_BITS) + STATS * BINS


def statistics(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, row: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """A (rows, STATS) array with values in [0, 1]."""
    rows = len(off) - 1
    size = np.maximum(off[1:] - off[:-1], 1).astype(float)
    out = np.zeros((rows, STATS), np.float32)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[off[1:]] - total[off[:-1]]

    for k, t in enumerate(_SHARES):
        out[:, k] = np.sqrt(per_row(t[data]) / size)
    k = len(_SHARES)
    words = np.bincount(row, minlength=rows).astype(float)
    some = np.maximum(words, 1)
    out[:, k] = np.log1p(words) / 12
    out[:, k + 1] = np.log1p(per_row(_HEAD[data])) / 14
    out[:, k + 2] = np.minimum(np.bincount(row, weights=ends - starts, minlength=rows) / some / 20, 1)
    out[:, k + 3] = distinct / some
    twice = np.zeros(len(row), bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out[:, k + 4] = np.bincount(row, weights=twice, minlength=rows) / some
    lone = np.zeros(len(data), bool)
    lone[1:-1] = _MARK[data[1:-1]] & tb.SPACE[data[:-2]] & tb.SPACE[data[2:]]
    out[:, k + 5] = np.minimum(per_row(lone) / some, 1)
    pair = np.zeros(len(data), bool)
    pair[1:] = _MARK[data[1:]] & (data[1:] == data[:-1])
    out[:, k + 6] = np.minimum(per_row(pair) / some, 1)
    return out


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row bounds, feature ids, values) of the texts of one block."""
    raw, off = tb.flat(col)
    data = tb.LOWER[raw]
    rows = len(off) - 1
    starts, ends = tb.spans(tb.WORD[data], off)
    hashes = tb.span_hashes(data, starts, ends)
    row = tb.rows_of(starts, off)
    key = np.sort((row.astype(np.uint64) << np.uint64(32)) | (hashes & np.uint64((1 << WORD_BITS) - 1)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(key)))
    ids = (key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = (key[at] >> np.uint64(32)).astype(np.int64)
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=rows))
    value = value / np.maximum(norm[owner], 1e-9)
    stats = statistics(raw, off, starts, ends, hashes, row, np.bincount(owner, minlength=rows))
    bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1) + (1 << WORD_BITS) + np.arange(STATS) * BINS
    ids = np.concatenate((ids, bins.ravel()))
    owner = np.concatenate((owner, np.repeat(np.arange(rows), STATS)))
    value = np.concatenate((value, np.full(rows * STATS, 1 / np.sqrt(STATS))))
    order = np.argsort(owner, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))
    return bounds, ids[order], value[order].astype(np.float32)


def margins(w: np.ndarray, v: np.ndarray, bias: float, bounds: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The machine's raw outputs; every row has at least STATS features."""
    if len(bounds) < 2:
        return np.zeros(0)
    linear = np.add.reduceat(w[ids] * x, bounds[:-1])
    vx = v[ids] * x[:, None]
    s = np.add.reduceat(vx, bounds[:-1], axis=0)
    q = np.add.reduceat(vx * vx, bounds[:-1], axis=0)
    return bias + linear + 0.5 * (s * s - q).sum(1)


def fit(bounds: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int = 1500, rate: float = 0.08, l2: float = 2e-4, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """AdaGrad on the log loss, in mini-batches."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32)
    gw, gv, gb = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, FACTORS), 1e-3, np.float32), 1e-3
    rows = len(y)
    bias = float(np.log((y.sum() + 1) / (rows - y.sum() + 1)))
    for _ in range(min(60, max(8, steps * 64 // max(rows, 1)))):
        order = rng.permutation(rows)
        for a in range(0, rows, 64):
            take = np.sort(order[a : a + 64])
            size = bounds[take + 1] - bounds[take]
            at = np.repeat(bounds[take] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            i, xi = ids[at], x[at]
            b = np.concatenate(([0], np.cumsum(size)))
            vx = v[i] * xi[:, None]
            s = np.add.reduceat(vx, b[:-1], axis=0)
            out = bias + np.add.reduceat(w[i] * xi, b[:-1]) + 0.5 * (s * s - np.add.reduceat(vx * vx, b[:-1], axis=0)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[take]) / len(take)
            ge = np.repeat(g, size)
            used, inv = np.unique(i, return_inverse=True)
            dw = np.bincount(inv, weights=ge * xi) + l2 * w[used]
            d = (ge * xi)[:, None] * (np.repeat(s, size, axis=0) - vx)
            dv = np.stack([np.bincount(inv, weights=d[:, f]) for f in range(FACTORS)], 1) + l2 * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += float(g.sum()) ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * float(g.sum()) / np.sqrt(gb)
    return w, v, bias


@dataclass
class QualityModel:
    w: np.ndarray | None = None
    v: np.ndarray | None = None
    bias: float = 0.0

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
        """Fit on at most ``train_rows`` labelled rows; their features come to the driver."""
        sample = docs.select("doc_id", "text").join(F.broadcast(training_ids(labels, label, train_rows)), "doc_id").select("y", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = tb.texts(b, "text")
                for lo, hi in tb.blocks(col):
                    bounds, ids, x = features(col.slice(lo, hi - lo))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.float32()))],
                        names=["y", "ids", "x"],
                    )

        got = sample.mapInArrow(run, "y double, ids array<int>, x array<float>").toArrow()
        y = got.column("y").to_numpy()
        if len(y) == 0 or y.min() == y.max():
            return cls(bias=0.0 if len(y) == 0 else 4.0 * (1 if y[0] else -1))
        lists = got.column("ids").combine_chunks()
        values = got.column("x").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        bounds = np.concatenate(([0], np.cumsum(size)))
        ids, x = lists.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy()
        # rows in an order of their own content: partitioning must not change the model
        order = np.lexsort((np.add.reduceat(x, bounds[:-1]), np.add.reduceat(ids, bounds[:-1]), size, y))
        at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in order])
        bounds = np.concatenate(([0], np.cumsum(size[order])))
        return cls(*fit(bounds, ids[at], x[at], y[order]))

    def score(self, docs: DataFrame, threshold: float) -> DataFrame:
        """(doc_id, held_out, score, predicted) of every row."""
        model = docs.sparkSession.sparkContext.broadcast((self.w, self.v, self.bias))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, v, bias = model.value
            for b in batches:
                col = tb.texts(b, "text")
                for lo, hi in tb.blocks(col):
                    if w is None:
                        m = np.full(hi - lo, bias)
                    else:
                        m = margins(w, v, bias, *features(col.slice(lo, hi - lo)))
                    score = np.round(1 / (1 + np.exp(-np.clip(m, -30, 30))), 6)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(score, pa.float64())], names=["doc_id", "score"])

        src = docs.select("doc_id", "text")
        out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
        return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
