"""Toxicity: maximum-scoring segments over token log-odds.

1. Token scores. From labelled training rows, the number of toxic and clean
   documents that hold each hashed token gives a log-odds ratio with an
   informative Dirichlet prior (pseudo-counts in proportion to the token's
   share of all counts) and its standard deviation. The same is done for word
   beginnings of a few lengths, which pool the forms of a stem. A token's score
   is the largest lower confidence bound among its word and beginnings less a
   drift, so that only tokens with evidence score above zero and the expected
   score is negative. Copies of a text count once.
2. Passages. A linear-time scan finds all maximal-scoring segments of a text
   (disjoint; none can be extended or merged to score more). Tokens between
   two positive ones enter as one run, so the loop visits positive runs only.
3. Calibration. With the Karlin-Altschul parameters lambda and K of the clean
   score distribution, a segment of score S in a text of n tokens has
   expectation K n exp(-lambda S). A segment is significant if that is at
   most ``MAX_EXPECT``. A document's statistics are its largest normalised
   segment, the log expectation of that segment, and of its significant
   segments the sum, the number and the number of different strong words in
   them; logistic regression on the training rows maps them to a probability.

Fitting uses at most ``train_rows`` labelled rows outside the held-out fold.
Every whole text is scored. Null texts are empty; an empty text has no segment
and gets the intercept's score. Without usable labels every score is 0.
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

TOKEN_BITS = 20
STEMS = (4, 5, 6)
TRAIN_ROWS = 20000
PRIOR = 20000.0
DRIFT = 0.2
FLOOR = -2.0
BOUND = 2.5
MAX_EXPECT = 0.05
STRONG = 2.0
STATS = 5
_MASK = np.uint64((1 << TOKEN_BITS) - 1)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, row, start, end, row offsets) of the words of one block.

    buckets has a column for the word and one for each stem length (the word's
    own bucket again where the word is no longer than the stem).
    """
    raw, off = tb.flat(col)
    data = tb.LOWER[raw]
    starts, ends = tb.spans(tb.WORD[data], off)
    out = np.empty((len(starts), 1 + len(STEMS)), np.int32)
    out[:, 0] = tb.span_hashes(data, starts, ends) & _MASK
    for k, size in enumerate(STEMS, 1):
        longer = np.flatnonzero(ends - starts > size)
        out[:, k] = out[:, 0]
        out[longer, k] = tb.mix(tb.span_hashes(data, starts[longer], starts[longer] + size) + np.uint64(size)) & _MASK
    return out, tb.rows_of(starts, off), starts, ends, off


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Token scores from document counts per bucket."""
    total = toxic + clean
    size = min(PRIOR, total.sum() / 10)  # weak beside the counts of a small sample
    prior = size * total / max(total.sum(), 1)
    a, b = toxic + prior, clean + prior
    with np.errstate(divide="ignore", invalid="ignore"):
        delta = np.log(a / (toxic.sum() + size - a)) - np.log(b / (clean.sum() + size - b))
        sd = np.sqrt(1 / a + 1 / b)
    score = np.where(delta > 0, np.maximum(delta - BOUND * sd, -0.0), delta) - DRIFT
    return np.where(total > 0, np.clip(score, FLOOR, None), -DRIFT)


def karlin(score: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """lambda with sum(share * exp(lambda * score)) = 1, and the usual bound for K."""
    seen = share > 0
    s, p = score[seen], share[seen] / share.sum()
    if not (s > 0).any() or (s * p).sum() >= 0:
        return 1.0, 0.1
    lo, hi = 0.0, 1.0
    while (p * np.exp(np.minimum(hi * s, 50))).sum() < 1 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 50))).sum() < 1 else (lo, mid)
    return max(hi, 1e-3), min(1.0, max(1e-3, -(s * p).sum()))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [first, last] of a sequence, in linear time.

    Candidates form a list; each keeps the running total left of it (l) and at
    its end (r). A new positive element is joined to the nearest candidate j
    with l_j below its own l, if that candidate's r does not exceed its r.
    """
    found: list[list] = []
    back: list[int] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        left, right, first = total, total + s, i
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = back[j]
            if j < 0 or found[j][3] >= right:
                found.append([first, i, left, right])
                back.append(j)
                break
            first, left = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(a, b, r - lo) for a, b, lo, r in found]


def passages(bucket: np.ndarray, row: np.ndarray, score: np.ndarray) -> dict[int, list[tuple[int, int, float]]]:
    """row -> maximal segments as (first token, last token, score), indices within the block.

    Runs of non-positive tokens between positive runs are summed first, so the
    loop is over positive runs; rows without a positive token are absent.
    """
    s = score[bucket].max(1) if len(bucket) else np.zeros(0)
    same = np.zeros(len(s), bool)  # a word said again at once is no new evidence
    same[1:] = (bucket[1:, 0] == bucket[:-1, 0]) & (row[1:] == row[:-1])
    s[same] = np.minimum(s[same], -DRIFT)
    hot = s > 0
    if not hot.any():
        return {}
    total = np.concatenate(([0.0], np.cumsum(s)))
    first, last = tb.spans(hot, np.concatenate((np.flatnonzero(np.diff(row, prepend=-1)), [len(row)])))
    out: dict[int, list[tuple[int, int, float]]] = {}
    owner = row[first]
    cuts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        seq: list[float] = []
        for k in range(a, b):
            if k > a:
                seq.append(float(total[first[k]] - total[last[k - 1]]))
            seq.append(float(total[last[k]] - total[first[k]]))
        out[int(owner[a])] = [(int(first[a + i // 2]), int(last[a + (j + 1) // 2]) - 1, t) for i, j, t in maximal_segments(seq)]
    return out


def evidence(col: pa.Array, score: np.ndarray, lam: float, k: float) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Document statistics (rows, STATS) and the significant passages as (first byte, end byte, expectation)."""
    bucket, row, starts, ends, off = tokens(col)
    n = np.bincount(row, minlength=len(col))
    stats = np.zeros((len(col), STATS))
    strong = score[bucket].max(1) >= STRONG if len(bucket) else np.zeros(0, bool)
    spots: list[list[tuple[int, int, float]]] = [[] for _ in range(len(col))]
    for r, segments in passages(bucket, row, score).items():
        size = np.log(max(k * n[r], 1.0))
        best, held = 0.0, 0.0
        words: set[int] = set()
        for a, b, s in segments:
            bits = lam * s
            best = max(best, bits)
            if size - bits <= np.log(MAX_EXPECT):
                held += bits - size
                words.update(bucket[a : b + 1, 0][strong[a : b + 1]].tolist())
                spots[r].append((int(starts[a] - off[r]), int(ends[b] - off[r]), float(np.exp(size - bits))))
        stats[r] = min(best, 40) / 10, min(max(best - size, -10.0), 30) / 10, min(np.log1p(held), 6) / 3, np.log1p(len(spots[r])), np.log1p(len(words))
    return stats, spots


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def probabilities(col: pa.Array, score: np.ndarray, lam: float, k: float, weights: np.ndarray) -> tuple[np.ndarray, list]:
    """Calibrated probabilities and significant passages of the texts of one block."""
    x, spots = evidence(col, score, lam, k)
    return np.round(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))), 6), spots


@dataclass
class ToxicityModel:
    score: np.ndarray | None = None
    lam: float = 1.0
    k: float = 0.1
    weights: np.ndarray | None = None

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
        """Two passes over the sample: token counts (at most 2^20 buckets), then statistics."""
        sample = docs.select("doc_id", "text").join(F.broadcast(training_ids(labels, label, train_rows)), "doc_id").groupBy("text").agg(F.max("y").alias("y")).select("y", "text")

        def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = np.zeros((2, 1 << TOKEN_BITS), np.int64)
            for b in batches:
                col, y = tb.texts(b, "text"), b.column(0).to_numpy() > 0.5
                for lo, hi in tb.blocks(col):
                    bucket, row, *_ = tokens(col.slice(lo, hi - lo))
                    own = np.unique((np.repeat(row, bucket.shape[1]) << TOKEN_BITS) | bucket.ravel())
                    marked = y[lo:hi][own >> TOKEN_BITS]
                    own &= (1 << TOKEN_BITS) - 1
                    both[1] += np.bincount(own[marked], minlength=1 << TOKEN_BITS)
                    both[0] += np.bincount(own[~marked], minlength=1 << TOKEN_BITS)
            some = np.flatnonzero(both.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(both[1][some]), pa.array(both[0][some])], names=["b", "t", "c"])

        got = sample.mapInArrow(counts, "b long, t long, c long").groupBy("b").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).toArrow()
        b, t, c = (got.column(x).to_numpy() for x in "btc")
        toxic, clean = np.zeros(1 << TOKEN_BITS), np.zeros(1 << TOKEN_BITS)
        toxic[b], clean[b] = t, c
        if toxic.sum() == 0 or clean.sum() == 0:
            return cls()
        model = cls(log_odds(toxic, clean).astype(np.float32))
        model.lam, model.k = karlin(model.score, clean)
        shared = docs.sparkSession.sparkContext.broadcast((model.score, model.lam, model.k))

        def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = tb.texts(b, "text")
                for lo, hi in tb.blocks(col):
                    x, _ = evidence(col.slice(lo, hi - lo), *shared.value)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(x[:, i]) for i in range(STATS))], names=["y", *names])

        names = [f"x{i}" for i in range(STATS)]
        got = sample.mapInArrow(stats, ", ".join(f"{n} double" for n in ["y", *names])).toArrow()
        x = np.stack([got.column(n).to_numpy() for n in names], 1)
        y = got.column("y").to_numpy()
        order = np.lexsort((y, *x.T))
        model.weights = logistic(x[order], y[order])
        return model

    def keep(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """The rows of ``docs`` whose score is below the threshold, all columns; all rows without a model."""
        if self.weights is None:
            return docs
        model = docs.sparkSession.sparkContext.broadcast((self.score, self.lam, self.k, self.weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = tb.texts(b, "text")
                for lo, hi in tb.blocks(col):
                    p, _ = probabilities(col.slice(lo, hi - lo), *model.value)
                    yield b.slice(lo, hi - lo).filter(pa.array(p < threshold))

        return docs.mapInArrow(run, docs.schema)

    def apply(self, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``docs`` with score, predicted and passages (byte ranges of significant passages)."""
        model = docs.sparkSession.sparkContext.broadcast((self.score, self.lam, self.k, self.weights))
        src = docs.select("doc_id", "text")
        kind = src.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score, lam, k, weights = model.value
            spot = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("expect", pa.float64())]))
            for b in batches:
                col = tb.texts(b, "text")
                for lo, hi in tb.blocks(col):
                    if weights is None:
                        p, spots = np.zeros(hi - lo), [[] for _ in range(hi - lo)]
                    else:
                        p, spots = probabilities(col.slice(lo, hi - lo), score, lam, k, weights)
                    found = [[{"first": a, "end": e, "expect": v} for a, e, v in s] for s in spots]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p), pa.array(found, spot)], names=["doc_id", "score", "passages"])

        out = src.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<first:long,end:long,expect:double>>")
        return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
