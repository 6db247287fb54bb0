"""Document fingerprints by consistent weighted sampling (Ioffe, ICDM 2010).

For each term of weight w and each of ``SAMPLES`` samples, r and c are
Gamma(2, 1) and b uniform draws, functions of the term's hash and the sample
number alone. With t = floor(ln w / r + b), the term's value is
ln c - r * (t + 1 - b), and the sample is the (term, t) of smallest value. Two
texts have the same sample with probability equal to the generalised Jaccard
similarity of their weights, sum(min) / sum(max).

Terms are lower-case words. A weight is the count times a factor from the
word's length, so that function words count less. Weights of single
occurrences depend on the term only, so their values are computed once per
distinct word of a block.

A fingerprint is 16 bits of each sample in hex. Null texts are empty texts;
texts without a word have an all-zero fingerprint and likeness 1 to each
other. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblock as tb

SAMPLES = 64
BLOCK = 1 << 20
BUCKET_ROWS = 2000
MAX_BUCKETS = 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _draws(h: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b as (terms, samples) float32 arrays."""
    x = tb.mix(h[:, None] + (np.arange(1, samples + 1, dtype=np.uint64) * _GOLD)[None, :])
    half, unit = np.float32(0.5), np.float32(1 / 65536)

    def part(v: np.ndarray, lane: int) -> np.ndarray:
        out = v.view(np.uint16)[:, lane::4].astype(np.float32)
        out += half
        out *= unit
        return out

    r = np.log(part(x, 0) * part(x, 1))
    np.negative(r, out=r)
    b = part(x, 2)
    x = tb.mix(x)  # c has uniforms of its own: it must not depend on r
    fine = (x.view(np.uint32) >> np.uint32(8)).astype(np.float32)
    fine += half
    fine *= np.float32(2.0**-24)
    np.log(fine, out=fine)
    return r, np.log(-(fine[:, 0::2] + fine[:, 1::2])), b


def _packed(value: np.ndarray, term: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sortable value in the high half, 16 bits of (term, t) in the low one."""
    out = np.empty(value.shape + (2,), np.uint32)
    bits = value.view(np.int32)
    # flip all bits of negative numbers and the sign of the others
    np.bitwise_xor(bits, (bits >> 31) | np.int32(-(1 << 31)), out=out[..., 1].view(np.int32))
    ident = t.astype(np.int32).view(np.uint32)
    ident *= np.uint32(0x9E3779B1)
    ident += term
    ident *= np.uint32(0x85EBCA6B)
    ident >>= np.uint32(16)
    out[..., 0] = ident
    return out.view(np.uint64)[..., 0]


def _values(r: np.ndarray, lnc: np.ndarray, b: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
    return _packed(lnc - r * (t + np.float32(1) - b), term[:, None], t)


def signatures(col: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """(rows, samples) uint16; rows without a word are all zero, others never hold a zero."""
    raw, off = tb.flat(col)
    data = tb.LOWER[raw]
    rows = len(off) - 1
    out = np.zeros((rows, samples), np.uint16)
    starts, ends = tb.spans(tb.WORD[data], off)
    if not len(starts):
        return out
    h, at = np.unique(tb.span_hashes(data, starts, ends), return_inverse=True)
    factor = np.zeros(len(h))
    factor[at] = np.clip(ends - starts - 3, 1, 9)
    key = np.sort(tb.rows_of(starts, off) * len(h) + at)
    first = np.concatenate(([True], key[1:] != key[:-1]))
    key = key[first]
    count = np.diff(np.append(np.flatnonzero(first), len(first)))
    row, term = key // len(h), key % len(h)
    low = h.astype(np.uint32)
    r, lnc, b = (np.empty((len(h), samples), np.float32) for _ in range(3))
    once = np.empty((len(h), samples), np.uint64)
    for a in range(0, len(h), 512):
        at = slice(a, a + 512)
        r[at], lnc[at], b[at] = _draws(h[at], samples)
        once[at] = _values(r[at], lnc[at], b[at], low[at], factor[at])
    bounds = np.searchsorted(row, np.arange(rows + 1))
    for a in range(0, rows, 16):
        e = min(a + 16, rows)
        lo, hi = bounds[a], bounds[e]
        if lo == hi:
            continue
        v = once[term[lo:hi]]
        more = np.flatnonzero(count[lo:hi] > 1)
        k = term[lo:hi][more]
        v[more] = _values(r[k], lnc[k], b[k], low[k], factor[k] * count[lo:hi][more])
        some = np.flatnonzero(np.diff(bounds[a : e + 1]))
        least = np.minimum.reduceat(v, bounds[a:e][some] - lo, axis=0)
        got = (least & np.uint64(0xFFFF)).astype(np.uint16)
        got[got == 0] = 1
        out[a + some] = got
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def _pack_rows(sig: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in sig], pa.binary())


def _bounds(docs: DataFrame, bucket_rows: int, max_buckets: int) -> np.ndarray:
    """Id boundaries of ranges with about equally many rows."""
    n = docs.where("doc_id is not null").count()
    parts = max(1, min(max_buckets, n // bucket_rows))
    if parts == 1:
        return np.zeros(0)
    probs = [k / parts for k in range(1, parts)]
    return np.unique(np.array(docs.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", probs, 1 / (4 * parts))))


def _packed_texts(col: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", 1)
    return pa.array([len(x := t.encode()).to_bytes(8, "little") + codec.compress(x, asbytes=True) for t in col.to_pylist()], pa.binary())


def _unpacked(raw: bytes) -> str:
    size = int.from_bytes(raw[:8], "little")
    return pa.Codec("zstd").decompress(raw[8:], size, asbytes=True).decode() if size else ""


def fingerprints(docs: DataFrame, samples: int = SAMPLES, bounds: np.ndarray | None = None) -> DataFrame:
    """(doc_id, bucket, packed, tie, n_chars, sig) of every row; bucket -1 for null ids.

    packed is the compressed text, as it travels through the shuffle; tie a hash of it.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumns({"n_chars": F.char_length("text").cast("long"), "tie": F.xxhash64("text")})
    edges = np.zeros(0) if bounds is None else bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = tb.texts(b, "text")
            for lo, hi in tb.blocks(col, BLOCK):
                part = b.slice(lo, hi - lo)
                ids = part.column(0)
                bucket = np.searchsorted(edges, ids.fill_null(0).to_numpy(), side="right")
                bucket[ids.is_null().to_numpy(zero_copy_only=False)] = -1
                yield pa.RecordBatch.from_arrays([ids, pa.array(bucket, pa.int32()), _packed_texts(part.column(1)), part.column(3), part.column(2), _pack_rows(signatures(col.slice(lo, hi - lo), samples))], names=["doc_id", "bucket", "packed", "tie", "n_chars", "sig"])

    return src.mapInArrow(run, "doc_id long, bucket int, packed binary, tie long, n_chars long, sig binary")


def with_next(docs: DataFrame, samples: int = SAMPLES, bucket_rows: int = BUCKET_ROWS, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Fingerprints with the text and fingerprint of the next row by descending id; the first follows the last.

    Rows are dealt into id ranges and sorted there. Each range also receives a
    copy of the first row of the range below it, so no global sort is needed
    and the text is shuffled once. Rows of equal id follow in order of a hash of
    their texts; rows with a null id come last.
    """
    bounds = _bounds(docs, bucket_rows, max_buckets)

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            bucket = np.searchsorted(bounds, ids.fill_null(0).to_numpy(), side="right")
            bucket[ids.is_null().to_numpy(zero_copy_only=False)] = -1
            yield pa.RecordBatch.from_arrays([ids, pa.array(bucket, pa.int32())], names=["doc_id", "bucket"])

    tops = docs.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(bucket_of, "doc_id long, bucket int").groupBy("bucket").agg(F.max("doc_id").alias("top"))
    tops = sorted((tuple(x) for x in tops.collect()), reverse=True)  # at most max_buckets + 1 rows
    spark = docs.sparkSession
    # the head of each range goes to the range above it, that of the highest to the lowest
    moves = [(top, tops[k - 1][0]) for k, (_, top) in enumerate(tops)]
    heads = spark.createDataFrame(moves, "top long, goes int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lead = texts.join(F.broadcast(heads), texts["doc_id"].eqNullSafe(heads["top"])).groupBy("goes", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    whole = fingerprints(docs, samples, bounds).withColumn("copy", F.lit(False))
    lead = fingerprints(lead.select("doc_id", "text"), samples, bounds).drop("bucket").join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top")))
    lead = lead.select("doc_id", F.col("goes").alias("bucket"), "packed", "tie", "n_chars", "sig", F.lit(True).alias("copy"))
    w = Window.partitionBy("bucket").orderBy(F.col("copy"), F.col("doc_id").desc_nulls_last(), F.col("tie"))
    out = whole.unionByName(lead)
    return out.withColumns({"next_packed": F.lead("packed").over(w), "next_sig": F.lead("sig").over(w)}).where(~F.col("copy")).drop("bucket", "copy")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text's first (or all of them)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(docs: DataFrame, samples: int = SAMPLES, **dealing: int) -> DataFrame:
    """The columns of the registered query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts, following = ([_unpacked(x) for x in part.column(k).to_pylist()] for k in (1, 4))
                edited = [edited_text(t, f) for t, f in zip(texts, following, strict=True)]
                col = pa.array(edited, pa.large_string())
                sig = np.concatenate([signatures(col.slice(i, j - i), samples) for i, j in tb.blocks(col, BLOCK)])
                own = np.stack([np.frombuffer(x, np.uint16) for x in part.column(3).to_pylist()])
                after = np.stack([np.frombuffer(x, np.uint16) for x in part.column(5).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                        pa.array([x.byteswap().tobytes().hex() for x in own]),
                        pa.array([x.byteswap().tobytes().hex() for x in sig]),
                        pa.array(likeness(own, sig)),
                        pa.array(likeness(own, after)),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    src = with_next(docs, samples, **dealing).select("doc_id", "packed", "n_chars", "sig", "next_packed", "next_sig")
    return src.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
