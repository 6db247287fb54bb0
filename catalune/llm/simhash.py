"""SimHash near-dedup: 64-bit fingerprints of word shingles, exact links within a Hamming radius.

Fingerprints are compared in tiles with numpy exclusive-or and bit counts.
Which tiles meet is decided in three steps that lose no link:

* equal fingerprints are one node, however many documents have them;
* two fingerprints at most ``RADIUS`` bits apart agree on one of RADIUS + 1
  disjoint bit ranges, so nodes meet once per range by their value there;
* values with more than ``TILE`` nodes are dealt into tiles by bit count (and
  a salt), and only tiles whose bit counts differ by at most the radius meet.

A task holds two tiles at most. It returns the spanning links of what it
compared rather than all pairs; ``components`` joins them.

Null and blank texts have no words and fingerprint zero, which links like any
other. Fewer words than a shingle make one shingle. Repeated rows have equal
fingerprints and share a component. Rows with a null id are fingerprinted and
take part in linking, but a component id is the smallest non-null id. Extra
columns are ignored by ``near_duplicates`` and kept by ``drop_near_duplicates``,
which checks links on the shingles themselves and adds what is missing (see
``shinglejoin``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shinglejoin
from . import textblock as tb
from .common import discard, written
from .components import components

RADIUS = 2
NUM, DEN = 4, 5  # least Jaccard similarity of near copies in drop_near_duplicates
TILE = 4096
NEAR = 32  # shifts compared directly before whole tiles are
_LANES = np.uint64(0x0101010101010101)


def fingerprint_block(rows: list[bytes], words: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 fingerprints; a bit is set if set in over half of the shingle hashes."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(rows), np.int64)
    for i, raw in enumerate(rows):
        w = raw.lower().split()
        if not w:
            continue
        if len(w) <= words:
            hashes.append(xxh64_intdigest(b" ".join(w), seed))
            counts[i] = 1
            continue
        join = b" ".join
        shingles = map(join, zip(*(w[k:] for k in range(words)), strict=False))
        hashes += [xxh64_intdigest(s, seed) for s in shingles]
        counts[i] = len(w) - words + 1
    h = np.array(hashes, np.uint64)
    # byte lanes hold up to 255 counts: cut every row into pieces of at most 255 hashes
    pieces = -(-counts // 255)
    owner = np.repeat(np.arange(len(rows)), pieces)
    if not len(owner):
        return np.zeros(len(rows), np.uint64)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(counts) - counts)[owner] + rank * 255
    out = np.zeros(len(rows), np.uint64)
    for bit in range(8):
        lane = np.add.reduceat((h >> np.uint64(bit)) & _LANES, begin)
        parts = lane.view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.zeros((len(rows), 8), np.int64)
        np.add.at(sums, owner, parts)
        for byte in range(8):
            out |= (2 * sums[:, byte] > counts).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, keep: str | None = None) -> DataFrame:
    """(doc_id, fp long) of every row, and the column ``keep`` if named."""
    src = docs.select("doc_id", "text", *([keep] if keep else []))
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long" + (f", {keep} {src.schema[keep].dataType.simpleString()}" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = tb.texts(b, "text")
            for lo, hi in tb.blocks(col):
                data, off = tb.flat(col.slice(lo, hi - lo))
                raw = data.tobytes()
                fp = fingerprint_block([raw[a:e] for a, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], words, seed)
                cols = [b.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols + ([b.column(2).slice(lo, hi - lo)] if keep else []), names=["doc_id", "fp"] + ([keep] if keep else []))

    return src.mapInArrow(run, schema)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (a, b) connect: each node with the smallest of its group."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def close_pairs(fp: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``radius`` bits among equal values of the sorted ``run``.

    Short runs are compared at each shift; longer ones in tiles ordered by bit
    count, skipping tile pairs whose bit counts are further apart than the radius.
    """
    n = len(fp)
    cuts = np.append(np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))), n) if n else np.zeros(1, int)
    size = np.diff(cuts)
    left, right = [], []
    small = np.repeat(size <= NEAR, size)
    for shift in range(1, min(NEAR, int(size.max(initial=1)))):
        i = np.flatnonzero((run[shift:] == run[:-shift]) & small[shift:])
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= radius]
        left.append(i)
        right.append(i + shift)
    for k in np.flatnonzero(size > NEAR):
        own = np.arange(cuts[k], cuts[k + 1])
        ones = np.bitwise_count(fp[own]).astype(np.int64)
        own, ones = own[np.argsort(ones, kind="stable")], np.sort(ones)
        for a in range(0, len(own), 256):
            ta = own[a : a + 256]
            for b in range(a, len(own), 256):
                if ones[b] - ones[min(a + 255, len(own) - 1)] > radius:
                    break
                tb_ = own[b : b + 256]
                i, j = np.nonzero(np.bitwise_count(fp[ta][:, None] ^ fp[tb_][None, :]) <= radius)
                keep = ta[i] != tb_[j]
                left.append(ta[i[keep]])
                right.append(tb_[j[keep]])
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def _ranges(radius: int) -> list[tuple[int, int]]:
    parts = radius + 1
    edges = [64 * k // parts for k in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) spanning links between the distinct fingerprints of ``nodes`` (fp)."""

    def value(a: int, b: int) -> Column:
        return F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))

    ranges = F.array(*(F.struct(F.lit(k).alias("part"), value(a, b).alias("value")) for k, (a, b) in enumerate(_ranges(radius))))
    dealt = nodes.select("fp", F.inline(ranges).alias("part", "value"))
    hot = dealt.groupBy("part", "value").count().where(F.col("count") > tile)
    dealt = dealt.join(hot, ["part", "value"], "left")
    ones = F.bit_count("fp").cast("int")
    salts = F.greatest(F.lit(1), F.ceil(F.col("count") / (tile * 4)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")

    def met(lo: Column, hi: Column, s: Column, t: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), s.alias("s"), t.alias("t"))

    every = F.sequence(F.lit(0), F.col("salts") - 1)
    up = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda d: F.transform(every, lambda s: met(F.col("ones"), F.col("ones") + d, F.when(d == 0, F.least("own", s)).otherwise(F.col("own")), F.when(d == 0, F.greatest("own", s)).otherwise(s)))))
    down = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(radius)), lambda d: F.transform(every, lambda s: met(F.col("ones") - d, F.col("ones"), s, F.col("own")))))
    one = F.array(met(F.lit(-1), F.lit(-1), F.lit(0), F.lit(0)))
    tiles = F.when(F.col("count").isNull(), one).otherwise(F.concat(up, down) if radius else up)
    dealt = dealt.withColumns({"ones": ones, "salts": salts}).withColumn("own", own)
    dealt = dealt.select("part", "value", "fp", F.inline(tiles).alias("lo", "hi", "s", "t"))
    dealt = dealt.select("fp", F.xxhash64("part", "value", "lo", "hi", "s", "t").alias("meet"))
    # two meeting places with one hash only cost comparisons: every pair is verified
    dealt = dealt.repartition("meet").sortWithinPartitions("meet", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_run = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def compare(fp: np.ndarray, meet: np.ndarray) -> pa.RecordBatch:
            i, j = close_pairs(fp, meet, radius)
            a, b = spanning(fp[i].view(np.int64), fp[j].view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            fp = np.concatenate((held_fp, b.column(0).to_numpy().view(np.uint64)))
            meet = np.concatenate((held_run, b.column(1).to_numpy()))
            if not len(fp):
                continue
            cut = int(np.searchsorted(meet, meet[-1], side="left"))
            yield compare(fp[:cut], meet[:cut])
            held_fp, held_run = fp[cut:], meet[cut:]
        yield compare(held_fp, held_run)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _classes(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fp, root) of the fingerprints; root is the same for all that links connect."""
    nodes = written(prints.sparkSession, prints.select("fp").distinct(), "simhash-nodes")
    roots = components(links(nodes, radius, tile)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = written(docs.sparkSession, fingerprints(docs, words), "simhash")
    tied = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(_classes(prints, radius, tile), "fp")
    least = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = tied.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def close_classes(docs: DataFrame, firsts: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) pairs of classes that connect all classes whose fingerprints link. firsts: (key, row), a row of docs (doc_id, row, text) of each class.

    A class meets the least one of its fingerprint, and the least ones of linked
    fingerprints meet: pairs grow with the classes however large a group is.
    """
    prints = fingerprints(docs, keep="row").select("row", "fp")
    own = written(docs.sparkSession, firsts.join(prints, "row").select("key", "fp").distinct(), "simhash-classes")
    least = written(docs.sparkSession, own.groupBy("fp").agg(F.min("key").alias("least")), "simhash-nodes")
    same = own.join(least, "fp").where("least < key").select(F.col("least").alias("a"), F.col("key").alias("b"))
    of = lambda x: least.select(F.col("fp").alias(f"f{x}"), F.col("least").alias(x))
    near = links(least, radius, tile).select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(of("a"), "fa").join(of("b"), "fb")
    pairs = written(docs.sparkSession, same.union(near.select("a", "b")), "simhash-pairs")
    discard(own, least)
    return pairs


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one row of each group: the one of smallest id (null ids last), then of smallest text hash.

    Texts whose fingerprints link in tiles (``links``) are near copies if the
    exact check confirms a Jaccard similarity of ``num / den`` or more of their
    shingle sets. As fingerprints of texts that similar can be many bits apart,
    ``shinglejoin`` then finds the similar pairs that tiles leave unlinked, so
    that groups are whole. Equal rows are copies of each other and one stays.
    """
    spark = docs.sparkSession
    row = F.xxhash64("doc_id", "text")
    own = docs.select("doc_id", "text", row.alias("row"))
    prints = written(spark, shinglejoin.prefixes(own, words, num, den), "shingles")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    firsts = written(spark, prints.groupBy("key").agg(F.min(rank).alias("first"), F.min("n").alias("n")), "shingle-firsts")
    rows = firsts.select("key", F.col("first.row").alias("row"))
    close = close_classes(own, rows.where("n > 0"))
    roots = shinglejoin.classes(own, prints, rows, close, words, num, den).withColumnRenamed("node", "key")
    kept = firsts.join(roots, "key", "left").groupBy(F.coalesce("root", "key")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    kept = written(spark, kept, "shingle-kept")
    discard(prints, firsts)
    out = docs.select(row.alias("row"), F.struct("*").alias("doc")).join(kept, "row", "left_semi")
    return out.groupBy("row").agg(F.first("doc").alias("doc")).select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
