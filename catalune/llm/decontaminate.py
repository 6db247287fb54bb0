"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a block of whole documents (at most ``textblock.BLOCK_BYTES``, or
one longer document). Its words become ranks in the test vocabulary; the
suffixes that can begin a match (enough following words in the vocabulary, and
a first word pair that the tests have) are sorted into a sparse word-level
suffix array, to the depth of a window. Every test suffix is binary-searched in
it, which gives the range of training suffixes that share its first ``window``
words. What is found is compared word for word, and matches that go on from
word to word in document and item are joined: the longest verbatim matches,
with their places in both.

The test side travels to executors in slices of at most ``slice_words`` words,
one after the other, so its size is bounded however long the benchmark is;
usually there is one slice.

Words are runs of ASCII letters and digits and of bytes of longer code points,
with A-Z in lower case. Items of fewer words than a window, but not none, are
one window. Null texts have no words. Null item ids mark hits but are not
listed. Repeated items count once; empty tables give no hits. Extra columns of
``docs`` are kept by ``remove_contaminated`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb

WINDOW = 10
SLICE_WORDS = 1_000_000


@dataclass
class Words:
    """The words of one block of texts."""

    hashes: np.ndarray
    bounds: np.ndarray  # of the rows, in words
    data: bytes  # in lower case
    starts: np.ndarray
    ends: np.ndarray

    def at(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]]


def words(col: pa.Array) -> Words:
    raw, off = tb.flat(col)
    data = tb.LOWER[raw]
    starts, ends = tb.spans(tb.WORD[data], off)
    return Words(tb.span_hashes(data, starts, ends), np.searchsorted(starts, off), data.tobytes(), starts, ends)


@dataclass
class TestSet:
    """Distinct windows of the items of one slice, by window length."""

    vocabulary: np.ndarray  # sorted word hashes
    spelling: list[bytes]  # of the vocabulary
    maybe: np.ndarray  # by the low 16 bits of a hash: in the vocabulary perhaps
    pairs: np.ndarray  # by a hash of the first two ranks: begins a window perhaps
    suffixes: dict[int, np.ndarray]  # length -> sorted packed windows
    owners: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> (bounds, item numbers, first words in the items)
    names: list[str | None]


def _pack(ranks: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Fixed-width big-endian keys: they sort as the word sequences do."""
    rows = np.empty((len(at), length), ">u4")
    for k in range(length):
        rows[:, k] = ranks[at + k]
    return rows.reshape(-1).view(f"S{4 * length}") if len(at) else np.zeros(0, f"S{4 * length}")


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) * 40503 + b.astype(np.int64) * 1_000_003) & 0xFFFFF


def index_items(names: list, texts_: list, window: int = WINDOW) -> TestSet:
    col = pa.array([t or "" for t in texts_], pa.large_string())
    block = words(col)
    h, bounds = block.hashes, block.bounds
    count = np.diff(bounds)
    vocabulary, example = np.unique(h, return_index=True)
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    ranks = np.searchsorted(vocabulary, h) + 1
    pairs = np.zeros(1 << 20, bool)
    suffixes, owners = {}, {}
    sizes = np.minimum(count, window)
    item_of = np.repeat(np.arange(len(count)), count)
    for length in np.unique(sizes[sizes > 0]).tolist():
        if length < window:
            rows = np.flatnonzero(sizes == length)
            at, item = bounds[rows], rows
        else:
            i = np.arange(len(h))
            ok = i + window <= bounds[1:][item_of] if len(h) else np.zeros(0, bool)
            at, item = i[ok], item_of[ok]
        key = _pack(ranks, at, length)
        suffixes[length], inv = np.unique(key, return_inverse=True)
        order = np.lexsort((item, inv))
        owners[length] = (np.searchsorted(inv[order], np.arange(len(suffixes[length]) + 1)), item[order], (at - bounds[item])[order])
        if length > 1:
            pairs[_pair_slot(ranks[at], ranks[at + 1])] = True
    return TestSet(vocabulary, [block.at(k) for k in example.tolist()], maybe, pairs, suffixes, owners, names)


def search_shard(block: Words, tests: TestSet) -> tuple[np.ndarray, ...]:
    """The longest matches of a shard, by row and place: (row, first word, end word, item number, first word in the item)."""
    h, bounds = block.hashes, block.bounds
    none = np.zeros(0, np.int64)
    n = len(h)
    if n == 0 or not len(tests.vocabulary):
        return none, none, none, none, none
    ranks = np.zeros(n, np.int64)
    likely = np.flatnonzero(tests.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(tests.vocabulary, h[likely]), len(tests.vocabulary) - 1)
    same = tests.vocabulary[at] == h[likely]
    ranks[likely[same]] = at[same] + 1
    starts, ends = tb.spans(ranks > 0, bounds)
    room = np.zeros(n, np.int64)  # words left in the run of known words
    if len(starts):
        size = ends - starts
        inside = np.repeat(ends, size)
        where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        room[where] = inside - where
    found_at = []
    for length, suffixes in tests.suffixes.items():
        at = np.flatnonzero(room >= length)
        if length > 1:
            at = at[tests.pairs[_pair_slot(ranks[at], ranks[at + 1])]]
        if not len(at):
            continue
        key = _pack(ranks, at, length)
        order = np.argsort(key, kind="stable")  # the shard's suffix array, to the depth of a window
        sorted_key = key[order]
        lo = np.searchsorted(sorted_key, suffixes, side="left")
        hi = np.searchsorted(sorted_key, suffixes, side="right")
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        size = (hi - lo)[found]
        spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[found], size)
        where, test = at[order[spot]], np.repeat(found, size)
        # ranks go by hash: what they match by is compared word for word
        touched = np.unique(where[:, None] + np.arange(length))
        differ = [k for k in touched.tolist() if block.at(k) != tests.spelling[ranks[k] - 1]]
        if differ:
            good = ~np.isin(where[:, None] + np.arange(length), differ).any(1)
            where, test = where[good], test[good]
        b, items, places = tests.owners[length]
        size = b[test + 1] - b[test]
        spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(b[test], size)
        found_at.append((np.repeat(where, size), items[spot], places[spot], np.full(len(spot), length)))
    if not found_at:
        return none, none, none, none, none
    where, item, place, length = (np.concatenate(x) for x in zip(*found_at, strict=True))
    row = np.searchsorted(bounds, where, side="right") - 1
    by = np.lexsort((where, place - where, item, row))
    where, item, place, length, row = where[by], item[by], place[by], length[by], row[by]
    new = np.ones(len(by), bool)  # matches of one item that go on from word to word are one
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(place - where) != 0) | (np.diff(where) != 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(by)) - 1
    base = bounds[row[head]]
    got = row[head], where[head] - base, where[tail] + length[tail] - base, item[head], place[head]
    by = np.lexsort((got[2], got[1], got[0]))
    return tuple(x[by] for x in got)


def _slices(benchmark: DataFrame, slice_words: int) -> Iterator[tuple[list, list]]:
    """Items in lists of at most ``slice_words`` words (or one longer item), read as a stream."""
    names, texts_, held = [], [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), "text").distinct().toLocalIterator():
        size = len(text or "") // 2 + 1
        if names and held + size > slice_words:
            yield names, texts_
            names, texts_, held = [], [], 0
        names.append(name)
        texts_.append(text)
        held += size
    yield names, texts_


def _indexed(benchmark: DataFrame, window: int, slice_words: int) -> Iterator:
    """A broadcast test set for each slice."""
    for names, texts_ in _slices(benchmark, slice_words):
        yield benchmark.sparkSession.sparkContext.broadcast(index_items(names, texts_, window))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, n_words, matches array<struct<first,end,item,at>>) of every row.

    ``matches`` holds the longest verbatim matches: words first to end of the
    document are those of the item from its word ``at`` on. They may overlap.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words long, matches array<struct<first:long,end:long,item:string,at:long>>"
    out = docs.select("doc_id", "text")

    def search(shared, earlier: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for b in batches:
                col = tb.texts(b, "text")
                for lo, hi in tb.blocks(col):
                    block = words(col.slice(lo, hi - lo))
                    row, a, e, item, at = search_shard(block, tests)
                    match = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(e, pa.int64()), pa.array([tests.names[i] for i in item.tolist()], pa.string()), pa.array(at, pa.int64())], names=["first", "end", "item", "at"])
                    matches = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32()), match)
                    if earlier:
                        was = b.column(3).slice(lo, hi - lo)
                        matches = pa.array([x + y for x, y in zip(was.to_pylist(), matches.to_pylist(), strict=True)], matches.type)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(block.bounds), pa.int64()), matches], names=["doc_id", "text", "n_words", "matches"])

        return run

    for k, shared in enumerate(_indexed(benchmark, window, slice_words)):
        out = out.mapInArrow(search(shared, k > 0), schema)
    return out.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query from ``find_contamination``."""
    # matches may overlap: count covered words once
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["first"], m["end"])))
    covered = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["first"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")),
        lambda acc: acc["n"],
    )
    named = F.array_sort(F.array_distinct(F.array_compact("matches.item")))
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.size("matches") == 0, F.lit(0).cast("long")).otherwise(covered).alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", named).cast("binary"), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; each row is judged on its own text."""

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = tb.texts(b, "text")
                for lo, hi in tb.blocks(col):
                    keep = np.ones(hi - lo, bool)
                    keep[search_shard(words(col.slice(lo, hi - lo)), shared.value)[0]] = False
                    yield b.slice(lo, hi - lo).filter(pa.array(keep))

        return run

    out = docs
    for shared in _indexed(benchmark, window, slice_words):
        out = out.mapInArrow(clean(shared), docs.schema)
    return out
