"""Suffix-array dedup: remove every byte of a long string that also starts earlier.

Strings of ``LENGTH`` bytes within a document are compared across the corpus
in byte order of (doc_id, start). All strings whose content matches an earlier
one are found, and the bytes they cover removed.

Sorting every suffix of the corpus in one place does not scale, so suffixes are
first dealt into shards that no match crosses:

1. Every string has an anchor, its leftmost ``GRAM``-byte gram of least hash
   (a function of content alone: equal strings have equal anchors at equal
   offsets). Consecutive strings share anchors, so there is one anchor for a
   few dozen strings. An anchor occurrence comes with the run of strings that
   it anchors and their bytes, its context.
2. Occurrences meet by anchor hash. Those with equal contexts are settled at
   once: all but the earliest are repeats in full, within a task before the
   shuffle and then across tasks. Anchors with one context are done.
3. The earliest occurrences of anchors with several contexts get their bytes
   and are suffix-sorted shard by shard: multikey quicksort on 8-byte
   characters to ``SHALLOW`` bytes; suffixes still tied are ordered by blind
   tries (one comparison with a leader gives the branching byte of each other
   member, level by level). Strings equal to full length form a class, of
   which all but the earliest are repeats.

An anchor with more than ``HOT`` contexts is not sorted in one task's memory:
its strings are dealt by their first, middle and last 8 bytes and sorted by
their bytes on disk, as part of Spark's sort; the result is the same.

Equal contexts in step 2 are those of equal anchor and context hash, 128 bits
together; strings in step 3 compare by their bytes. Texts that share an id are
told apart by 43 bits of a hash.

Null texts are empty. A null id counts as the smallest. Rows of equal id are
one document, as "earlier" is defined on (doc_id, start): equal rows do not
remove each other. Results are per row; extra columns are ignored; empty
tables give empty results; texts shorter than a string lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import written

LENGTH = 100
GRAM = 32
SHALLOW = 32
HOT = 200_000
BLOCK = 1 << 21
SORT_BYTES = 4 << 20
_NO_ID = -(1 << 63)
_TOP = np.uint64(~((1 << 24) - 1) & 0xFFFFFFFFFFFFFFFF)


def _words_at(data: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes at each of the first n positions as little-endian integers."""
    padded = np.zeros(n + 16, np.uint8)
    padded[: min(len(data), n + 8)] = data[: n + 8]
    out = np.empty(n + 8, np.uint64)
    for s in range(8):
        m = (n + 8 - s) // 8
        out[s : s + 8 * m : 8] = padded[s : s + 8 * m].view("<u8")[:m]
    return out[:n]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each position (positions near the end read zeros)."""
    n = len(data)
    w = _words_at(data, n + gram)
    h = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        h ^= w[min(k, gram - 8) : min(k, gram - 8) + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i with a full window."""
    out, size = x, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first string start, number of strings, anchor offset, anchor hash, context hash) of every anchor occurrence.

    Starts are positions within the row. Together the runs hold every start of
    a full string exactly once.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length or n >= 1 << 24 and len(offsets) > 2:
        if n < length:
            return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        raise ValueError("a block of several rows must be shorter than 2**24 bytes")
    pieces = []
    step = (1 << 24) - 4 * length
    h = _gram_hashes(data, gram)
    for lo in range(0, n, step):  # positions within a piece fit 24 bits
        part = h[lo : min(n, lo + step + length)]
        key = (part & _TOP) | np.arange(len(part), dtype=np.uint64)
        if len(part) >= length:
            least = _window_min(key, length - gram + 1)[: len(part) - length + 1][:step]
            pieces.append((least & ~_TOP).astype(np.int64) + lo)
    at = np.concatenate(pieces)  # the anchor of the string at each start
    valid = np.zeros(len(at), bool)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(len(at))
    valid = starts + length <= offsets[1:][row_of[: len(at)]]
    keep = np.flatnonzero(valid)
    a = at[keep]
    new = np.ones(len(keep), bool)
    new[1:] = (a[1:] != a[:-1]) | (keep[1:] != keep[:-1] + 1)
    first = np.flatnonzero(new)
    start = keep[first]
    count = np.diff(np.append(first, len(keep)))
    row = row_of[start]
    anchor = a[first]
    context = tb.span_hashes(data, start, start + count - 1 + length)
    context ^= (anchor - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return row, start - offsets[row], count, anchor - start, h[anchor], context


def repeated(order: np.ndarray, *group: np.ndarray) -> np.ndarray:
    """True where an equal ``group`` has a smaller ``order`` rank (ties in rank are not smaller)."""
    if not len(order):
        return np.zeros(0, bool)
    by = np.lexsort((order, *group))
    o = order[by]
    first = np.ones(len(by), bool)
    first[1:] = np.any([g[by][1:] != g[by][:-1] for g in group], axis=0)
    out = np.zeros(len(by), bool)
    out[by] = o > o[np.flatnonzero(first)][np.cumsum(first) - 1]
    return out


def multikey_quicksort(keys: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, tie) of the rows of ``keys`` (rows, characters) that equal another of their ``tie`` in all characters.

    Three-way partitioning of all segments at once: each round splits every
    segment at the median of three of its characters into less, equal and more;
    the equal part goes on with the next character. Segments of one are done.
    """
    at = np.argsort(tie, kind="stable")
    seg = tie[at]
    depth = np.zeros(len(at), np.int64)
    done_at, done_size = [], []
    while len(at):
        head = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
        size = np.diff(np.append(head, len(at)))
        many = size > 1
        full = many & (depth[head] == keys.shape[1])
        if full.any():
            done_at.append(at[np.repeat(full, size)])
            done_size.append(size[full])
        go = many & ~full
        if not go.any():
            break
        stay = np.repeat(go, size)
        at, depth, size = at[stay], depth[stay], size[go]
        head = np.cumsum(size) - size
        c = keys[at, depth]
        x, y, z = c[head], c[head + size // 2], c[head + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        place = np.zeros(len(at), np.int64)
        base = head.copy()
        number = np.zeros(len(at), np.int64)
        for k, part in enumerate((c < pivot, c == pivot, c > pivot)):
            before = np.cumsum(part) - part
            inside = before - np.repeat(before[head], size)
            place += np.where(part, np.repeat(base, size) + inside, 0)
            base += np.add.reduceat(part, head, dtype=np.int64)
            number[part] = k
        seg = np.empty(len(at), np.int64)
        seg[place] = np.repeat(np.arange(len(head)) * 3, size) + number
        depth[number == 1] += 1
        was, was_depth = at, depth
        at, depth = np.empty_like(was), np.empty_like(was_depth)
        at[place], depth[place] = was, was_depth
    if not done_at:
        none = np.zeros(0, np.int64)
        return none, none
    sizes = np.concatenate(done_size)
    return np.concatenate(done_at), np.repeat(np.arange(len(sizes)), sizes)


def blind_tries(chars: np.ndarray, live: np.ndarray, tie: np.ndarray, out: np.ndarray) -> None:
    """Numbers the classes of equal rows of ``chars`` among the members of each tie, in ``out``.

    One comparison with a leader gives the branching byte of each other member;
    members that branch at the same byte to the same value go on together.
    """
    fresh = 0
    while len(live):
        by = np.argsort(tie, kind="stable")
        live, tie = live[by], tie[by]
        new = np.concatenate(([True], tie[1:] != tie[:-1]))
        head = np.flatnonzero(new)
        leader = np.repeat(live[head], np.diff(np.append(head, len(live))))
        differs = chars[live] != chars[leader]
        branch = np.where(differs.any(1), differs.argmax(1), -1)
        same = branch < 0  # equal to the leader in full: the leader's class
        number = np.cumsum(new) - 1
        out[live[same]] = number[same] + fresh
        fresh += len(head)
        rest = np.flatnonzero(~same)
        edge = (number[rest] * 256 + branch[rest]) * 256 + chars[live[rest], branch[rest]]
        live, tie = live[rest], np.unique(edge, return_inverse=True)[1]


def equal_classes(chars: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Class numbers of the rows of ``chars`` (rows, length) within their groups; rows alone may get -1 instead of a class.

    Deep-shallow sorting: multikey quicksort on 8-byte characters to
    ``shallow`` bytes, then blind tries on what is still tied.
    """
    out = np.full(len(chars), -1, np.int64)
    tie = np.unique(group, return_inverse=True)[1]
    keys = np.ascontiguousarray(chars[:, :shallow]).view(">u8").astype(np.uint64)
    live, tie = multikey_quicksort(keys, tie)
    blind_tries(chars[:, shallow:length], live, tie, out)
    return out


def _pack(start, count, offset, mark):
    """start (34 bits), strings (8), anchor offset (8), the low bits of the text's mark (13) in one integer."""
    return (start << 29) | (count << 21) | (offset << 13) | (mark & 0x1FFF)


def _unpack(meta: np.ndarray) -> tuple[np.ndarray, ...]:
    return meta >> 29, (meta >> 21) & 0xFF, (meta >> 13) & 0xFF


def _mark(tag, meta):
    return (tag.astype(np.int64) >> 1 << 13) | (meta & 0x1FFF)


_TUPLES = "tag int, anchor long, context long, id long, meta long"
_NAMES = ["tag", "anchor", "context", "id", "meta"]
_GONE = 1  # the low bit of a tag; the others are the high bits of the text's mark


def _rows(docs: DataFrame) -> DataFrame:
    """(id, mark, text): id never null; mark (43 bits) tells texts of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).bitwiseAND(F.lit((1 << 43) - 1)).alias("mark"), text.alias("text"))


def _tuple_batch(tag: np.ndarray, anchor: np.ndarray, context: np.ndarray, ids: np.ndarray, meta: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tag.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids, pa.int64()), pa.array(meta, pa.int64())], names=_NAMES)


def _settled(anchor: np.ndarray, context: np.ndarray, ids: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Which occurrences repeat an earlier one of equal context among those given."""
    rank = np.lexsort((meta >> 29, ids))
    order = np.empty(len(ids), np.int64)
    order[rank] = np.cumsum(np.concatenate(([False], (ids[rank][1:] != ids[rank][:-1]) | (meta[rank][1:] >> 29 != meta[rank][:-1] >> 29)))) if len(ids) else 0
    return repeated(order, context, anchor)


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All anchor occurrences; those that repeat within a block of texts are marked gone already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = tb.texts(b, "text")
            ids, marks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for lo, hi in tb.blocks(col, BLOCK):
                data, off = tb.flat(col.slice(lo, hi - lo))
                row, start, count, offset, anchor, context = anchors(data, off, length, gram)
                own, mark = ids[lo:hi][row], marks[lo:hi][row]
                meta = _pack(start, count, offset, mark)
                gone = _settled(anchor, context, own, meta)
                anchor = np.where(gone, tb.mix(context ^ own.view(np.uint64)), anchor)  # deal what is settled evenly
                yield _tuple_batch((mark >> 13 << 1) | gone, anchor, context, own, meta)

    return _rows(docs).select("id", "mark", "text").mapInArrow(run, _TUPLES)


def settle(tuples: DataFrame) -> DataFrame:
    """Across blocks: repeats become gone; the earliest of each context stays open if its anchor has several.

    Rows are dealt by anchor and sorted; the pass holds one row of the current
    anchor, however many it has.
    """
    dealt = tuples.repartition("anchor").sortWithinPartitions("anchor", "context", "id", "meta")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (anchor, context, id, start) of the current context's first row
        held = None  # the first open row of the current anchor while its context is the only one
        for b in batches:
            if not b.num_rows:
                continue
            tag, anchor, context, ids, meta = (b.column(i).to_numpy() for i in range(5))
            passed = (tag & _GONE) == _GONE
            opened = np.flatnonzero(~passed)
            g, a, c, i, m = tag[opened], anchor[opened], context[opened], ids[opened], meta[opened]
            if not len(a):
                yield _tuple_batch(tag, anchor, context, ids, meta)
                continue
            new_a = np.ones(len(a), bool)
            new_c = np.ones(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new_c[1:] = new_a[1:] | (c[1:] != c[:-1])
            if last is not None:
                new_a[0] = a[0] != last[0]
                new_c[0] = new_a[0] or c[0] != last[1]
            # the first row of each context, carried over the batch's edge
            at = np.flatnonzero(new_c)
            group = np.cumsum(new_c)
            fid = np.concatenate(([last[2] if last else 0], i[at]))[group]
            fst = np.concatenate(([last[3] if last else 0], m[at] >> 29))[group]
            gone = ~new_c & ((i != fid) | (m >> 29 != fst))
            # open rows: heads of contexts; an anchor's first head waits for a second
            heads = at
            first_of_anchor = new_a[heads]
            more = np.zeros(len(heads), bool)
            more[:-1] = ~first_of_anchor[1:]
            emit = heads[~first_of_anchor | more]
            parts = [_tuple_batch(tag[passed], anchor[passed], context[passed], ids[passed], meta[passed]), _tuple_batch(g[gone] | _GONE, a[gone], c[gone], i[gone], m[gone]), _tuple_batch(g[emit], a[emit], c[emit], i[emit], m[emit])]
            if held is not None and len(heads) and not first_of_anchor[0]:
                parts.append(_tuple_batch(*(np.array([v]) for v in held)))
                held = None
            elif held is not None and len(heads):
                held = None
            if len(heads) and first_of_anchor[-1]:
                k = heads[-1]
                held = (g[k], a[k], c[k], i[k], m[k])
            last = (a[-1], c[-1], fid[-1], fst[-1])
            yield from (p for p in parts if p.num_rows)

    return dealt.mapInArrow(run, _TUPLES)


def _text_key(mark) -> Column:
    return F.xxhash64("id", mark)


def _mark_column() -> Column:
    return F.shiftleft(F.shiftright("tag", 1).cast("long"), 13).bitwiseOR(F.col("meta").bitwiseAND(F.lit(0x1FFF)))


def contexts(rows: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """(anchor, id, tag, meta, bytes) of open occurrences, read from the texts."""
    wanted = opened.groupBy(_text_key(_mark_column()).alias("key")).agg(F.collect_list(F.struct("anchor", "tag", "meta")).alias("spots"))
    joined = rows.join(wanted, "key").select("id", "text", "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                ids, raws = [], []
                flat = part.column(2).flatten()
                of = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy())
                texts = [t.encode() for t in part.column(1).to_pylist()]
                own = part.column(0).to_pylist()
                meta = flat.field("meta").to_numpy()
                start, count, _ = _unpack(meta)
                for row, at, end in zip(of.tolist(), start.tolist(), (start + count - 1 + length).tolist(), strict=True):
                    ids.append(own[row])
                    raws.append(texts[row][at:end])
                yield pa.RecordBatch.from_arrays([flat.field("anchor"), pa.array(ids, pa.int64()), flat.field("tag"), flat.field("meta"), pa.array(raws, pa.binary())], names=["anchor", "id", "tag", "meta", "bytes"])

    return joined.mapInArrow(run, "anchor long, id long, tag int, meta long, bytes binary")


def sort_shard(anchor: np.ndarray, ids: np.ndarray, tag: np.ndarray, meta: np.ndarray, raw: list[bytes], length: int, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, mark, first byte, end byte) of the repeated strings of whole anchors, merged where they overlap."""
    start, count, offset = _unpack(meta)
    mark = _mark(tag, meta)
    size = np.array([len(x) for x in raw], np.int64)
    base = np.cumsum(size) - size
    data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
    owner = np.repeat(np.arange(len(raw)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = base[owner] + k
    _, number = np.unique(anchor, return_inverse=True)
    group = number[owner] * 512 + (offset[owner] - k)  # equal strings have their anchor at one offset
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    found = np.zeros(len(owner), bool)
    # bounded pieces: strings of one anchor offset stay together
    order = np.argsort(group, kind="stable")
    limit = max(1, SORT_BYTES * 4 // length)
    edges = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1])))
    edges = np.append(edges, len(order))
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + limit, side="right")) - 1)
        own = order[edges[a] : edges[b]]
        cls = equal_classes(view[place[own]], group[own], length, shallow)
        tied = np.flatnonzero(cls >= 0)
        if len(tied):
            w = own[tied]
            wid, ws = ids[owner[w]], start[owner[w]] + k[w]
            rank = np.lexsort((ws, wid))
            value = np.empty(len(w), np.int64)
            changes = (wid[rank][1:] != wid[rank][:-1]) | (ws[rank][1:] != ws[rank][:-1])
            value[rank] = np.concatenate(([0], np.cumsum(changes)))
            found[w[repeated(value, cls[tied])]] = True
        a = b
    hit = np.flatnonzero(found)
    if not len(hit):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.ones(len(hit), bool)
    new[1:] = (owner[hit][1:] != owner[hit][:-1]) | (hit[1:] != hit[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(hit)) - 1
    o = owner[hit[head]]
    return ids[o], mark[o], start[o] + k[hit[head]], start[o] + k[hit[tail]] + length


def sort_shards(found: DataFrame, length: int, shallow: int) -> DataFrame:
    """(id, mark, first, end) of repeated strings among the contexts."""
    dealt = found.repartition("anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_held = 0

        def flush(t: pa.Table) -> pa.RecordBatch:
            got = sort_shard(*(t.column(k).to_numpy() for k in range(4)), t.column(4).to_pylist(), length, shallow)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["id", "mark", "first", "end"])

        for b in batches:
            for a in range(0, b.num_rows, 4096):
                part = b.slice(a, 4096)
                held.append(part)
                bytes_held += part.num_rows * 2 * length
                if bytes_held >= SORT_BYTES:
                    t = pa.Table.from_batches(held).combine_chunks()
                    anchor = t.column(0).to_numpy()
                    cut = int(np.searchsorted(anchor, anchor[-1], side="left"))
                    if cut:  # the last anchor may go on
                        yield flush(t.slice(0, cut))
                        held = t.slice(cut).to_batches()
                        bytes_held = (len(anchor) - cut) * 2 * length
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "id long, mark long, first long, end long")


def sort_strings(found: DataFrame, length: int) -> DataFrame:
    """(id, mark, first, end) of repeated strings, for anchors with too many contexts to sort in a task's memory."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                start, count, _ = _unpack(part.column(3).to_numpy())
                owner = np.repeat(np.arange(part.num_rows), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                raw = part.column(4).to_pylist()
                strings = [raw[o][j : j + length] for o, j in zip(owner.tolist(), k.tolist(), strict=True)]
                mark = _mark(part.column(2).to_numpy(), part.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(strings, pa.binary()), pa.array(part.column(1).to_numpy()[owner]), pa.array(mark[owner]), pa.array(start[owner] + k)], names=["bytes", "id", "mark", "first"])

    strings = found.mapInArrow(split, "bytes binary, id long, mark long, first long")
    middle = length // 2 - 4
    ends = [F.substring("bytes", at, 8) for at in (1, middle + 1, length - 7)]
    dealt = strings.repartition(*ends).sortWithinPartitions("bytes", "id", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bytes, id and start of the current class's first string
        for b in batches:
            keep = []
            for n, (raw, i, at) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if last is None or raw != last[0]:
                    last = raw, i, at
                elif (i, at) != last[1:]:
                    keep.append(n)
            got = b.take(pa.array(keep, pa.int64()))
            first = got.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([got.column(1), got.column(2), got.column(3), pa.array(first + length)], names=["id", "mark", "first", "end"])

    return dealt.mapInArrow(run, "id long, mark long, first long, end long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shallow: int = SHALLOW, hot: int = HOT) -> DataFrame:
    """(key, id, mark, text, spans array<struct<first,end>>) of every row; spans may overlap."""
    spark = docs.sparkSession
    if not 8 <= gram <= length or length > 255 or shallow % 8 or shallow > length:
        raise ValueError("need 8 <= gram <= length <= 255 and shallow a multiple of 8 up to length")
    settled = written(spark, settle(anchor_rows(docs, length, gram)), "repeats")
    start = F.shiftright("meta", 29)
    count = F.shiftright("meta", 21).bitwiseAND(F.lit(0xFF))
    is_gone = F.col("tag").bitwiseAND(F.lit(_GONE)) == _GONE
    spans = settled.where(is_gone).select("id", _mark_column().alias("mark"), start.alias("first"), (start + count - 1 + length).alias("end"))
    opened = settled.where(~is_gone)
    rows = _rows(docs).select(_text_key("mark").alias("key"), "id", "mark", "text").repartition("key")
    many = opened.groupBy("anchor").count().where(F.col("count") > hot).select("anchor")
    spans = spans.unionByName(sort_shards(contexts(rows, opened.join(many, "anchor", "left_anti"), length), length, shallow))
    if many.limit(1).count():
        spans = spans.unionByName(sort_strings(contexts(rows, opened.join(many, "anchor", "left_semi"), length), length))
    listed = spans.groupBy(_text_key("mark").alias("key")).agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    return rows.join(listed, "key", "left")


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs)."""
    if not spans:
        return raw, 0, 0
    kept, at, runs, removed = [], 0, 0, 0
    upto = -1
    for a, e in sorted(spans):
        if a > upto or upto < 0:
            kept.append(raw[at:a])
            runs += 1
            removed += e - a
            upto = at = e
        elif e > upto:
            removed += e - upto
            upto = at = e
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def dedup_substrings(docs: DataFrame, digest: bool = True, **settings: int) -> DataFrame:
    """The columns of the registered query, or with ``digest`` off (doc_id, kept binary, n_removed, n_spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                ids, spans = part.column(0), part.column(2)
                total, got = [], []
                for text, own in zip(part.column(1).to_pylist(), spans, strict=True):
                    raw = text.encode()
                    pairs = [] if not own.is_valid else list(zip(own.values.field("first").to_pylist(), own.values.field("end").to_pylist(), strict=True))
                    total.append(len(raw))
                    got.append(cut(raw, pairs))
                ids = pa.array([None if i == _NO_ID else i for i in ids.to_pylist()], pa.int64())
                removed, runs = pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())
                if digest:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), removed, runs, pa.array([hashlib.sha256(g[0]).hexdigest() for g in got])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array([g[0] for g in got], pa.binary()), removed, runs], names=["doc_id", "kept", "n_removed", "n_spans"])

    src = repeated_spans(docs, **settings).select("id", "text", "spans")
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digest else "doc_id long, kept binary, n_removed long, n_spans long")
