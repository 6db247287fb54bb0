"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has its characters as nodes and, as edges, all pieces of
the model that match there (``FALLBACK`` edges spell a character the model has
no piece for in byte pieces). An edge's weight is ``alpha`` times the log of
the piece's probability, taken as falling with its rank (Zipf-Mandelbrot).
Forward filtering sums the weights of all segmentations up to each node;
backward sampling draws from the end one incoming edge at a time in proportion
to the filtered weights, so every segmentation is drawn with its exact
probability under the model.

Draws are a hash of the row key and the character's position: the sampled
segmentation depends on the row alone, not on batches, partitions or retries.

Texts are cut where no piece can span (before a space, at character pairs that
no piece holds), which factorises the lattice. Filtered lattices of distinct
stretches are kept for reuse within a worker, up to a bound.

A dummy space precedes the text and spaces become the model's space mark, as
the model's own normaliser does; runs of them are in the lattice with the pieces
that the model has for them. A literal
space mark in the text is spelt in bytes, so decoding restores every text.
Null texts are empty; an empty text has no pieces. Repeated rows get equal
segmentations; a null key draws as key 0. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblock as tb

ALPHA = 1.0
SEED = 20240229
KEPT_NODES = 600_000
BLOCK = 1 << 19
FALLBACK = -16.0
_MARK, _LITERAL = 0x2581, 0x110000
_loaded: dict[tuple, Lattice] = {}


class Vocabulary:
    """Pieces of a SentencePiece model: text, bytes, log weight."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bytes: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        self.text: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
                # a mark after a letter, within a piece, would cross the cuts before spaces
                if "▁" not in piece.lstrip("▁"):
                    self.text[piece] = i
        ranks = np.array([-sp.get_score(i) for i in range(n)])
        usable = np.array(sorted(self.text.values()))
        p = 1 / (np.clip(ranks, 0, 1e6) + 10)
        self.weight = np.log(p / p[usable].sum())
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.length)))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)


class Lattice:
    """Piece trie and the filtered lattices of the stretches seen so far."""

    def __init__(self, path: str, alpha: float = ALPHA):
        self.vocab = v = Vocabulary(path)
        nodes: dict[tuple[int, int], int] = {}
        terminal = [-1]
        pairs = set()
        for piece, i in v.text.items():
            at = 0
            codes = [ord(c) for c in piece]
            pairs.update(zip(codes[:-1], codes[1:], strict=True))
            for c in codes:
                key = (at, c)
                if key not in nodes:
                    nodes[key] = len(terminal)
                    terminal.append(-1)
                at = nodes[key]
            terminal[at] = i
        self.terminal = np.array(terminal)
        self.bits = 20
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_node = np.zeros(size, np.int64)
        self.probes = 0
        for (a, c), b in nodes.items():
            key = a * 0x110001 + c
            k, tries = self._slot(key), 1
            while self.slot_key[k] >= 0:
                k, tries = (k + 1) & (size - 1), tries + 1
            self.slot_key[k], self.slot_node[k] = key, b
            self.probes = max(self.probes, tries)
        self.pair_table = np.zeros(1 << 22, bool)
        self.pair_table[self._pair(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))] = True
        self.alpha = alpha
        self.reset()

    def _slot(self, key):
        if isinstance(key, int):
            return ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) * 0x9E3779B1 + b.astype(np.int64) * 0x85EBCA6B >> 7) & 0x3FFFFF

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of stretches
        self.known_at = np.zeros(0, np.int64)  # their first node
        self.node_edge = np.zeros(1, np.int64)  # node -> first incoming edge
        self.edge_size = np.zeros(0, np.uint8)  # characters
        self.edge_piece = np.zeros(0, np.int32)  # piece, or -1: bytes
        self.edge_upto = np.zeros(0, np.float32)  # cumulative share within the node

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Child nodes, 0 where there is none."""
        key = node * 0x110001 + code
        slot = self._slot(key)
        out = np.zeros(len(key), np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            held = self.slot_key[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.slot_node[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def stretches(self, codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
        """Starts of the stretches that no piece crosses; codes hold marks for spaces."""
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.pair_table[self._pair(codes[:-1], codes[1:])] | ((codes[1:] == _MARK) & (codes[:-1] != _MARK))
        cut[text_starts[text_starts < len(codes)]] = True
        return np.flatnonzero(cut)

    def filter(self, codes: np.ndarray, first: np.ndarray) -> None:
        """Add the filtered lattices of new stretches (their codes one after another) to the tables."""
        n = len(codes)
        size = np.diff(np.append(first, n))
        end = np.repeat(first + size, size)
        pos = np.arange(n)
        node = np.zeros(n, np.int64)
        starts, ends, pieces, weights = [], [], [], []
        length = 0
        single = np.zeros(n, bool)
        while len(pos):
            node = self.step(node, codes[pos + length])
            live = node > 0
            pos, node = pos[live], node[live]
            length += 1
            t = self.terminal[node]
            ok = t >= 0
            if length == 1:
                single[pos[ok]] = True
            starts.append(pos[ok])
            ends.append(pos[ok] + length)
            pieces.append(t[ok])
            weights.append(self.alpha * self.vocab.weight[t[ok]])
            more = pos + length < end[pos]
            pos, node = pos[more], node[more]
        lone = np.flatnonzero(~single)
        starts.append(lone)
        ends.append(lone + 1)
        pieces.append(np.full(len(lone), -1))
        weights.append(np.full(len(lone), self.alpha * FALLBACK))
        starts, ends, pieces, weights = (np.concatenate(x) for x in (starts, ends, pieces, weights))
        # node of the character that an edge ends with; edges of one node together, nodes by depth
        last = ends - 1
        depth = (np.arange(n) - np.repeat(first, size))[last]
        order = np.lexsort((starts, last, depth))
        starts, last, pieces, weights, depth = starts[order], last[order], pieces[order], weights[order], depth[order]
        is_first = starts == np.repeat(first, size)[last]
        log_sum = np.zeros(n)  # forward weight at the node after each character
        share = np.empty(len(starts))
        levels = np.searchsorted(depth, np.arange(int(depth.max(initial=-1)) + 2))
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            w = weights[a:b] + np.where(is_first[a:b], 0.0, log_sum[starts[a:b] - 1])
            at = np.flatnonzero(np.concatenate(([True], last[a + 1 : b] != last[a : b - 1])))
            top = np.maximum.reduceat(w, at)
            group = np.repeat(np.arange(len(at)), np.diff(np.append(at, b - a)))
            e = np.exp(w - top[group])
            total = np.add.reduceat(e, at)
            log_sum[last[a:b][at]] = top + np.log(total)
            share[a:b] = e / total[group]
        order = np.lexsort((starts, last))
        last, share = last[order], share[order]
        per_node = np.bincount(last, minlength=n)
        running = np.cumsum(share)
        begin = np.cumsum(per_node) - per_node
        upto = running - np.repeat(running[begin] - share[begin], per_node)
        upto[begin + per_node - 1] = 2.0  # the last edge takes what rounding leaves
        base = len(self.edge_upto)
        self.edge_size = np.concatenate((self.edge_size, (last + 1 - starts[order]).astype(np.uint8)))
        self.edge_piece = np.concatenate((self.edge_piece, pieces[order].astype(np.int32)))
        self.edge_upto = np.concatenate((self.edge_upto, upto.astype(np.float32)))
        self.node_edge = np.concatenate((self.node_edge[:-1], base + begin, [base + len(upto)]))

    def sample(self, col: pa.Array, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, row bounds) of one sampled segmentation of each text."""
        rows = len(col)
        values = col.to_pylist()
        joined = np.frombuffer("".join(" " + t if t else "" for t in values).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) + 1 if t else 0 for t in values], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        n = len(joined)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        codes = np.where(joined == 0x20, _MARK, np.where(joined == _MARK, _LITERAL, joined))
        first = self.stretches(codes, offsets[:-1][sizes > 0])
        size = np.diff(np.append(first, n))
        h = tb.span_hashes(codes, first, first + size)
        uniq, where, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.node_edge) > KEPT_NODES:
            self.reset()
        at = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        fresh = self.known[at] != uniq if len(self.known) else np.ones(len(uniq), bool)
        if fresh.any():
            w = where[fresh]
            own = size[w]
            begin = np.cumsum(own) - own
            base = len(self.node_edge) - 1
            self.filter(codes[np.repeat(first[w] - begin, own) + np.arange(own.sum())], begin)
            known = np.concatenate((self.known, uniq[fresh]))
            order = np.argsort(known)
            self.known_at = np.concatenate((self.known_at, base + begin))[order]
            self.known = known[order]
            at = np.searchsorted(self.known, uniq)
        home = self.known_at[at][inv]  # first node of each stretch
        row = tb.rows_of(first, offsets)
        stream = tb.mix(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[row]
        piece_at = np.full(n, -2, np.int64)
        end = size.copy()  # characters of the stretch not yet spelt
        live = np.arange(len(first))
        within = first - offsets[row]
        while len(live):
            left = end[live]
            node = home[live] + left - 1
            x = stream[live] + (within[live] + left).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
            u = (tb.mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.node_edge[node]
            todo = np.flatnonzero(self.edge_upto[edge] <= u)
            while len(todo):
                edge[todo] += 1
                todo = todo[self.edge_upto[edge[todo]] <= u[todo]]
            left = left - self.edge_size[edge].astype(np.int64)
            piece_at[first[live] + left] = self.edge_piece[edge]
            end[live] = left
            live = live[left > 0]
        spots = np.flatnonzero(piece_at > -2)
        ids = piece_at[spots]
        bounds = np.searchsorted(spots, offsets)
        spelt = np.flatnonzero(ids < 0)
        if len(spelt):
            raw = [chr(c).encode() for c in joined[spots[spelt]].tolist()]
            reps = np.ones(len(ids), np.int64)
            reps[spelt] = [len(b) for b in raw]
            moved = np.concatenate(([0], np.cumsum(reps)))
            ids = np.repeat(ids, reps)
            for k, b in zip(moved[spelt].tolist(), raw, strict=True):
                ids[k : k + len(b)] = self.vocab.byte_ids[list(b)]
            bounds = moved[bounds]
        return ids.astype(np.int32), bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, row offsets) of piece rows, without the dummy space."""
        v = self.vocab
        size = v.length[ids]
        begin = np.cumsum(size) - size
        data = v.flat[np.repeat(v.offset[ids] - begin, size) + np.arange(size.sum())]
        off = np.concatenate((begin, [len(data)]))[bounds]
        some = off[1:] > off[:-1]
        keep = np.ones(len(data), bool)
        keep[off[:-1][some]] = False
        return data[keep], off - np.concatenate(([0], np.cumsum(some)))


def lattice(path: str, alpha: float = ALPHA) -> Lattice:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattice(path, alpha)
    return _loaded[path, alpha]


def _keys(ids: pa.Array) -> np.ndarray:
    if pa.types.is_integer(ids.type):
        return ids.cast(pa.int64()).fill_null(0).to_numpy().view(np.uint64)
    return np.array([int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "little") if x is not None else 0 for x in ids.to_pylist()], np.uint64)


def encode(docs: DataFrame, model_path: str, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, pieces array<int>) of every row; with ``digest`` counts and checksums instead.

    The digest also decodes every row: (key, n_chars, n_pieces, pieces_sha256
    over little-endian 32-bit ids, decoded_sha256, lossless).
    """
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path, alpha)
        for b in batches:
            col = tb.texts(b, "text")
            for lo, hi in tb.blocks(col, BLOCK):
                part, own = col.slice(lo, hi - lo), b.column(0).slice(lo, hi - lo)
                ids, bounds = model.sample(part, _keys(own), seed)
                if not digest:
                    yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], names=["doc_id", "pieces"])
                    continue
                data, off = model.decode(ids, bounds)
                raw, was = tb.flat(part)
                raw_bytes, back, spelt = raw.tobytes(), data.tobytes(), ids.tobytes()
                spots = list(zip(off[:-1].tolist(), off[1:].tolist(), was[:-1].tolist(), was[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        own,
                        pa.array([len(t) for t in part.to_pylist()], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([hashlib.sha256(spelt[4 * p : 4 * q]).hexdigest() for *_, p, q in spots]),
                        pa.array([hashlib.sha256(back[a:e]).hexdigest() for a, e, *_ in spots]),
                        pa.array([back[a:e] == raw_bytes[x:y] for a, e, x, y, *_ in spots]),
                    ],
                    names=["doc_id", "n_chars", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"],
                )
        model.reset()  # a worker outlives its task; what it keeps would add to other stages

    if digest:
        return src.mapInArrow(run, f"doc_id {kind}, n_chars long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean")
    return src.mapInArrow(run, f"doc_id {kind}, pieces array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, pieces); null pieces decode to an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_path)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                rows = [x or [] for x in b.column(1).slice(a, 512).to_pylist()]
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
                data, off = model.decode(np.array([i for x in rows for i in x], np.int64), bounds)
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 512), pa.array([raw[i:j].decode(errors="replace") for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {kind}, text string")
