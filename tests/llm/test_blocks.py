"""Numeric cores against brute force, without Spark."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from catalune.llm import fingerprint, htmltext, pieces, quality, simhash, substrings, tokencount, toxicity
from catalune.llm import textblock as tb


def column(*texts):
    return pa.array(texts, pa.large_string())


def test_span_hashes_depend_on_bytes_only():
    data, off = tb.flat(column("ab cd ab", "ab", "", "éab"))
    s, e = tb.spans(tb.WORD[data], off)
    h = tb.span_hashes(data, s, e)
    words = [bytes(data[a:b]) for a, b in zip(s, e, strict=True)]
    assert words == [b"ab", b"cd", b"ab", b"ab", "éab".encode()]
    assert h[0] == h[2] == h[3] and len(set(h.tolist())) == 3


def test_maximal_segments_against_definition():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.choice([-3, -1, 1, 2]) for _ in range(rng.randrange(1, 12))]
        best = max((sum(x[i : j + 1]) for i in range(len(x)) for j in range(i, len(x))), default=0)
        got = toxicity.maximal_segments(x)
        assert max((s for *_, s in got), default=0) == max(best, 0)
        assert all(abs(sum(x[a : b + 1]) - s) < 1e-9 and s > 0 for a, b, s in got)
        spots = sorted((a, b) for a, b, _ in got)
        assert all(b < c for (_, b), (c, _) in zip(spots[:-1], spots[1:], strict=True))


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS))
    ids, x = np.array([3, 9, 20, 4]), np.array([0.5, 1.0, -2.0, 0.1])
    slow = 0.3 + (w[ids] * x).sum() + sum(v[ids[i]] @ v[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert quality.margins(w, v, 0.3, np.array([0, 4]), ids, x)[0] == pytest.approx(slow)


def test_sampling_matches_generalised_jaccard():
    a, b = "alpha beta gamma delta alpha alpha common words", "alpha beta other words alpha common epsilon zeta"

    def weights(t):
        return {w: n * min(9, max(1, len(w) - 3)) for w, n in collections.Counter(t.split()).items()}

    p, q = weights(a), weights(b)
    true = sum(min(p.get(k, 0), q.get(k, 0)) for k in {*p, *q}) / sum(max(p.get(k, 0), q.get(k, 0)) for k in {*p, *q})
    s = fingerprint.signatures(column(a, b, a, "", "  "), 4096)
    assert fingerprint.likeness(s[:1], s[1:2])[0] == pytest.approx(true, abs=0.03)
    assert (s[0] == s[2]).all() and not s[3:].any()


def test_simhash_bits():
    from xxhash import xxh64_intdigest

    t = b"One two  three four\tfive one two three"
    w = t.lower().split()
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    long = b"x y z " * 2000
    got = simhash.fingerprint_block([t, b"", b"a b", long])
    assert got.tolist()[:3] == [want, 0, xxh64_intdigest(b"a b", 42)]


def test_close_pairs_in_long_runs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fp = np.array([b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (200, 2))], np.uint64)
    i, j = simhash.close_pairs(fp, np.zeros(len(fp), np.int64), 2)
    got = {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True)}
    assert got == {frozenset((a, b)) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 2}


def test_anchors_cover_every_string_once():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 400))) for _ in range(20)] + ["a" * 500]
    data, off = tb.flat(column(*texts))
    row, start, count, *_ = substrings.anchors(data, off, 50, 8)
    got = sorted((int(r), int(s) + k) for r, s, c in zip(row, start, count, strict=True) for k in range(int(c)))
    assert got == [(r, s) for r, t in enumerate(texts) for s in range(len(t) - 49)]


def test_classes_by_sorting():
    rng = np.random.default_rng(5)
    chars = rng.integers(97, 99, (400, 24)).astype(np.uint8)
    chars[:, :16] = 97
    group = rng.integers(0, 2, 400)
    cls = substrings.equal_classes(chars, group, 24, 8)
    want = collections.defaultdict(list)
    for k in range(400):
        want[group[k], chars[k].tobytes()].append(k)
    for members in want.values():
        assert len({int(cls[k]) for k in members}) == 1
        assert len(members) == 1 or cls[members[0]] >= 0
    numbers = [int(cls[m[0]]) for m in want.values() if cls[m[0]] >= 0]
    assert len(numbers) == len(set(numbers))


def test_cut():
    assert substrings.cut(b"0123456789", [(2, 4), (3, 6), (8, 9)]) == (b"01679", 5, 2)
    assert substrings.cut(b"0123456789", [(0, 10)]) == (b"", 10, 1)
    assert substrings.cut(b"ab", []) == (b"ab", 0, 0)


def test_sampled_pieces(tokenizer):
    model = pieces.lattice(tokenizer("piece_bpe_32k.model"))
    texts = ["", "a", " a  b ", "héllo ▁ wörld\n\tx\x00y", "日本語🙂 text", "aaaa" * 300]
    ids, b = model.sample(column(*texts), np.arange(len(texts)))
    data, off = model.decode(ids, b)
    assert [data[off[k] : off[k + 1]].tobytes().decode() for k in range(len(texts))] == texts
    n = 20000
    ids, b = model.sample(column(*["then"] * n), np.arange(n))
    seen = collections.Counter(tuple(ids[b[k] : b[k + 1]].tolist()) for k in range(n))
    v, word, all_ = model.vocab, "▁then", {}

    def walk(i, acc, lw):
        if i == len(word):
            all_[tuple(acc)] = lw
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in v.text:
                walk(j, [*acc, v.text[word[i:j]]], lw + v.weight[v.text[word[i:j]]])

    walk(0, [], 0.0)
    z = sum(map(math.exp, all_.values()))
    for s, lw in all_.items():
        assert seen[s] / n == pytest.approx(math.exp(lw) / z, abs=0.01)
    one, _ = model.sample(column("then"), np.array([7]))
    assert one.tolist() == ids[b[7] : b[8]].tolist()


def test_token_lengths(tokenizer):
    t = tokencount._tokenizer(tokenizer("byte_bpe_50k.json"))
    texts = ["", None, "hello world", "word " * 30000, "a" * 70000, "x <|endoftext|> y", " \n\n  é🙂"]
    want = [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
    assert tokencount.lengths(t, texts) == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>a <b>b</b>c<br>d</article><footer>x</footer>", "T a bc d"),
        ("<body class='has-sidebar'><div class=post><p>One two.<div class='ad'>Buy</div><p>Three&#33;</div><div class='sidebar'>S</div><section id=comments><p>Nice.</section>", "One two. Three!"),
        ("<main><p>Text</p><form><label>Mail</label></form><script>var a='<p>no</p>'</script></main><scr", "Text"),
        ("<div><div><a href=1>A</a> <a href=2>B</a></div><div><p>A long text of an article. It has two sentences.</p></div><div>Copyright 2020</div></div>", "A long text of an article. It has two sentences."),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_min_cut_is_least():
    rng = random.Random(6)
    for _ in range(50):
        n = rng.randrange(1, 7)
        keep, drop = [rng.randrange(10) for _ in range(n)], [rng.randrange(10) for _ in range(n)]
        edges = {(i, j): rng.randrange(1, 6) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(side):
            return sum(d if s else k for s, k, d in zip(side, keep, drop, strict=True)) + sum(c for (i, j), c in edges.items() if side[i] != side[j])

        least = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(htmltext.min_cut(keep, drop, edges)) == least
