"""Operators on Spark: brute force on small fixtures and the awkward cases."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from catalune.llm import decontaminate, fingerprint, linededup, pieces, quality, simhash, substrings, tokencount, toxicity
from catalune.llm import queries as Q

DATA = "/root/testdata/sf0.001"


def _without_repeats(rows, n):
    first = {}
    for d, t in rows:
        for i in range(len(t) - n + 1):
            first[t[i : i + n]] = min(first.get(t[i : i + n], (1 << 60, 0)), (d, i))
    want = collections.Counter()
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < (d, i):
                gone[i : i + n] = b"\1" * n
        kept = "".join(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        want[d, len(t), sum(gone), runs, hashlib.sha256(kept.encode()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("length, gram, shallow, base_size", [(32, 8, 16, 200), (100, 32, 32, 600)])
def test_substrings_against_brute_force(spark, length, gram, shallow, base_size):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab" if length < 50 else "abcdefgh ") for _ in range(base_size)) for _ in range(6)]
    rows = [(rng.choice([i, i, 5]), "".join(x[a : a + rng.randrange(base_size * 3 // 4)] for x in rng.sample(base, 2) for a in [rng.randrange(base_size // 2)])) for i in range(30)]
    rows += [(50 + i, base[0][: length + 20] + f"{i} own end {i * 7}") for i in range(8)] + [(60, "z" * 3 * length), (61, base[1] * 2)]
    rows.append(rows[0])
    want = _without_repeats(rows, length)
    assert sum(k[2] for k in want) > 1000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (substrings.HOT, 2):
        got = substrings.dedup_substrings(df, length=length, gram=gram, shallow=shallow, hot=hot)
        assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_simhash_components(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(50)]
    rows = []
    for g in range(6):
        text = [rng.choice(words) for _ in range(300)]
        for k in range(5):
            t = list(text)
            for _ in range(k):
                t[rng.randrange(300)] = "z%d" % rng.randrange(9)
            rows.append((g * 10 + k, " ".join(t)))
    rows += [(100, ""), (101, None), (102, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(df).collect()}
    for radius, tile in ((2, 4096), (6, 4096), (6, 2)):
        root = {i: i for i in fps}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
        assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 3, radius, tile).collect()} == {i: find(i) for i in fps}


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate((30, 12, 4, 0, 25))] + [(None, " ".join(vocab[:11])), (1, "Shared, TAIL of one two three four five six seven")]
    docs = []
    for d in range(30):
        t = [rng.choice(vocab) for _ in range(40)]
        if d % 3 == 0:
            t[5:5] = rng.choice(items)[1].split()
        docs.append((d, ", ".join(t)))
    docs += [(90, None), (91, "")]
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").encode().lower())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i) if i is not None else None)
    want = {}
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for key, own in windows.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit |= set(range(k, k + len(key)))
                    names |= own - {None}
        want[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slice_words in (10**6, 20):
        got = decontaminate.digest(decontaminate.find_contamination(df, b, slice_words=slice_words))
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert {r.doc_id for r in decontaminate.remove_contaminated(df, b).collect()} == {d for d, x in want.items() if not x[4]}
    # the longest match of each pair of places, with the places
    plain, longest = dict(items), collections.defaultdict(set)
    for d, t in docs:
        w = split(t)
        for i, text in items:
            v = split(text)
            k = min(10, len(v))
            for a in range(len(w) - k + 1) if k else ():
                for p in range(len(v) - k + 1):
                    if w[a : a + k] == v[p : p + k] and not (a and p and w[a - 1] == v[p - 1] and w[a - 1 : a - 1 + k] == v[p - 1 : p - 1 + k]):
                        n = k
                        while a + n < len(w) and p + n < len(v) and w[a + n] == v[p + n]:
                            n += 1
                        longest[d].add((a, a + n, str(i) if i is not None else None, p))
    assert len(plain) and {r.doc_id: {tuple(m) for m in r.matches} for r in decontaminate.find_contamination(df, b).collect()} == {d: longest[d] for d, _ in docs}
    # rows are judged by text: without ids, and with one id on a clean and a contaminated row
    mixed = spark.createDataFrame([(None, docs[0][1]), (None, "clean"), (7, docs[0][1]), (7, "clean too")], "doc_id long, text string")
    assert sorted(r.text for r in decontaminate.remove_contaminated(mixed, b).collect()) == ["clean", "clean too"]


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(4)
    lines = [" ".join(f"t{rng.randrange(60)}" for _ in range(rng.randrange(3, 25))) for _ in range(40)]
    rows = []
    for d in range(25):
        own = []
        for _ in range(4):
            w = rng.choice(lines).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = f"n{rng.randrange(200)}"
            own.append(" ".join(w))
        rows.append((d, "\n".join(own)))
    seen, want = [], {}
    for d, t in rows:
        gone = 0
        for x in t.split("\n"):
            s = set(x.lower().split())
            if s:
                gone += any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
                seen.append(s)
        want[d] = gone
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.n_removed_lines for r in got.collect()} == want


def test_edits_follow_descending_ids(spark):
    rows = [(i, f"text number {i} with words " * (i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fingerprint.compare_edits(df, bucket_rows=7).collect()}
    texts = dict(rows)
    for i in texts:
        t, following = texts[i], texts[(i - 1) % 40]
        h = len(t) // 2
        e = t[: len(t) - h] + following[:h]
        assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
    assert got[0].near_edited == 1.0


def test_models_learn_and_hold_out(spark):
    docs = [(i, ("nasty " if i % 2 else "fine ") + " ".join(f"w{(i * k) % 17}" for k in range(30)) + (" %%% $$$" * 20 if i % 3 == 0 else "")) for i in range(300)]
    labels = [(i, int(i % 3 != 0), i % 2) for i in range(300)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    q = quality.QualityModel.train(d, y).score(d, 0.3)
    t = toxicity.ToxicityModel.train(d, y).apply(d)
    for out, col in ((q, "quality"), (t, "toxic")):
        held = out.where("held_out").join(y, "doc_id")
        assert held.count() > 30
        assert held.where(F.col("predicted") != F.col(col)).count() <= 0.05 * held.count()
    assert toxicity.ToxicityModel.train(d, y.limit(0)).keep(d).count() == 300
    assert quality.QualityModel.train(d, y.limit(0)).score(d, 0.3).first().score == 0.5


@pytest.mark.parametrize("rows", ["awkward", "empty"])
def test_awkward_rows(spark, awkward, tokenizer, rows):
    df = awkward if rows == "awkward" else awkward.limit(0)
    n = df.count()
    labels = df.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    bench = spark.createDataFrame([(1, None), (None, "x y"), (2, "")], "item_id long, text string")
    model = tokenizer("piece_bpe_32k.model")
    outs = [
        pieces.encode(df, model, digest=True),
        pieces.decode(pieces.encode(df, model), model),
        quality.QualityModel.train(df, labels).score(df, 0.3),
        fingerprint.compare_edits(df),
        substrings.dedup_substrings(df),
        simhash.near_duplicates(df),
        decontaminate.digest(decontaminate.find_contamination(df, bench)),
        tokencount.count_tokens(df, tokenizer("byte_bpe_50k.json")),
        linededup.dedup_lines(df),
        toxicity.ToxicityModel.train(df, labels).apply(df),
    ]
    for out in outs:
        assert len(out.collect()) == n
    if n:
        assert all(r.lossless for r in outs[0].collect())
        assert {r.doc_id: r.text for r in outs[1].collect()}[6] == dict((r[0], r.text) for r in df.collect())[6]
        assert simhash.drop_near_duplicates(df).columns == df.columns


def test_queries_are_whole(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, q in Q.queries().items():
        rows = q(spark, DATA).count()
        assert rows == (n if name != "op10_html_extraction" else spark.read.parquet(f"{DATA}/pages.parquet").count()), name


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, DATA)
        assert out.count() <= docs.count()
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns
            docs = out
    assert out.where("not lossless").count() == 0
