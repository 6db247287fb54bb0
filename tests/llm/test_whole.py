"""Whole jobs against brute force: what an operator may not leave out."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from catalune.llm import queries as Q
from catalune.llm import linededup, simhash


def _groups(sets, similar):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in sets}


def test_near_copies_from_similarity_on(spark):
    rng = random.Random(5)
    rows = []
    for g in range(40):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200))]
        rows.append((g * 10, " ".join(text)))
        for k in range(1, 5):
            t = list(text)
            for _ in range(max(1, len(t) * k // 120)):
                t[rng.randrange(len(t))] = f"z{rng.randrange(5000)}"
            rows.append((g * 10 + k, " ".join(t)))
    passage = " ".join(f"c{i}" for i in range(60))
    rows += [(1000 + i, f"{passage} " + " ".join(f"p{rng.randrange(5000)}" for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(2000, ""), (2001, None), (2002, " \n"), (2003, "one two"), (2004, "One  two"), (2005, "one three")]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = [(i, j) for i in sets for j in sets if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert sum(10 * len(sets[i] & sets[j]) < 9 * len(sets[i] | sets[j]) for i, j in near) > 30
    want = _groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in C.drop_near_copies(spark, df, "").collect()} == want
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df.union(df)).collect()) == sorted(want)


def test_line_dedup_of_every_line(spark, tmp_path):
    rng = random.Random(6)
    spaces = [" ", "\t", "\u00a0", "  ", "\u3000"]
    lines = [rng.choice(spaces).join(f"t{rng.randrange(30)}" for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    lines += ["All rights reserved.", "長い文に空白はない", "", " ", "a\u00a0b\tc d e f", "x"]
    rows = [(d, "\n".join(rng.choice(lines) if rng.random() < 0.8 else f"Own {d} {k}" for k in range(6))) for d in range(25)]
    seen, want = [], {}
    for d, t in rows:
        gone = 0
        for x in t.split("\n"):
            s = set(x.lower().split())
            if s:
                gone += any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
                seen.append(s)
        want[d] = gone
    df = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed_lines for r in Q.op8_line_dedup(spark, str(tmp_path)).collect()} == want
    staged = {r.doc_id: r.text for r in C.drop_repeated_lines(spark, df, "").collect()}
    assert all(len(staged[d].split("\n")) == max(1, len(t.split("\n")) - want[d]) for d, t in rows)


def test_line_classes_are_signed_once(spark):
    rng = random.Random(7)
    base = [" ".join(f"t{rng.randrange(400)}" for _ in range(n)) for n in (6, 30, 70, 150, 300)]
    rows = [(k, f"{x} {rng.choice('abc')}{k}") for k, x in enumerate(base * 4)]
    classes = linededup.line_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in classes.collect():
        odd = [0, 0, 0]
        for h in r.set:
            odd[0] ^= 1 << (h & 63)
            odd[1] ^= (r.n > linededup.LONG and h & 64 == 64) << (h & 63)
            odd[2] ^= (r.n > linededup.LONGER and h & 192 == 128) << (h & 63)
        assert r.n == len(r.set) and r.low == sorted(r.set)[: linededup.SKETCH] and [s % (1 << 64) for s in (r.s0, r.s1, r.s2)] == odd
    settled = classes.limit(1).select("key")
    pairs = linededup.candidates(classes, settled, linededup.rarity(classes), 4, 5)
    sets = {r.key: set(r.set) for r in classes.collect()}
    shut = settled.first().key
    got = {frozenset(p) for p in pairs.collect()}
    assert got >= {frozenset((a, b)) for a in sets for b in sets if a < b and shut not in (a, b) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    # at size, the prefix rows are made and dealt out once, for both sides
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = linededup.candidates(classes, settled, linededup.rarity(classes), 4, 5)
        assert {frozenset(p) for p in big.collect()} == got
        plan = big._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    assert plan.count("Generate posexplode") == 1 and "ReusedExchange" in plan


def test_lines_part_where_python_parts_them(spark):
    other = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and c != 10]
    df = spark.createDataFrame([(f"a{c}b", len(f"a{c}b".split())) for c in other if c.isspace() or ord(c) < 0x3100], "x string, n int")
    assert df.where(F.size(F.split("x", f"[{linededup.SPACE}]")) != F.col("n")).count() == 0


def test_parity_is_a_lower_bound():
    import numpy as np

    from catalune.llm import shinglejoin

    rng = random.Random(8)
    for n, m in ((3, 3), (500, 400), (600, 490), (1100, 1000), (0, 5), (4000, 3500)):
        common = rng.randrange(min(n, m) + 1)
        draw = lambda k: {rng.getrandbits(64) for _ in range(k)}
        both = draw(common)
        a, b = (np.array(sorted(both | draw(k - common)), np.uint64) for k in (n, m))
        far = shinglejoin.apart(shinglejoin.parity(a), shinglejoin.parity(b))
        assert far <= len(set(a.tolist()) ^ set(b.tolist())) and far % 2 == len(a) % 2 ^ len(b) % 2
        assert far >= 0.5 * min(len(set(a.tolist()) ^ set(b.tolist())), max(n, m))


def test_op5_against_brute_force(spark):
    import re

    from xxhash import xxh64_intdigest

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    prints = {}
    for r in docs.collect():
        w = word.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode()))
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxh64_intdigest(s, 42) for s in shingles]
        prints[r.doc_id] = sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))
    groups = _components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}


def _components(items, linked):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in items:
        for j in items:
            if i < j and linked(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_op3_against_brute_force(spark):
    import collections
    import hashlib

    import numpy as np
    import pyarrow as pa

    from catalune.llm import fingerprint

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    texts = [t for _, t in rows]
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    # a plain reading of the sampling, a text at a time
    own, other = (fingerprint.signatures(pa.array(x, pa.large_string())) for x in (texts, edited))
    got = {r.doc_id: r for r in Q.op3_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        r = got[i]
        nxt = own[(k + 1) % len(rows)]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited[k].encode()).hexdigest())
        assert abs(r.near_edited - np.mean(own[k] == other[k])) < 1e-6 and abs(r.near_next - np.mean(own[k] == nxt)) < 1e-6

    def weights(t):
        import re

        count = collections.Counter(re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode().lower()))
        return {w: n * min(max(len(w) - 3, 1), 9) for w, n in count.items()}

    # likeness estimates generalised Jaccard similarity: unbiased, standard error 1/16 at most for one pair
    off = []
    for k in range(len(rows)):
        a, b = weights(texts[k]), weights(edited[k])
        top = sum(max(a.get(w, 0), b.get(w, 0)) for w in a.keys() | b.keys())
        if top:
            off.append(np.mean(own[k] == other[k]) - sum(min(a.get(w, 0), b.get(w, 0)) for w in a.keys() | b.keys()) / top)
    assert abs(np.mean(off)) < 0.02 and np.abs(off).max() < 0.27


def test_maximal_segments_by_definition():
    from catalune.llm.toxicity import maximal_segments

    rng = random.Random(4)
    for _ in range(300):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randrange(14))]

        def split(a, e):
            """Ruzzo and Tompa's definition: the best segment, then those of what is left of it and right of it."""
            best = None
            for i in range(a, e):
                total = 0
                for j in range(i, e):
                    total += s[j]
                    key = (total, -(j - i))
                    if total > 0 and (best is None or key > best[0]):
                        best = key, i, j
            if best is None:
                return []
            (total, _), i, j = best
            return [*split(a, i), (i, j, total), *split(j + 1, e)]

        want, got = split(0, len(s)), maximal_segments(s)
        assert sorted(x[2] for x in got) == sorted(x[2] for x in want) and sum(x[2] for x in got) == sum(x[2] for x in want)
        # every one is maximal: no proper part scores as much, and none can be joined to its neighbour
        for a, e, t in got:
            assert sum(s[a : e + 1]) == t
            assert all(sum(s[a:k]) > 0 for k in range(a + 1, e + 2)) and all(sum(s[k : e + 1]) > 0 for k in range(a, e + 1))


def test_pipeline_stages_on_awkward_rows(spark, awkward, tmp_path):
    for name, rows in (("full", awkward), ("empty", awkward.limit(0))):
        sf = f"{tmp_path}/{name}"
        rows.select("doc_id", rows.doc_id.isNotNull().cast("int").alias("quality"), (rows.doc_id == 5).cast("int").alias("toxic")).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x y"), (2, ""), (3, "text without an id which is nobody")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = rows
        for k, (stage, f) in enumerate(C.STAGES):
            out = f(spark, docs, sf)
            assert out.columns == rows.columns or k == len(C.STAGES) - 1
            n = out.count()
            assert n <= docs.count() and (name == "full" or n == 0), stage
            if stage == "line dedup":
                assert n == docs.count()
            if stage == "decontamination":
                assert not [r for r in out.collect() if r.doc_id is None]  # its null id does not keep it
            docs = out


def test_near_dedup_goes_by_fingerprint_links(spark, monkeypatch):
    rng = random.Random(31)
    words = [f"v{k}" for k in range(900)]
    base = [[rng.choice(words) for _ in range(600)] for _ in range(6)]
    rows = [(10 * g + k, " ".join(b if k == 0 else [*b[:300], f"new{g}{k}", *b[301:]])) for g, b in enumerate(base) for k in range(4)]
    df = spark.createDataFrame([*rows, (98, ""), (99, None)], "doc_id long, text string")
    row = F.xxhash64("doc_id", "text")
    of = {r.row: r.doc_id for r in df.select("doc_id", row.alias("row")).collect()}
    one = df.where("doc_id < 90").select(row.alias("key"), row.alias("row"))
    got = simhash.close_classes(df.select("doc_id", "text", row.alias("row")), one).collect()
    assert len(got) >= 12 and all(of[r.a] // 10 == of[r.b] // 10 for r in got)
    called = []
    monkeypatch.setattr(simhash, "links", lambda *a, f=simhash.links: (called.append(a), f(*a))[1])
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == {0, 10, 20, 30, 40, 50, 98}
    assert called
