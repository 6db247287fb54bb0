"""Literals, edge cases and equivalences of the engine's operators."""

import math
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalune import schema
from catalune.functions import geo
from catalune.functions import text as tx
from catalune.operators import audit, browse, delta, fuzzy, geometry, graph, retrieve, vectors
from catalune.operators import position as ps
from catalune.sources import readers


@pytest.mark.parametrize(("a", "b", "d"), [("mnoet", "monet", 1), ("harlw", "harlequin", 5), ("", "abc", 3), ("ca", "abc", 3), ("abc", "abc", 0)])
def test_osa(a, b, d):
    assert tx.osa(a, b) == d


@pytest.mark.parametrize(("w", "s"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("sky", "sky"), ("painting", "paint"), ("agreed", "agre"), ("electricity", "electr")])
def test_stem(w, s):
    assert tx.stem(w) == s


def test_text(spark):
    df = spark.createDataFrame([("  Héllo,  WORLD_9! ", "a10"), ("", "a9"), (None, "205.03.bis")], "t string, c string")
    assert [r[0] for r in df.select(tx.normalize(F.col("t"))).collect()] == ["héllo world 9", "", None]
    assert [r[0] for r in df.orderBy(tx.natural_key(F.col("c"))).select("c").collect()] == ["205.03.bis", "a9", "a10"]
    assert df.select(tx.fold_diacritics("t")).first()[0] == "  hello,  world_9! "
    assert set(df.limit(1).select(tx.trigrams(F.lit("abc"))).first()[0]) == {"abc", "bac", "acb"}


def test_relaxed_tokens():
    assert tx.relaxed_tokens("show me the red vase") == ["red", "vase"]
    assert tx.relaxed_tokens("the of") == ["the", "of"]


def test_search_edges(spark):
    objects = spark.createDataFrame([(1, "Red vase", "", True), (2, "Red box", "", False), (3, None, None, False)], "objectID long, title string, artist string, isHighlight boolean")
    w = {"title": 10.0, "artist": 8.0}
    assert retrieve.search(objects, "  ,", w).count() == 0
    assert [r.objectID for r in retrieve.search(objects, "re", w).collect()] == [1, 2]
    assert [r.objectID for r in retrieve.search(objects, "re va", w).collect()] == [1]
    assert retrieve.search(objects.limit(0), "red", w).count() == 0
    assert [r.objectID for r in retrieve.search(objects, "boxes vases", w, relaxed=True, stem=True, limit=None).orderBy("objectID").collect()] == [1, 2]


@pytest.mark.parametrize(("ttl", "age", "hidden"), [(28, 40, True), (28, 20, False), (14, 14, True), (14, 13, False)])
def test_ttl(spark, ttl, age, hidden):
    now = 1_700_000_000_000
    m = spark.createDataFrame([("m", ttl, now - age * 86_400_000)], "museum string, ttlDays int, builtAtMs long")
    assert retrieve.expired_museums(m, now).count() == int(hidden)


def test_corrections_prefer_frequent(spark):
    found = spark.createDataFrame([("degas", 107, 1, 1), ("durgas", 4, 1, 2), ("zzzz", 900, 1, 3)], "term string, df int, shared int, rank int")
    assert [r.term for r in fuzzy.rank_corrections(found, "drgas").orderBy("place").collect()] == ["degas", "durgas"]


def test_compound_split(spark):
    post = spark.createDataFrame([(1, "washington", 1.0, 2), (1, "crossing", 1.0, 2), (2, "wash", 1.0, 1)], "objectID long, term string, tf double, len int")
    assert fuzzy.split_places(post, "washingtoncrossing", 3).first()["at"] == len("washington")
    vocab = post.select("term", F.lit(1).alias("df"))
    assert fuzzy.correct("washingtoncrossing", post, vocab) == "washington crossing"
    assert fuzzy.correct("xqzvkj", post, vocab) is None


@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), min_size=1, max_size=30))
@settings(max_examples=5, deadline=None)
def test_positions_against_order(spark, rows):
    df = spark.createDataFrame([(i, str(g) if g else "", h) for i, (g, h) in enumerate(rows)], "objectID long, galleryNumber string, isHighlight boolean")
    got = {r.objectID: r for r in browse.neighbours(browse.positions(df, ["galleryNumber"]).drop("total"), ["galleryNumber"]).collect()}
    for g in {g for g, _ in rows if g}:
        order = sorted((i for i, (x, _) in enumerate(rows) if x == g), key=lambda i: (not rows[i][1], i))
        for k, i in enumerate(order):
            assert (got[i].position, got[i].previous, got[i].following) == (k + 1, order[k - 1], order[(k + 1) % len(order)])


def test_quantile_literal(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4)], "g int, v int")
    assert audit.index_quantiles(df, "v", ["g"], {"p50": 0.5}).first().p50 == 3


def test_zero_denominators(spark):
    empty = spark.createDataFrame([], "m string, k int")
    assert audit.join_rate(empty, empty, ["k"], []).first().pct == 100.0
    p = spark.createDataFrame([("a", 1, "x")], "m string, k int, room string")
    r = audit.churn(p.limit(0), p, ["m", "k"], "room", "m").first()
    assert (r.before, r.added, r.added_pct, r.moved_pct) == (0, 1, 100.0, 0.0)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1.0, "walk"), ("b", "c", 1.0, "stairs"), ("a", "c", 5.0, "walk"), ("x", "y", 1.0, "walk")], "a string, b string, len double, kind string").withColumn("site", F.lit(1))
    n = spark.createDataFrame([(i,) for i in "abcxyz"], "id string")
    assert {r.id: r.component for r in graph.components(n, e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    pairs = spark.createDataFrame([(1, 0, "a", "c"), (1, 1, "a", "x"), (1, 2, "b", "b")], "site int, pair int, source string, target string")
    assert {r.pair: r.length for r in graph.routes(e, pairs).collect()} == {0: 2.0, 1: None, 2: 0.0}
    assert {r.pair: r.length for r in graph.routes(e, pairs, ("stairs",)).collect()}[0] == 5.0
    assert {r.id: r.dist for r in graph.distances(e, n.where("id = 'a'")).collect()} == {"a": 0.0, "b": 1.0, "c": 2.0}


def test_routes_are_those_of_dijkstra(spark):
    """Paths with all their ties, zero lengths and fractions."""
    rng = random.Random(12)
    edges = [(s, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice((0.0, 0.1, 0.2, 0.3, 1.0, 2.0, 3.0)), rng.choice(("walk", "walk", "stairs", None))) for s in range(3) for _ in range(110)]
    pairs = [(s, k, f"n{rng.randrange(62)}", f"n{rng.randrange(62)}") for s in range(4) for k in range(80)]
    want = {}
    for s, k, a, b in pairs:
        near = {}
        for t, x, y, d, kind in edges:
            if t == s and kind != "stairs":
                near.setdefault(x, []).append((y, d, "walk"))
                near.setdefault(y, []).append((x, d, "walk"))
        near.setdefault(a, [])
        want[s, k] = graph.dijkstra(near, [a], {b}) or (None, None)
    assert sum(w[0] is None for w in want.values()) > 20 and max(len(w[0] or ()) for w in want.values()) > 5
    e = spark.createDataFrame(edges, "site int, a string, b string, len double, kind string")
    got = graph.routes(e, spark.createDataFrame(pairs, "site int, pair int, source string, target string"), ("stairs",)).collect()
    assert {(r.site, r.pair): (r.path, r.length) for r in got} == want and len(got) == len(want)
    assert all(r.hops == (None if r.path is None else len(r.path) - 1) for r in got)


def test_routes_search_from_both_ends(spark, monkeypatch):
    """From the middle of a large tree, a search from one end would pass most of it."""
    edges = [(k, (k - 1) // 3, 1.0 + k % 7) for k in range(1, 3**9)]
    net = graph._Net(pa.table({"a": [x[0] for x in edges], "b": [x[1] for x in edges], "len": [x[2] for x in edges]}))
    steps = []
    monkeypatch.setattr(graph._Net, "_ball", lambda *a, f=graph._Net._ball: (steps.append(1), f(*a))[1])
    path, length = net.route(0, 3**8)
    assert path[0] == 0 and path[-1] == 3**8 and length == sum(1.0 + k % 7 for k in path[1:])
    assert len(steps) < 1000


def test_repair_reaches_main(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 1.0, 0.0, 0), (3, 2.0, 0.0, 0), (4, 9.0, 9.0, 0)], "id long, x double, y double, site int")
    edges = spark.createDataFrame([(1, 2, 1.0, "walk")], "a long, b long, len double, kind string")
    fixed = graph.repair(nodes, edges, ["site"], 1.25)
    assert {(r.a, r.b) for r in fixed.where("kind = 'bridge'").collect()} == {(3, 2)}
    kept, _ = graph.prune(nodes, fixed, ["site"])
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3]


def test_geometry(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    shape = F.array(F.array(p(0, 0), p(4, 0), p(4, 2), p(2, 2), p(2, 4), p(0, 4)), F.array(p(0.5, 0.5), p(0.5, 1), p(1, 1), p(1, 0.5)))
    r = spark.range(1).select(geo.area(shape).alias("a"), geo.in_polygon(F.lit(3.0), F.lit(1.0), shape).alias("i"), geo.in_polygon(F.lit(3.0), F.lit(3.0), shape).alias("o"), geo.in_polygon(F.lit(0.7), F.lit(0.7), shape).alias("h"), geo.compass(F.lit(-45.0)).alias("c"), geo.floor_label(F.lit(1.5), F.lit("G")).alias("f")).first()
    assert tuple(r) == (11.75, True, False, False, "northwest", "1M")
    assert geometry.clip_segment((-1, 1), (5, 1), (0, 0, 2, 2)) == ((0, 1), (2, 1))
    assert geometry.clip_segment((-1, 5), (5, 5), (0, 0, 2, 2)) is None
    assert geometry.ring_gap([(0, 0), (1, 0), (1, 1), (0, 1)], [(3, 0), (4, 0), (4, 1), (3, 1)]) == 2
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 2), (2, 2), (2, 1)]
    assert geometry.group_rings([outer, hole]) == [[outer, hole]]
    assert geometry.chain_segments([((0, 0), (10, 0)), ((20, 0), (10, 1))], 2) == [[(0, 0), (10, 0), (20, 0)]]


def test_copies_of_points_and_polygons_meet_once(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    square = lambda size: F.array(F.array(p(0, 0), p(size, 0), p(size, size), p(0, size)))
    kinds = spark.range(12).select("id", (F.col("id") % 2).alias("floor"), F.when(F.col("id") % 3 == 0, square(4)).otherwise(square(9)).alias("rings"))
    points = spark.range(40).select("id", F.when(F.col("id") < 30, 2.0).otherwise(6.0).alias("x"), F.lit(1.0).alias("y"), (F.col("id") % 2).alias("floor"))
    df = geometry.containing(points, kinds, ["floor"], 10.0)
    assert {r.point: r.polygon for r in df.collect()} == {i: (0, 3)[i % 2] if i < 30 else (2, 1)[i % 2] for i in range(40)}
    # 2 floors x 2 places x 2 shapes: no join before the last one sees the copies
    plan = df._jdf.queryExecution().executedPlan()
    joined = [int(n) for n in re.findall(r"Join[^\n]*?rows=(\d+)", _joins(plan))]
    assert len(joined) == 2 and min(joined) <= 8


def _joins(plan) -> str:
    """A line for each join of an executed plan, with its number of rows."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _joins(plan.executedPlan())
    out = f"{name} rows={plan.metrics().apply('numOutputRows').value()}\n" if name.endswith("Join") else ""
    inner = plan.plan() if name.endswith("QueryStage") else None
    below = plan.children()
    return out + (_joins(inner) if inner is not None else "") + "".join(_joins(below.apply(k)) for k in range(below.length()))


def test_delta_replay(spark):
    log = spark.createDataFrame([("a", 1, "put", 1), ("a", 2, "put", 2), ("b", 3, "put", 1), ("b", 4, "delete", 0), ("c", 5, "delete", 0), ("c", 6, "put", 7)], "id string, ordinal int, op string, v int")
    assert {r.id: r.v for r in delta.replay(log).collect()} == {"a": 2, "c": 7}
    assert {r.id: r.v for r in delta.replay(log, keep="first").collect()} == {"a": 1, "c": 7}


def test_publish_moves_pointer_last(spark, tmp_path):
    root = str(tmp_path / "cat")
    delta.publish(spark.range(3), root, "2024-01-01")
    delta.publish(spark.range(5), root, "2024-01-02")
    assert delta.read_latest(spark, root).count() == 5


def test_compaction_is_idempotent(spark):
    idx = spark.createDataFrame([(i, i, None if i % 2 else "h") for i in range(50)], "objectID long, row long, imageHash string")
    cur = spark.createDataFrame([(i, "h") for i in range(50) if i % 7], "objectID long, currentHash string")
    once = vectors.compaction_apply(vectors.compaction_plan(idx, cur), 8)
    assert [r.row for r in once.orderBy("row").collect()] == list(range(once.count()))
    again = vectors.compaction_apply(vectors.compaction_plan(once.select("objectID", "row", "imageHash"), cur), 8)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_top_k_ties_and_dimensions(spark):
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.top_k(rows, [2.0, 0.0], 2).collect()] == [1, 2]
    assert vectors.top_k(rows.limit(0), [1.0, 0.0]).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        vectors.top_k(rows, [1.0, 0.0, 0.0]).collect()


def test_decay_boundary():
    room = ps.fold(ps.Anchor(), ps.Input(0, "room", gallery="1", floor=2.0, site="s"))
    assert ps.fold(room, ps.Input(ps.DECAY_MS - 1, "gps", site="s")) is room
    area = ps.fold(room, ps.Input(ps.DECAY_MS, "gps", site="s"))
    assert (area.kind, area.assumed_floor) == ("area", 2.0)
    assert ps.fold(room, ps.Input(ps.DECAY_MS, "gps", site="other")).assumed_floor is None


def test_route_and_bucket():
    p, seen = ps.Progress(), []
    for g in ("a", "b", "z", "z", "y", "z", None, "z", "b", "z", "c", "a"):
        p, what = ps.follow(["a", "b", "c", "b"], p, g)
        seen.append(what)
    assert seen == ["none", "advance", "reroute", "none", "reroute", "reroute", "none", "none", "none", "reroute", "advance", "none"]
    assert p == ps.Progress(2)
    # a room known before the route opened is no new fix
    assert ps.follow(["a"], ps.Progress(off="z"), "z")[1] == "none"
    assert ps.follow(["a"], ps.Progress(off="z"), "y")[1] == "reroute"
    tokens, ok, _ = ps.take_token(0, None, 0, 60, 2)
    tokens, ok, _ = ps.take_token(tokens, 0, 0, 60, 2)
    tokens, ok, wait = ps.take_token(tokens, 0, 0, 60, 2)
    assert (ok, wait) == (False, 1)


@given(st.lists(st.tuples(st.sampled_from(["room", "gps", "venue"]), st.sampled_from(["s", "t"]), st.booleans()), max_size=30))
@settings(max_examples=200, deadline=None)
def test_anchor_site_is_venue(events):
    state = ps.Fused()
    for i, (source, site, flag) in enumerate(events):
        state, _ = ps.fold_fused(state, ps.Input(i * 100_000, source, True, "g", 1.0, site, flag))
        assert state.anchor.kind == "none" or state.anchor.site == state.venue


def test_window_fold_equals_fold(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), i, rng.randrange(20) * 60_000, rng.choice(["room", "gps"]), rng.random() < 0.7, "g", 1.0, "s") for i in range(300)]
    df = spark.createDataFrame(rows, "key long, event_id long, at long, source string, usable boolean, gallery string, floor double, site string")
    a = {(r.key, r.event_id): r.level for r in ps.fold_positions(df).collect()}
    assert a == {(r.key, r.event_id): r.level for r in ps.fold_positions_window(df.repartition(7)).collect()}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t,u\n1,"x ""q""\ny",\n2,z\n', newline="")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), "id string, t string, u string").collect()] == [("1", 'x "q"\ny', ""), ("2", "z", "")]
    (tmp_path / "l.ndjson").write_text('{"id": 1, "v": 1}\n{"id": 1, "v": 2}\nbroken\n')
    assert readers.read_log(spark, str(tmp_path / "l.ndjson"), "id int, v int", "id").first().v == 2
    assert readers.read_log(spark, str(tmp_path / "l.ndjson"), "id int, v int", "id", "first").first().v == 1
    (tmp_path / "g.json").write_text('{"features": [{"properties": {"name": "r"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}')
    assert readers.read_features(spark, str(tmp_path / "g.json"), "name: string".replace(": ", ":")).first().name == "r"
    maps = spark.createDataFrame([("<loc>http://x/b</loc><loc>http://x/a/</loc><loc>http://y/b</loc>",)], "xml string")
    assert {(r.slug, r.pos) for r in readers.sitemap_slugs(maps).collect()} == {("b", 0), ("a", 1)}
    html = spark.createDataFrame([("<tr><td>Date:</td><td><b>c. 1900</b> &amp; on</td></tr>",)], "h string")
    assert html.select(readers.field_value(F.col("h"), "Date")).first()[0] == "c. 1900 & on"
    walked = readers.walk_json(spark.createDataFrame([('{"a": [{"k": 1}, {"b": {"k": 2}}]}',)], "j string"), "j", "k")
    assert sorted(r.value for r in walked.collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="good"):
        readers.guard(maps, {"good": F.lit(False)})


def test_facets_are_disjoint_and_exhaustive(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"f{i % 2}", None if i % 7 == 0 else f"s{i % 3}") for i in range(100)], "id int, f string, s string")
    parts = [p for _, p in readers.facet_partitions(df, "f", "s", 30)]
    ids = [r.id for p in parts for r in p.collect()]
    assert sorted(ids) == list(range(100))


def test_canonical_schema(spark):
    df = schema.canonical_objects(spark.createDataFrame([(1, None)], "objectID int, title string"))
    assert df.schema.names == schema.OBJECTS.names
    assert df.first().title == ""


def test_route_windows_equal_follow(spark):
    rng = random.Random(9)
    rows = [(k, i, i // 2, rng.choice(["a", "b", "c", "y", "z", None])) for k in range(12) for i in range(40)]
    route = ["a", "b", "c", "b"]
    for known in (None, "z"):
        want = {}
        for k in range(12):
            p = ps.Progress(off=known)
            for _, i, _, g in rows[k * 40 : k * 40 + 40]:
                p, what = ps.follow(route, p, g)
                want[k, i] = (p.step, what)
        df = spark.createDataFrame(rows, "key long, event_id long, at long, gallery string").repartition(5)
        assert {(r.key, r.event_id): (r.step, r.outcome) for r in ps.route_progress(df, route, known).collect()} == want


def test_stemmed_search_against_plain_python(spark):
    from catalune.functions import text as tx

    rows = [(1, "Economical walking", "n"), (2, "economics of walks", "n"), (3, "A walker", "n"), (4, "nothing", "n"), (5, "Walked, walked and economic", "n")]
    df = spark.createDataFrame(rows, "objectID long, title string, artist string").withColumn("isHighlight", F.lit(False))
    query = [tx.stem(w) for w in ("economical", "walks")]
    docs = {i: [tx.stem(w) for w in tx.query_tokens(t)] for i, t, _ in rows}
    mean = sum(map(len, docs.values())) / len(docs)
    want = {}
    for i, words in docs.items():
        score = 0.0
        for q in dict.fromkeys(query):
            n = sum(q in d for d in docs.values())
            tf = 10.0 * words.count(q)
            score -= max(math.log((len(docs) - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if set(query) & set(words):
            want[i] = round(score, 9)
    got = retrieve.search(df, "economical walks", {"title": 10.0}, relaxed=True, limit=None, stem=True)
    assert {r.objectID: round(r.score, 9) for r in got.collect()} == want and want


def test_one_path_of_two_may_fail(spark):
    ok = lambda: spark.createDataFrame([(1, 0.5)], "objectID long, similarity double")
    late = lambda: ok().select(F.raise_error(F.lit("x")).cast("long").alias("objectID"), "similarity")
    got, status = vectors.locate({"label": ok, "image": late}, "objectID long, similarity double", spark)
    assert [tuple(r) for r in got.collect()] == [("label", 1, 0.5)] and status["label"] == "ok" and status["image"].startswith("failed")
    with pytest.raises(RuntimeError):
        vectors.locate({"image": late}, "objectID long, similarity double", spark)


def test_isolation_reaches_every_row(spark):
    previous = spark.createDataFrame([("a", 1), ("b", 2)], "source string, id long")
    second = lambda: spark.range(1, 100, 1, 1).select(F.lit("a").alias("source"), F.when(F.col("id") < 50, F.col("id")).otherwise(F.raise_error(F.lit("late"))).alias("id"))
    rows, status = delta.isolated({"a": second, "b": lambda: previous.where("source = 'b'")}, previous)
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 2)] and status["a"].startswith("stale")
