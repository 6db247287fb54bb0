"""Graph queries over a bipartite graph of suppliers and parts, and the nation tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph
from ..operators.shared import written
from ..registry import query, table

_G = """e AS (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b, min(l_quantity) AS len, CASE WHEN min(l_returnflag) = 'A' THEN 'stairs' ELSE 'walk' END AS kind, l_suppkey % 4 AS site FROM lineitem GROUP BY l_suppkey, l_partkey),
    n AS (SELECT DISTINCT id FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e)), both_ AS (SELECT a, b, len, kind FROM e UNION ALL SELECT b, a, len, kind FROM e)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity").alias("len"), F.min("l_returnflag").alias("f"))
    return e.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"), "len", F.when(F.col("f") == "A", "stairs").otherwise("walk").alias("kind"), (F.col("l_suppkey") % 4).alias("site"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()


@query(f"WITH {_G} SELECT id, count(*) AS degree FROM n JOIN both_ ON a = id GROUP BY id")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees over both directions."""
    e = _edges(spark, sf_dir)
    return graph.degrees(_nodes(e), e).select("id", "degree")


@query(f"WITH RECURSIVE {_G}, r(id, root) USING KEY (id) AS (SELECT id, id AS root FROM n UNION (SELECT b AS id, min(r.root) AS root FROM r JOIN both_ ON a = r.id JOIN recurring.r AS k ON k.id = both_.b WHERE r.root < k.root GROUP BY b)) SELECT id, min(root) AS component FROM r GROUP BY id")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest reachable id."""
    e = _edges(spark, sf_dir)
    return graph.components(_nodes(e), e)


@query(f"WITH RECURSIVE {_G}, r(id, root) USING KEY (id) AS (SELECT id, id AS root FROM n UNION (SELECT b AS id, min(r.root) AS root FROM r JOIN both_ ON a = r.id JOIN recurring.r AS k ON k.id = both_.b WHERE r.root < k.root GROUP BY b)), c AS (SELECT id, min(root) AS component FROM r GROUP BY id), g AS (SELECT substr(id, 1, 1) AS site, component, count(*) AS n FROM c GROUP BY ALL) SELECT site, component, n FROM g QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, component) = 1")
def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest component of each site."""
    e = _edges(spark, sf_dir)
    lab = graph.components(_nodes(e), e).withColumn("site", F.substring("id", 1, 1))
    return graph.main_components(lab, ["site"])


@query(f"""WITH RECURSIVE {_G}, d(id, dist) USING KEY (id) AS (SELECT min(id) AS id, 0.0::DOUBLE AS dist FROM n UNION (SELECT b AS id, min(d.dist + len) AS dist FROM d JOIN both_ ON a = d.id LEFT JOIN recurring.d AS k ON k.id = both_.b WHERE k.dist IS NULL OR d.dist + len < k.dist GROUP BY b)) SELECT id, dist FROM d""")
def graph_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from the smallest node, by rounds of relaxation."""
    e = _edges(spark, sf_dir)
    start = _nodes(e).agg(F.min("id").alias("id"))
    return graph.distances(e, start).select("id", "dist")


@query()
def shortest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of numbered pairs within sites, without stairs (tested against brute force)."""
    e = _edges(spark, sf_dir)
    s = e.select("site", F.col("a").alias("source")).distinct().withColumn("pair", F.row_number().over(Window.partitionBy("site").orderBy("source")))
    t = s.select("site", F.col("source").alias("target"), (F.col("pair") - 1).alias("pair"))
    return graph.routes(e, s.join(t, ["site", "pair"]), avoid=("stairs",)).select("site", "pair", "length", "hops")


@query("SELECT shaft, a, b, len FROM (SELECT n_regionkey AS shaft, n_nationkey AS a, lead(n_nationkey) OVER w AS b, CASE WHEN n_regionkey % 2 = 0 THEN 15.0 ELSE 25.0 END::DOUBLE * (lead(n_nationkey // 7) OVER w - n_nationkey // 7) AS len FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey // 7, n_nationkey)) WHERE b IS NOT NULL AND len <> 0")
def vertical_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between consecutive floors of a shaft."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("shaft"), F.col("n_nationkey").alias("id"), F.floor(F.col("n_nationkey") / 7).alias("floor"))
    return graph.vertical_edges(n, F.when(F.col("shaft") % 2 == 0, 15.0).otherwise(25.0))


@query("SELECT s_suppkey AS id, CASE CAST(floor((d % 360) / 45 + 0.5) AS BIGINT) % 8 WHEN 0 THEN 'north' WHEN 1 THEN 'northeast' WHEN 2 THEN 'east' WHEN 3 THEN 'southeast' WHEN 4 THEN 'south' WHEN 5 THEN 'southwest' WHEN 6 THEN 'west' ELSE 'northwest' END AS direction, CASE WHEN f IS NULL THEN '' WHEN f = 0 THEN 'G' WHEN f = 1.5 THEN '1M' WHEN f <> floor(f) THEN CAST(f AS VARCHAR) ELSE CAST(CAST(floor(f) AS INT) AS VARCHAR) END AS floor FROM (SELECT s_suppkey, s_suppkey * 7.5 + 720 AS d, CASE WHEN s_nationkey % 6 = 5 THEN NULL ELSE s_nationkey % 6 / 2.0 END AS f FROM supplier)")
def compass_and_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction names and floor labels."""
    s = table(spark, sf_dir, "supplier")
    f = F.when(F.col("s_nationkey") % 6 == 5, None).otherwise(F.col("s_nationkey") % 6 / 2.0)
    return s.select(F.col("s_suppkey").alias("id"), geo.compass(F.col("s_suppkey") * 7.5 - 720).alias("direction"), geo.floor_label(f, F.lit("G")).alias("floor"))


@query("WITH c AS (SELECT conv_id, turn, role FROM conversations), x AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS ch FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), y AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM x) SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, count(*) AS turns, min(turn) AS first, max(turn) AS last FROM y GROUP BY ALL")
def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive rows of one kind merged."""
    r = graph.runs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", ["role"])
    return r.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"))


@query()
def route_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Itineraries of routes read from the event stream (spaces from types, rides from errors)."""
    e = table(spark, sf_dir, "events")
    v = e.select("user_id", "event_id", F.col("event_type").alias("space"), F.when(F.col("event_type") == "error", "stairs").otherwise("walk").alias("kind"), F.floor(F.col("value") / 50).alias("floor"), (F.col("value") * 3).alias("bearing"))
    return graph.itinerary(v, ["user_id"], "event_id").select("user_id", "run", "kind", "merged", "instruction")


@query("SELECT a.c_custkey AS a, b.c_custkey AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM (SELECT c_custkey, c_acctbal / 10 AS x, c_custkey * 37 % 1000 AS y, c_nationkey FROM customer) a JOIN (SELECT c_custkey, c_acctbal / 10 AS x, c_custkey * 37 % 1000 AS y, c_nationkey FROM customer) b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25")
def nearby_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a distance, by a grid instead of all pairs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("y"), "c_nationkey")
    return graph.nearby_pairs(c, ["c_nationkey"], 25.0).select("a", "b", F.round("d", 6).alias("d"))


def _plane(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10 * 1.0).alias("x"), F.floor(F.col("s_suppkey") / 10).cast("double").alias("y"), (F.col("s_suppkey") % 2).alias("site"))
    edges = nodes.where("id % 10 in (0, 1, 4, 5)").select(F.col("id").alias("a"), (F.col("id") + 2).alias("b"), F.lit(2.0).alias("len"), F.lit("walk").alias("kind")).join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "len", "kind")
    return nodes, edges


@query()
def repaired_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strays bridged to the main component of their site, pass by pass."""
    nodes, edges = _plane(spark, sf_dir)
    return graph.repair(nodes, edges, ["site"], 2.0).select("a", "b", "kind")


@query("WITH RECURSIVE n AS (SELECT s_suppkey AS id, s_suppkey % 2 AS site FROM supplier), e AS (SELECT id AS a, id + 2 AS b FROM n WHERE id % 10 IN (0, 1, 4, 5) AND id + 2 IN (SELECT id FROM n)), bo AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT id, id AS root FROM n UNION SELECT b, root FROM r JOIN bo ON a = r.id), c AS (SELECT id, min(root) AS component FROM r GROUP BY id), k AS (SELECT site, component, count(*) AS k FROM c JOIN n USING (id) GROUP BY ALL), g AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY site ORDER BY k DESC, component) = 1) SELECT id FROM c JOIN n USING (id) JOIN g USING (site, component)")
def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the main components."""
    nodes, edges = _plane(spark, sf_dir)
    return graph.prune(nodes, edges, ["site"])[0].select("id")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'reachable' WHEN n_nationkey % 2 = 0 THEN 'stranded' ELSE 'unmatched' END AS status FROM nation")
def room_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms as reachable, stranded or unmatched."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return graph.accounting(n, n.where("id % 2 = 0"), n.where("id % 6 = 0"))


@query("WITH RECURSIVE l AS (SELECT user_id AS a, CAST(json_extract(props, '$.k') AS BIGINT) AS b FROM events), r AS (SELECT 1::BIGINT AS page UNION SELECT b FROM r JOIN l ON a = page) SELECT page FROM r")
def crawled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages reachable over links from a start page."""
    links = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b")).distinct()
    return reachable(links, 1)


def reachable(links: DataFrame, start: int) -> DataFrame:
    """(page) by rounds from a start, each round from the pages found last."""
    spark = links.sparkSession
    links = written(links, "links")
    seen = written(spark.createDataFrame([(start,)], "page long"), "seen")
    front = seen
    while True:
        new = written(front.join(links, front.page == links.a).select(F.col("b").alias("page")).where("page is not null").distinct().join(seen, "page", "left_anti"), "front")
        if new.isEmpty():
            return seen
        seen, front = written(seen.unionByName(new), "seen"), new


@query("SELECT user_id, room, dist, row_number() OVER (PARTITION BY user_id ORDER BY dist NULLS LAST, room) AS place FROM (SELECT user_id, event_type AS room, min(CASE WHEN value > 60 THEN NULL ELSE value END) AS dist FROM events GROUP BY ALL)")
def nearest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by distance, unreachable ones last."""
    d = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("room")).agg(F.min(F.when(F.col("value") <= 60, F.col("value"))).alias("dist"))
    w = Window.partitionBy("user_id").orderBy(F.col("dist").asc_nulls_last(), "room")
    return d.withColumn("place", F.row_number().over(w))


@query()
def door_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy doorway clusters, in input order (order-dependent: no SQL twin)."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("ordinal"), (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))
    out = graph.cluster_doors(c, ["c_nationkey"])
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("SELECT pair, walked, straight, walked >= 0.95 * straight AND walked <= greatest(3.5 * straight, straight + 150) AS sane FROM (SELECT o_orderkey AS pair, o_totalprice / 1000 AS walked, o_custkey / 5.0::DOUBLE AS straight FROM orders)")
def landmark_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walked lengths within sane bounds of straight ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pair"), (F.col("o_totalprice") / 1000).alias("walked"), (F.col("o_custkey") / 5.0).alias("straight"))
    return o.withColumn("sane", F.col("walked").between(0.95 * F.col("straight"), F.greatest(3.5 * F.col("straight"), F.col("straight") + 150)))


@query("WITH r AS (SELECT 'x' || o_custkey % 40 AS ref, o_orderkey AS k FROM orders UNION ALL SELECT CAST(o_custkey % 40 AS VARCHAR), o_orderkey + 1000000 FROM orders) SELECT k, ref, CASE WHEN ref LIKE 'x%' THEN CASE WHEN CAST(substr(ref, 2) AS INT) < 5 THEN 'g' || substr(ref, 2) WHEN CAST(substr(ref, 2) AS INT) < 10 THEN 'a' || substr(ref, 2) WHEN CAST(substr(ref, 2) AS INT) BETWEEN 30 AND 34 THEN 'l' || substr(ref, 2) END WHEN CAST(ref AS INT) < 25 THEN ref END AS node FROM r")
def resolved_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints as gallery, amenity, node or alias."""
    o = table(spark, sf_dir, "orders")
    n = (F.col("o_custkey") % 40).cast("string")
    refs = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("x"), n).alias("ref")).unionByName(o.select((F.col("o_orderkey") + 1_000_000).alias("k"), n.alias("ref")))
    ids = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_nationkey").cast("string").alias("id"))
    named = lambda df, key, mark: df.select(F.concat(F.lit("x"), "id").alias(key), F.concat(F.lit(mark), "id").alias("node"))
    late = ids.where("i < 5").select((F.col("i") + 30).cast("string").alias("id"))
    return graph.resolve_endpoints(refs.select("ref").distinct(), named(ids.where("i < 5"), "gallery", "g"), named(ids.where("i < 10"), "amenity", "a"), ids, named(late, "alias", "l")).join(refs, "ref").select("k", "ref", "node")


@query("WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, min(l_quantity) AS len FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), s AS (SELECT least(l_partkey, l_suppkey) AS x, greatest(l_partkey, l_suppkey) AS y, min(l_tax) AS len, bool_or(l_linestatus = 'O') AS f FROM lineitem WHERE l_returnflag = 'A' AND l_partkey <> l_suppkey GROUP BY ALL) SELECT a, b, len, 'walk' AS kind FROM e UNION ALL SELECT x, y, len, CASE WHEN f THEN 'walk' ELSE 'stairs' END FROM s WHERE (x, y) NOT IN (SELECT (least(a, b), greatest(a, b)) FROM e)")
def step_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps for pairs that no edge joins."""
    rows = table(spark, sf_dir, "lineitem")
    e = rows.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.min("l_quantity").alias("len")).withColumn("kind", F.lit("walk"))
    s = rows.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_tax").alias("len"), (F.col("l_linestatus") == "O").alias("same_floor"))
    return graph.add_steps(e, s)


@query("WITH r AS (SELECT c_custkey AS id, 'c' || c_custkey % 30 AS code, [c_mktsegment, 'n' || c_custkey % 50] AS v FROM customer), i AS (SELECT 'c' || n_nationkey AS code, 'n' || n_nationkey // 2 * 2 AS name, CASE WHEN n_nationkey < 10 THEN 0 ELSE 1 END AS tier FROM nation UNION ALL SELECT 'c' || n_nationkey, 'n' || n_nationkey + 25, 0 FROM nation), n AS (SELECT id, tier, count(DISTINCT i.code) AS k, min(i.code) AS c FROM (SELECT DISTINCT id, unnest(v) AS name FROM r) JOIN i USING (name) GROUP BY ALL), b AS (SELECT id, arg_min(CASE WHEN k = 1 THEN c ELSE '' END, tier) AS c FROM n GROUP BY id) SELECT r.id, CASE WHEN r.code IN (SELECT code FROM i) THEN r.code ELSE nullif(b.c, '') END AS code, CASE WHEN r.code IN (SELECT code FROM i) THEN 'code' WHEN nullif(b.c, '') IS NOT NULL THEN 'name' END AS via FROM r LEFT JOIN b USING (id)")
def matched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms matched by code, else by an unambiguous name."""
    k = F.col("c_custkey")
    tag = lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    rooms = table(spark, sf_dir, "customer").select(k.alias("id"), tag("c", k % 30).alias("code"), F.array(F.col("c_mktsegment"), tag("n", k % 50)).alias("variants"))
    n = table(spark, sf_dir, "nation").withColumn("n", F.col("n_nationkey"))
    index = n.select(tag("c", F.col("n")).alias("code"), tag("n", (F.floor(F.col("n") / 2) * 2)).alias("name"), F.when(F.col("n") < 10, 0).otherwise(1).alias("tier"))
    index = index.unionByName(n.select(tag("c", F.col("n")).alias("code"), tag("n", F.col("n") + 25).alias("name"), F.lit(0).alias("tier")))
    return graph.match_names(rooms, index)
