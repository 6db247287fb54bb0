"""Graph repair against the plain loop over spaces."""

from pyspark.sql import functions as F

from catalune import registry
from catalune.operators import graph


def _repaired(nodes, edges, distance):
    """Bridges by the loop; nodes: id -> (x, y, site)."""
    near, found, rounds = {i: set() for i in nodes}, set(), 0
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    while True:
        comp = {}
        for i in sorted(nodes):
            stack = [] if i in comp else [i]
            while stack:
                k = stack.pop()
                if k not in comp:
                    comp[k] = i
                    stack += near[k]
        size = {}
        for i, c in comp.items():
            size[nodes[i][2], c] = size.get((nodes[i][2], c), 0) + 1
        main = {s: min((-n, c) for (t, c), n in size.items() if t == s)[1] for s in {x[2] for x in nodes.values()}}
        new = set()
        for i, (x, y, s) in nodes.items():
            if comp[i] != main[s]:
                d = [(((x - u) ** 2 + (y - v) ** 2) ** 0.5, k) for k, (u, v, t) in nodes.items() if t == s and comp[k] == main[s]]
                if d and min(d)[0] <= distance:
                    new.add((i, min(d)[1]))
        if not new:
            return found, rounds
        rounds += 1
        found |= new
        for a, b in new:
            near[a].add(b)
            near[b].add(a)


def test_repair_runs_to_the_end(spark):
    at = {i: (float(i), 0.0, 0) for i in range(1, 8)} | {20: (1.0, 1.0, 0), 21: (2.0, 1.0, 0), 30: (50.0, 0.0, 0), 40: (0.0, 0.0, 1), 41: (0.0, 1.0, 1), 42: (0.0, 2.0, 1)}
    edges = [(1, 2), (2, 3), (20, 21)]
    want, rounds = _repaired(at, edges, 1.25)
    assert rounds > 3 and {(20, 1), (21, 2)} <= want
    n = spark.createDataFrame([(i, *v) for i, v in at.items()], "id long, x double, y double, site int")
    e = spark.createDataFrame([(a, b, 1.0, "walk") for a, b in edges], "a long, b long, len double, kind string")
    got = graph.repair(n, e, ["site"], 1.25)
    assert sorted((r.a, r.b) for r in got.where("kind = 'bridge'").collect()) == sorted(want)


def test_repaired_graph_is_whole(spark, tmp_path):
    spark.range(1, 81).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    at = {i: (float(i % 10), float(i // 10), i % 2) for i in range(1, 81)}
    edges = [(i, i + 2) for i in at if i % 10 in (0, 1, 4, 5) and i + 2 in at]
    want, rounds = _repaired(at, edges, 2.0)
    assert rounds > 2
    rows = registry.queries()["repaired_graph"](spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b) for r in rows if r.kind == "bridge") == sorted(want)
    assert sorted((r.a, r.b) for r in rows if r.kind != "bridge") == sorted(edges)


def test_repair_has_no_last_pass(spark, tmp_path):
    """More rounds than 200, where repair once stopped."""
    n = 5000
    spark.range(1, n + 1).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = registry.queries()["repaired_graph"](spark, str(tmp_path)).where("kind = 'bridge'").collect()
    edges = [(i, i + 2) for i in range(1, n + 1) if i % 10 in (0, 1, 4, 5) and i + 2 <= n]
    comp = {i: i for i in range(1, n + 1)} | {b: a for a, b in edges}
    near = lambda i: (j for j in (i - 20, i - 10, i - 2, i + 2, i + 10, i + 20) if 0 < j <= n and (abs(i - j) != 2 or i // 10 == j // 10))
    done = {i for i in comp if comp[i] in (1, 4)}  # all components of two are as large: the first of each site
    want, rounds = set(), 0
    while True:
        new = {(i, min((abs(i - j) // 10 or 2, j) for j in near(i) if j in done)[1]) for i in comp if i not in done and any(j in done for j in near(i))}
        if not new:
            break
        want, rounds, joined = want | new, rounds + 1, {comp[a] for a, _ in new}
        done |= {i for i in comp if comp[i] in joined}
    assert rounds > 200
    assert {(r.a, r.b) for r in rows} == want
