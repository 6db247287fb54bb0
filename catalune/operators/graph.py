"""Graphs: adjacency, components, shortest paths, repair, itineraries.

Large graphs are processed by relational rounds with their lineage cut through
the shared checkpoint folder; graphs that are small per site are solved in one
grouped call a site.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .shared import discard, written

PARTS = 2  # groups of a site's pairs in routes


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    cols = [c for c in edges.columns if c not in ("a", "b")]
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *cols))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, doors): 0 for nodes without edges."""
    ends = symmetric(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"), F.count_if(F.col("kind") == "door").alias("doors"))
    return nodes.select("id").join(ends, "id", "left").fillna(0, ["degree", "doors"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached.

    Each round takes the least label among a node and its neighbours and then
    the label of that label, so long chains shrink fast; it ends when the sum
    of labels' hashes stays.
    """
    both = written(symmetric(edges.select("a", "b")).distinct(), "edges")
    labels = written(nodes.select("id", F.col("id").alias("component")), "labels")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first())

    before = sign(labels)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("n"))
        least = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("n", "component")).alias("component"))
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("far"))
        old, labels = labels, written(least.join(jump, "component").select("id", F.col("far").alias("component")), "labels")
        discard(old)
        after = sign(labels)
        if after == before:
            discard(both)
            return labels
        before = after


def main_components(labelled: DataFrame, by: list[str]) -> DataFrame:
    """The largest component of each site; ties go to the smaller label."""
    n = labelled.groupBy(*by, "component").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "component")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, dist, hops) from any source, over the whole graph at once: rounds of relaxation from the changed nodes only, until none changes.

    Lengths must not be negative, so it ends after at most as many rounds as the longest shortest path has edges.
    """
    both = written(symmetric(edges.select("a", "b", "len")).groupBy("a", "b").agg(F.min("len").alias("len")), "edges")
    best = front = written(sources.select("id", F.lit(0.0).alias("dist"), F.lit(0).alias("hops")), "best")
    while True:
        reach = front.join(both, front.id == both.a).groupBy(F.col("b").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("len")).alias("dist"), (F.col("hops") + 1).alias("hops"))).alias("n"))
        better = written(reach.join(best.select("id", F.col("dist").alias("old")), "id", "left").where(F.col("old").isNull() | (F.col("n.dist") < F.col("old"))).select("id", "n.dist", "n.hops"), "front")
        if better.isEmpty():
            discard(both, better)
            return best
        old, best = best, written(best.join(better.select("id"), "id", "left_anti").unionByName(better), "best")
        discard(old)
        if front is not old:
            discard(front)
        front = better


def dijkstra(adjacent: dict, starts: list, goals: set, avoid: frozenset = frozenset()) -> tuple[list, float] | None:
    """(path, length) between the nearest start and goal, or None. Ties go to the smaller node."""
    known = {s: (0.0, None) for s in starts if s in adjacent}
    queue = [(0.0, s) for s in known]
    heapq.heapify(queue)
    done = set()
    while queue:
        d, at = heapq.heappop(queue)
        if at in done:
            continue
        done.add(at)
        if at in goals:
            path = [at]
            while known[path[-1]][1] is not None:
                path.append(known[path[-1]][1])
            return path[::-1], d
        for to, size, kind in adjacent[at]:
            if kind in avoid or to in done:
                continue
            if to not in known or d + size < known[to][0]:
                known[to] = (d + size, at)
                heapq.heappush(queue, (d + size, to))
    return None


class _Net:
    """A site's graph: nodes are numbered in the order of their ids; each node's ways run from short to long."""

    def __init__(self, edges: pa.Table) -> None:
        a, b = edges["a"].combine_chunks(), edges["b"].combine_chunks()
        ids = pa.concat_arrays([a, b]).unique()
        self.ids = ids.take(pc.sort_indices(ids))
        u, v = (pc.index_in(x, self.ids).to_numpy() for x in (a, b))
        size = edges["len"].cast(pa.float64()).to_numpy()
        u, v, size = np.concatenate((u, v)), np.concatenate((v, u)), np.concatenate((size, size))
        order = np.lexsort((v, size, u))
        self.first = np.searchsorted(u[order], np.arange(len(ids) + 1)).tolist()
        self.part = np.arange(len(ids))
        while len(u):  # least numbers within reach
            low = np.minimum(self.part[u], self.part[v])
            new = self.part.copy()
            np.minimum.at(new, self.part[u], low)
            new = new[new]
            if (new == self.part).all():
                break
            self.part = new
        # arrays of the standard library: their items are read faster than numpy's
        self.to, self.size = array("i", v[order].astype(np.int32).tobytes()), array("d", size[order].tobytes())

    def number(self, ids: pa.ChunkedArray) -> list:
        return pc.index_in(ids, self.ids).to_pylist()

    def _ball(self, known: dict, queue: list) -> tuple[int, float] | None:
        """Settles one node more of a search whose nodes offer one way at a time; (node, distance), or None at its end."""
        while queue:
            d, at, k, end, base = heapq.heappop(queue)
            if k >= 0:  # the node's next way
                if k + 1 < end:
                    heapq.heappush(queue, (base + self.size[k + 1], at, k + 1, end, base))
                at = self.to[k]
            if at in known:
                continue
            known[at] = d
            k, end = self.first[at], self.first[at + 1]
            if k < end:
                heapq.heappush(queue, (d + self.size[k], at, k, end, d))
            return at, d
        return None

    def route(self, source: int, target: int) -> tuple[list, float] | None:
        """What ``dijkstra`` finds from source to target, ties included.

        Two searches meet and so tell the length. The way is then searched as by
        ``dijkstra``, but a node counts only if the second search leaves room
        for it; nodes of shortest ways all do.
        """
        if self.part[source] != self.part[target]:
            return None
        near, far = known = ({}, {})
        queues = [(0.0, source, -1, -1, 0.0)], [(0.0, target, -1, -1, 0.0)]
        for k in (0, 1):
            self._ball(known[k], queues[k])
        best, reach = 0.0 if source == target else float("inf"), [0.0, 0.0]
        while sum(reach) < best:
            k = 0 if reach[0] <= reach[1] else 1
            got = self._ball(known[k], queues[k])
            if got is None:
                break
            at, reach[k] = got
            if at in known[1 - k]:
                best = min(best, near[at] + far[at])
        for at, d in near.items():  # the searches may also meet within an edge
            for w in range(self.first[at], self.first[at + 1]):
                if d + self.size[w] >= best:
                    break
                if self.to[w] in far:
                    best = min(best, d + self.size[w] + far[self.to[w]])
        most = best * (1 + 1e-9)  # sums from both ends may be rounded apart
        done, dist, queue = set(), {source: (0.0, None)}, [(0.0, source)]
        while queue:
            d, at = heapq.heappop(queue)
            if at in done:
                continue
            done.add(at)
            if at == target:
                path = [at]
                while dist[path[-1]][1] is not None:
                    path.append(dist[path[-1]][1])
                return path[::-1], d
            for w in range(self.first[at], self.first[at + 1]):
                there, to = d + self.size[w], self.to[w]
                if there > most:
                    break
                if to not in done and there + far.get(to, reach[1]) <= most and (to not in dist or there < dist[to][0]):
                    dist[to] = (there, at)
                    heapq.heappush(queue, (there, to))
        return None


def routes(edges: DataFrame, pairs: DataFrame, avoid: tuple[str, ...] = ()) -> DataFrame:
    """(site, pair, length, hops, path) of each pair (site, pair, source, target); length null if unreachable.

    Lengths must not be negative. A pair is searched from both ends, so it costs
    two balls of half its length. Each site is one group, at about 100 bytes an
    edge; ``distances`` serves graphs that do not fit a task. Pairs of a site are
    dealt to ``PARTS`` groups, each with the site's edges.
    """
    text = edges.select("a").schema["a"].dataType.simpleString()

    def solve(e: pa.Table, p: pa.Table) -> pa.Table:
        net = _Net(e)
        found = []
        for i, j, same in zip(net.number(p["source"]), net.number(p["target"]), pc.equal(p["source"], p["target"]).to_pylist(), strict=True):
            found.append(([], 0.0) if same else None if i is None or j is None else net.route(i, j))
        names = net.ids.to_pylist() if found else []
        ends = p["source"].to_pylist()
        paths = [None if f is None else [str(names[x]) for x in f[0]] or [str(s)] for f, s in zip(found, ends, strict=True)]
        cols = [p["site"], p["pair"], pa.array([f and f[1] for f in found], pa.float64()), pa.array([f and max(0, len(f[0]) - 1) for f in found], pa.int32()), pa.array(paths, pa.list_(pa.string()))]
        return pa.table(cols, names=["site", "pair", "length", "hops", "path"])

    site = edges.schema["site"].dataType.simpleString()
    pair = pairs.schema["pair"].dataType.simpleString()
    # every column is named anew, as pairs may come from the edges
    pairs = pairs.select(F.col("site").alias("site"), F.col("pair").alias("pair"), F.col("source").cast(text).alias("source"), F.col("target").cast(text).alias("target"), F.pmod(F.xxhash64("pair"), F.lit(PARTS)).alias("part"))
    walked = edges.where(~F.coalesce(F.col("kind").isin(*avoid), F.lit(False))) if avoid else edges
    walked = walked.dropna(subset=["a", "b", "len"]).select("site", "a", "b", "len", F.explode(F.array(*(F.lit(k).cast("long") for k in range(PARTS)))).alias("part"))
    return walked.groupBy("site", "part").cogroup(pairs.groupBy("site", "part")).applyInArrow(solve, f"site {site}, pair {pair}, length double, hops int, path array<string>")


def vertical_edges(stops: DataFrame, per_level: Column) -> DataFrame:
    """(shaft, a, b, len) between consecutive floors of a shaft; same floors are skipped. stops: (shaft, id, floor, kind)."""
    w = Window.partitionBy("shaft").orderBy("floor", "id")
    j = stops.withColumns({"b": F.lead("id").over(w), "_f": F.lead("floor").over(w)})
    return j.where(F.col("b").isNotNull() & (F.col("_f") != F.col("floor"))).select("shaft", F.col("id").alias("a"), "b", (per_level * (F.col("_f") - F.col("floor"))).alias("len"))


def nearby_pairs(points: DataFrame, keys: list[str], distance: float, same: bool = True, dist: Callable | None = None) -> DataFrame:
    """(a, b, d): pairs of (id, x, y, *keys) at most ``distance`` apart, by a grid: each point meets its own and adjacent cells only."""
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    p = points.withColumns({"_i": cell("x"), "_j": cell("y")})
    around = F.array(*(F.struct((F.col("_i") + di).alias("i"), (F.col("_j") + dj).alias("j")) for di in (-1, 0, 1) for dj in (-1, 0, 1)))
    a = p.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *keys, F.inline(around).alias("i", "j"))
    b = p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), *keys, F.col("_i").alias("i"), F.col("_j").alias("j"))
    j = a.join(b, [*keys, "i", "j"]).where("a < b") if same else a.join(b, [*keys, "i", "j"]).where("a <> b")
    d = dist(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) if dist else F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return j.withColumn("d", d).where(F.col("d") <= distance).select("a", "b", *keys, "d")


def _waves(links: pa.Table, starts: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The ends of links (a, b) and for each the least number of links from a start, -1 if there is no way."""
    a, b, s = links["a"].combine_chunks(), links["b"].combine_chunks(), starts["a"].combine_chunks()
    ids = pa.concat_arrays([a, b, s]).unique()
    u, v, front = (pc.index_in(x, ids).to_numpy() for x in (a, b, s))
    order = np.argsort(u, kind="stable")
    v, first = v[order], np.searchsorted(u[order], np.arange(len(ids) + 1))
    level = np.full(len(ids), -1)
    level[front] = wave = 0
    while len(front):
        wave += 1
        sizes = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        front = np.unique(v[at])
        front = front[level[front] < 0]
        level[front] = wave
    return ids, level


def repair(nodes: DataFrame, edges: DataFrame, by: list[str], distance: float, passes: int | None = None) -> DataFrame:
    """Edges with bridges added, pass after pass until none is found, or ``passes`` of them.

    In a pass each node outside its site's main component gets the shortest link
    to a node of it within ``distance``; ties go to the smaller id. Labels hold
    within a pass. Edges are taken to stay within a site.

    A main component only grows, so a component joins it in the pass that is its
    least number of steps from it, over components with nodes near each other. A
    walk in waves a site tells these passes at once, however many there are; a
    node then links to the nearest node of a component of the pass before. A
    site's pairs of near components must fit a task, at about 50 bytes each.
    """
    lab = written(components(nodes, edges).join(nodes.select("id", *by), "id"))
    main = main_components(lab, by)
    close = nearby_pairs(nodes.select("id", "x", "y", *by), by, distance, same=False).select("a", "b", "d")
    of = lambda x: lab.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    close = written(close.join(of("a"), "a").join(lab.select(F.col("id").alias("b"), F.col("component").alias("cb"), *by), "b").where("ca <> cb"))
    site = F.xxhash64(*by).alias("_site")
    kind = lab.schema["component"].dataType.simpleString()

    def walk(links: pa.Table, starts: pa.Table) -> pa.Table:
        ids, level = _waves(links, starts)
        return pa.table({"component": ids, "_pass": pa.array(level, pa.int64())})

    links = close.select(site, F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    starts = main.select(site, F.col("component").alias("a"))
    waves = links.groupBy("_site").cogroup(starts.groupBy("_site")).applyInArrow(walk, f"component {kind}, _pass long").where("_pass >= 0")
    waves = written(waves)
    wave = lambda c, p: waves.select(F.col("component").alias(c), F.col("_pass").alias(p))
    met = close.join(wave("ca", "_pa"), "ca").join(wave("cb", "_pb"), "cb").where("_pb = _pa - 1")
    if passes is not None:
        met = met.where(F.col("_pa") <= passes)
    new = met.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", "m.b", F.col("m.d").alias("len"), F.lit("bridge").alias("kind"))
    return edges.unionByName(new, allowMissingColumns=True)


def prune(nodes: DataFrame, edges: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the main components only."""
    lab = components(nodes, edges).join(nodes.select("id", *by), "id")
    top = main_components(lab, by).select(*by, "component")
    kept = lab.join(top, [*by, "component"], "left_semi").select("id")
    ends = kept.select(F.col("id").alias("a"))
    return nodes.join(kept, "id", "left_semi"), edges.join(ends, "a", "left_semi").join(kept.select(F.col("id").alias("b")), "b", "left_semi")


def accounting(rooms: DataFrame, matched: DataFrame, reachable: DataFrame, key: str = "id") -> DataFrame:
    """Each room as reachable, stranded or unmatched."""
    j = rooms.join(matched.select(key).distinct().withColumn("_m", F.lit(True)), key, "left").join(reachable.select(key).distinct().withColumn("_r", F.lit(True)), key, "left")
    return j.withColumn("status", F.when(F.col("_r"), "reachable").when(F.col("_m"), "stranded").otherwise("unmatched")).drop("_m", "_r")


def runs(df: DataFrame, by: list[str], order: str, same: list[str]) -> DataFrame:
    """A run number for consecutive rows with equal ``same`` columns (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    key = F.struct(*same)
    change = F.when(F.lag(key).over(w).eqNullSafe(key), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).drop("_c")


def itinerary(visits: DataFrame, by: list[str], order: str) -> DataFrame:
    """Steps of a route: consecutive visits to one space merge; a ride over several floors is one step, at its last row.

    visits: (space, kind, floor, bearing); kind is walk, stairs or elevator.
    """
    v = runs(visits.withColumn("_s", F.when(F.col("kind") == "walk", F.col("space")).otherwise(F.lit(None).cast("string"))), by, order, ["kind", "_s"]).drop("_s")
    g = v.groupBy(*by, "run").agg(F.max_by(F.struct("space", "kind", "floor", "bearing"), order).alias("s"), F.count("*").alias("merged"))
    g = g.select(*by, "run", "s.space", "s.kind", "s.floor", "s.bearing", "merged")
    w = Window.partitionBy(*by).orderBy("run")
    last = F.lead("run").over(w).isNull()
    text = (
        F.when(F.col("kind") != "walk", F.concat(F.lit("Take the "), F.col("kind"), F.lit(" to floor "), F.col("floor").cast("int").cast("string")))
        .when(F.lag("run").over(w).isNull(), F.concat(F.lit("Start in "), F.col("space")))
        .when(last, F.concat(F.lit("Arrive at "), F.col("space")))
        .otherwise(F.concat(F.lit("Exit through the "), F.coalesce(geo.compass(F.col("bearing") + 180), F.lit("next")), F.lit(" door into "), F.col("space")))
    )
    return g.withColumn("instruction", text)


def cluster_doors(doors: DataFrame, by: list[str], distance: float = 3.0) -> DataFrame:
    """(by…, cluster, x, y, members): greedy single-link clusters in input order; they are not merged later. doors: (ordinal, x, y)."""

    def cluster(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ordinal")
        groups: list[list[tuple[float, float]]] = []
        for x, y in zip(p.x, p.y, strict=True):
            for g in groups:
                if any((x - a) ** 2 + (y - b) ** 2 <= distance**2 for a, b in g):
                    g.append((x, y))
                    break
            else:
                groups.append([(x, y)])
        out = pd.DataFrame({"cluster": range(len(groups)), "x": [sum(a for a, _ in g) / len(g) for g in groups], "y": [sum(b for _, b in g) / len(g) for g in groups], "members": [len(g) for g in groups]})
        for k, c in enumerate(by):
            out.insert(k, c, p[c].iloc[0])
        return out

    kinds = ", ".join(f"{c} {doors.schema[c].dataType.simpleString()}" for c in by)
    return doors.groupBy(*by).applyInPandas(cluster, f"{kinds}, cluster int, x double, y double, members int")


def door_edges(doors: DataFrame, spaces: DataFrame, metres_x: float, metres_y: float) -> DataFrame:
    """(a, b, len, bearing): an edge from each door to the centre of each of its spaces, to 0.1 m and whole degrees.

    doors: (door, lon, lat, space), a row a space; spaces: (space, lon, lat). metres_x and metres_y: metres a degree.
    """
    s = spaces.select("space", F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    j = doors.join(s, "space")
    size = geo.haversine(F.col("lat"), F.col("lon"), F.col("_y"), F.col("_x"))
    turn = geo.bearing((F.col("_x") - F.col("lon")) * metres_x, (F.col("_y") - F.col("lat")) * metres_y)
    return j.select(F.col("door").alias("a"), F.col("space").alias("b"), (F.floor(size * 10 + 0.5) / 10).alias("len"), F.floor(turn + 0.5).cast("int").alias("bearing"))


def walk_edges(doors: DataFrame, metres_x: float, metres_y: float) -> DataFrame:
    """(a, b, room, len): the straight way between any two doors of a space, to 0.1 m. doors as above; their number a space is the result's size."""
    m = doors.select("space", "door", (F.col("lon") * metres_x).alias("x"), (F.col("lat") * metres_y).alias("y"))
    a, b = m.alias("a"), m.alias("b")
    size = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    j = a.join(b, (F.col("a.space") == F.col("b.space")) & (F.col("a.door") < F.col("b.door")))
    return j.select(F.col("a.door").alias("a"), F.col("b.door").alias("b"), F.col("a.space").alias("room"), (F.floor(size * 10 + 0.5) / 10).alias("len"))


def resolve_endpoints(refs: DataFrame, galleries: DataFrame, amenities: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref, node, via): a reference as a gallery, else an amenity, else a node id, else a legacy alias.

    galleries (gallery, node), amenities (amenity, node), nodes (id), aliases (alias, node); keys are unique.
    """
    out = refs.join(galleries.select(F.col("gallery").alias("ref"), F.col("node").alias("_g")), "ref", "left")
    out = out.join(amenities.select(F.col("amenity").alias("ref"), F.col("node").alias("_a")), "ref", "left")
    out = out.join(nodes.select(F.col("id").alias("ref"), F.col("id").alias("_n")), "ref", "left")
    out = out.join(aliases.select(F.col("alias").alias("ref"), F.col("node").alias("_l")), "ref", "left")
    via = F.when(F.col("_g").isNotNull(), "gallery").when(F.col("_a").isNotNull(), "amenity").when(F.col("_n").isNotNull(), "node").when(F.col("_l").isNotNull(), "alias")
    return out.select("ref", F.coalesce("_g", "_a", "_n", "_l").alias("node"), via.alias("via"))


def add_steps(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges and those steps (a, b, len, same_floor) that join a pair not joined yet; each unordered pair once, walks on one floor."""
    pair = lambda df: df.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")})
    own = pair(edges).select("_x", "_y").distinct()
    new = pair(steps).where("a <> b").groupBy("_x", "_y").agg(F.min("len").alias("len"), F.max("same_floor").alias("same_floor"))
    new = new.join(own, ["_x", "_y"], "left_anti").select(F.col("_x").alias("a"), F.col("_y").alias("b"), "len", F.when(F.col("same_floor"), "walk").otherwise("stairs").alias("kind"))
    return edges.select("a", "b", "len", "kind").unionByName(new)


def match_names(rooms: DataFrame, index: DataFrame) -> DataFrame:
    """(id, code, via): a room's explicit code if the index has it, else the one code that its name variants lead to.

    rooms: (id, code, variants array<string>); index: (code, name, tier). The lowest tier with exactly one code
    decides; a tier with several codes decides nothing and closes the search.
    """
    codes = index.select(F.col("code").alias("_c")).distinct()
    out = rooms.join(codes, F.col("code") == F.col("_c"), "left")
    named = rooms.select("id", F.explode("variants").alias("name")).distinct().join(index.withColumnRenamed("code", "_n"), "name")
    tiers = named.groupBy("id", "tier").agg(F.count_distinct("_n").alias("n"), F.min("_n").alias("_n"))
    best = tiers.groupBy("id").agg(F.min_by(F.when(F.col("n") == 1, F.col("_n")), "tier").alias("_n"))
    out = out.join(best, "id", "left")
    via = F.when(F.col("_c").isNotNull(), "code").when(F.col("_n").isNotNull(), "name")
    return out.select("id", F.coalesce("_c", "_n").alias("code"), via.alias("via"))
