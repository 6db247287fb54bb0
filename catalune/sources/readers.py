"""Readers and parsers of raw inputs: JSON, NDJSON logs, CSV, GeoJSON, XML pages, HTML, sitemaps, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array file, compressed or not, with a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_log(spark: SparkSession, path: str, schema: str, key: str, keep: str = "last") -> DataFrame:
    """An NDJSON resume log, one row a key: the first or last line wins. Broken lines are skipped."""
    lines = spark.read.text(path).withColumn("_at", F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")))
    rows = lines.select("_at", F.from_json("value", schema).alias("r")).where(F.col("r").isNotNull()).where(F.col(f"r.{key}").isNotNull())
    pick = F.min_by if keep == "first" else F.max_by
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(pick("r", "_at").alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """RFC 4180: quotes, embedded newlines, doubled quotes; short rows and empty fields read as ''."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return df.fillna("")


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """A GeoJSON collection, one row a feature: kind, properties…, rings (arrays of points x, y)."""
    schema = f"features array<struct<properties:struct<{properties}>, geometry:struct<type:string, coordinates:array<array<array<double>>>>>>"
    return feature_rows(spark.read.schema(schema).json(path, multiLine=True))


def feature_rows(collections: DataFrame) -> DataFrame:
    """The same of parsed collections (features)."""
    f = collections.select(F.explode("features").alias("f"))
    rings = F.transform("f.geometry.coordinates", lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select(F.col("f.geometry.type").alias("kind"), "f.properties.*", rings.alias("rings"))


def oai_records(pages: DataFrame, c: str = "xml") -> DataFrame:
    """Records of harvested XML pages: (identifier, datestamp, deleted, token, total)."""
    rec = F.explode(F.regexp_extract_all(c, F.lit(r"(?s)(<record>.*?</record>)"), F.lit(1))).alias("r")
    head = pages.select(F.regexp_extract(c, r"<resumptionToken[^>]*>([^<]*)<", 1).alias("token"), F.regexp_extract(c, r'completeListSize="(\d+)"', 1).try_cast("long").alias("total"), rec)
    return head.select(F.regexp_extract("r", r"<identifier>([^<]*)<", 1).alias("identifier"), F.regexp_extract("r", r"<datestamp>([^<]*)<", 1).alias("datestamp"), F.col("r").rlike(r'<header[^>]*status="deleted"').alias("deleted"), "token", "total")


def guard(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` if every check holds for at least one row; an error names the first that fails (the page's structure drifted)."""
    got = df.agg(*(F.count_if(v).alias(k) for k, v in checks.items())).first().asDict()
    bad = [k for k, n in got.items() if not n]
    if bad:
        raise ValueError(f"no row passes: {', '.join(bad)}")
    return df


def pick_language(values: Column, languages: tuple[str, ...]) -> Column:
    """The content of the first entry in the preferred languages' order, else of the first entry. values: array<struct<language, content>>."""
    own = [F.try_element_at(_in_language(values, lang), F.lit(1))["content"] for lang in languages]
    return F.coalesce(*own, F.try_element_at(values, F.lit(1))["content"])


def _in_language(values: Column, lang: str) -> Column:
    return F.filter(values, lambda v: v["language"] == lang)


def field_value(html: Column, label: str) -> Column:
    """The value cell that follows a label cell, as plain text."""
    return tx.strip_markup(F.regexp_extract(html, rf"(?is)>\s*{label}\s*:?\s*</[^>]+>\s*<(\w+)[^>]*>(.*?)</\1>", 2))


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, links) of web pages."""
    title = tx.strip_markup(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", title.alias("title"), F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("lang"), F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1)).alias("links"))


def sitemap_slugs(maps: DataFrame, c: str = "xml") -> DataFrame:
    """(slug, pos): last path parts of <loc> entries, each at its first place."""
    locs = maps.select(F.posexplode(F.regexp_extract_all(c, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("pos", "url"))
    slug = F.regexp_extract("url", r"([^/]+)/?$", 1)
    return locs.select(slug.alias("slug"), "pos").where("slug <> ''").groupBy("slug").agg(F.min("pos").alias("pos"))


def property_rows(pairs: DataFrame, spec: list[str]) -> DataFrame:
    """One row a subject from (subject, prop, value, ordinal): the first value of each property in the spec."""
    aggs = [F.min_by("value", F.when(F.col("prop") == p, F.col("ordinal"))).alias(p) for p in spec]
    return pairs.groupBy("subject").agg(*aggs)


def walk_json(df: DataFrame, c: str, key: str) -> DataFrame:
    """(path, value): every value under a key, at any depth, by exploding variants level by level until none is nested."""
    level = df.select(F.lit("$").alias("path"), F.try_parse_json(F.col(c)).alias("v"))
    found = None
    for _ in range(32):
        level.createOrReplaceTempView("_walk_level")
        nxt = df.sparkSession.sql("SELECT concat(path, '.', coalesce(t.key, cast(t.pos as string))) AS path, t.key AS k, t.value AS v FROM _walk_level, LATERAL variant_explode_outer(v) AS t WHERE t.value IS NOT NULL")
        hit = nxt.where(F.col("k") == key).select("path", F.to_json(F.col("v")).alias("value"))
        found = hit if found is None else found.unionByName(hit)
        level = nxt.select("path", "v")
        if not level.where(F.schema_of_variant("v").startswith("OBJECT") | F.schema_of_variant("v").startswith("ARRAY")).limit(1).count():
            break
    return found


def facet_partitions(df: DataFrame, facet: str, sub: str, window: int) -> list[tuple[str, DataFrame]]:
    """Disjoint, exhaustive parts under a result window: a facet value each; values over the window are split again by a
    second facet; what no facet covers comes as a negated rest. Only facet counts (a bounded vocabulary) reach the driver.
    """
    parts: list[tuple[str, DataFrame]] = []
    seen = []
    for value, n in sorted((r[0], r[1]) for r in df.where(F.col(facet).isNotNull()).groupBy(facet).count().collect()):
        own = df.where(F.col(facet) == value)
        seen.append(value)
        if n <= window:
            parts.append((f"{facet}={value}", own))
            continue
        subs = sorted(r[0] for r in own.where(F.col(sub).isNotNull()).select(sub).distinct().collect())
        parts += [(f"{facet}={value},{sub}={s}", own.where(F.col(sub) == s)) for s in subs]
        parts.append((f"{facet}={value},no {sub}", own.where(F.col(sub).isNull())))
    parts.append((f"no {facet}", df.where(F.col(facet).isNull() | ~F.col(facet).isin(*seen)) if seen else df))
    return parts


def page_windows(totals: DataFrame, size: int) -> DataFrame:
    """(source, page, skip, rows): the requests that read each source's ``total`` rows; the last page is short. totals: (source, total)."""
    pages = totals.where("total > 0").select("source", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / size))).alias("page"))
    skip = F.col("page") * size
    return pages.select("source", "page", skip.alias("skip"), F.least(F.lit(size), F.col("total") - skip).alias("rows"))


def resolve_terms(df: DataFrame, c: str, terms: DataFrame, key: str) -> DataFrame:
    """(key, names): ids of an array as names, in order; unknown ids drop out. terms: (id, name)."""
    ids = df.select(key, F.posexplode(c).alias("pos", "id"))
    named = ids.join(terms, "id").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    return df.select(key).join(named, key, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def join_locations(objects: DataFrame, locations: DataFrame, key: str) -> DataFrame:
    """Two-table source: objects with a known location."""
    return objects.join(locations, key)


def merge_members(plan: DataFrame) -> DataFrame:
    """Rooms of floor plans (key, floor, code, title, ids): a key counts on its first floor only; keys of one code
    merge, their ids united and titles joined in order."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("floor")
    first = plan.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.groupBy("code").agg(F.min("floor").alias("floor"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("floor", "key", "title"))), lambda x: x["title"])), " / ").alias("title"))


def way_rings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, ring): node references of closed ways as points, in order. ways: (way, refs); nodes: (id, lon, lat)."""
    refs = ways.where(F.element_at("refs", 1) == F.element_at("refs", -1)).select("way", F.posexplode("refs").alias("pos", "id"))
    pts = refs.join(nodes, "id").groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p")))).alias("s"))
    return pts.select("way", F.transform("s", lambda s: s["p"]).alias("ring"))


#: Patterns of room codes, tried in order: (pattern, group).
CODE_PATTERNS = [(r"(?i)\b(?:room|gallery|salle|sala|saal)\s+(\d+[a-z]?)\b", 1), (r"\b([A-Z]{1,2}\d{1,3}(?:\.\d+)?)\b", 1), (r"\b(\d{3})\b", 1)]


def room_code(c: Column) -> Column:
    """The first room code that a location text holds, or ''."""
    return tx.first_match(c, CODE_PATTERNS)


def split_title(c: Column) -> Column:
    """type, artist and period of a title like 'Portrait - A. Name - 18th century'."""
    part = lambda n: F.trim(F.split_part(c, F.lit(" - "), F.lit(n)))
    return F.struct(part(1).alias("kind"), part(2).alias("artist"), part(3).alias("period"))


def rights(uri: Column) -> Column:
    """CC0, PDM or '' from a rights address."""
    return F.when(uri.contains("publicdomain/zero"), "CC0").when(uri.contains("publicdomain/mark"), "PDM").otherwise("")


def eligible_image(museums: tuple[str, ...], home: str) -> Column:
    """Images that may be derived: allowed museum, own or CC0, and present."""
    return F.col("museum").isin(*museums) & ((F.col("museum") == home) | (F.col("imageLicense") == "CC0-1.0")) & (F.col("imageUrl") != "")


def on_view(c: Column, storage: str, room: str) -> Column:
    """Storage wording first, then the room pattern."""
    return ~c.rlike(storage) & c.rlike(room)


def first_allowed(ids: Column, excluded: list[int]) -> Column:
    """The first id outside an exclusion set."""
    return F.try_element_at(F.array_except(ids, F.array(*map(F.lit, excluded))), F.lit(1))
