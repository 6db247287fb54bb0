"""Source parsing and normalisation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..registry import query, table
from ..sources import readers
from ..sources.adapters import document_objects, part_objects


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
    regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)) AS links, coalesce(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1)[1], '') AS first_link FROM pages""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language and links of web pages."""
    f = readers.page_fields(table(spark, sf_dir, "pages"))
    return f.select("page_id", "title", "lang", F.size("links").alias("links"), F.coalesce(F.try_element_at("links", F.lit(1)), F.lit("")).alias("first_link"))


@query(r"SELECT regexp_extract(url, '([^/]+)/?$', 1) AS slug, min(page_id) AS pos FROM pages GROUP BY 1")
def sitemap_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of a sitemap made of all page addresses, each at its first place."""
    p = table(spark, sf_dir, "pages")
    lines = p.select("page_id", F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")).alias("xml"))
    # one entry a row: the position is that of the row
    s = lines.select("page_id", F.regexp_extract("xml", r"<loc>\s*([^<\s]+)\s*</loc>", 1).alias("url")).select("page_id", F.regexp_extract("url", r"([^/]+)/?$", 1).alias("slug"))
    return s.groupBy("slug").agg(F.min("page_id").alias("pos"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 90 AS VARCHAR) WHEN c_custkey % 4 = 1 THEN 'B' || c_custkey % 60 WHEN c_custkey % 4 = 2 THEN CAST(100 + c_custkey % 800 AS VARCHAR) ELSE '' END AS code FROM customer")
def room_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21 code grammars: the first pattern that matches gives the room."""
    k = F.col("c_custkey")
    m = k % 4
    where = F.when(m == 0, F.concat(F.lit("on view, Gallery "), (k % 90).cast("string"))).when(m == 1, F.concat(F.lit("Wing "), F.lit("B"), (k % 60).cast("string"))).when(m == 2, F.concat(F.lit("shown in "), (100 + k % 800).cast("string"))).otherwise("in storage")
    return table(spark, sf_dir, "customer").select(k.alias("id"), readers.room_code(where).alias("code"))


@query("SELECT p_partkey AS id, p_type AS kind, p_brand AS artist, p_size || 'th century' AS period, CASE WHEN p_partkey % 3 = 0 THEN 'CC0' WHEN p_partkey % 3 = 1 THEN 'PDM' ELSE '' END AS rights FROM part")
def split_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14 and title splitting."""
    p = table(spark, sf_dir, "part")
    t = readers.split_title(F.concat_ws(" - ", "p_type", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("th century"))))
    uri = F.when(F.col("p_partkey") % 3 == 0, "https://creativecommons.org/publicdomain/zero/1.0/").when(F.col("p_partkey") % 3 == 1, "https://creativecommons.org/publicdomain/mark/1.0/").otherwise("https://rights/other")
    return p.select(F.col("p_partkey").alias("id"), t["kind"].alias("kind"), t["artist"].alias("artist"), t["period"].alias("period"), readers.rights(uri).alias("rights"))


@query("SELECT doc_id AS id, source || '/' || doc_id AS image FROM documents WHERE source IN ('src0', 'src1', 'src2') AND (source = 'src0' OR lang = 'en') AND doc_id % 4 <> 0")
def eligible_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Museum allowed, home or CC0, image present."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("museum"), F.when(F.col("lang") == "en", "CC0-1.0").otherwise("").alias("imageLicense"), F.when(F.col("doc_id") % 4 != 0, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).otherwise("").alias("imageUrl"))
    return d.where(readers.eligible_image(("src0", "src1", "src2"), "src0")).select("id", F.col("imageUrl").alias("image"))


@query("SELECT s_suppkey AS id, NOT (s_suppkey % 5 = 0) AND s_suppkey % 2 = 0 AS shown, CASE WHEN s_nationkey NOT IN (3, 7) THEN s_nationkey WHEN s_suppkey NOT IN (3, 7) THEN s_suppkey END AS room FROM supplier")
def on_view_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage wording before room pattern; exclusion sets."""
    k = F.col("s_suppkey")
    spec = F.concat(F.when(k % 5 == 0, "Storage ").otherwise(""), F.when(k % 2 == 0, "Room A1").otherwise("corridor"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), readers.on_view(spec, "(?i)storage", r"Room [A-Z]\d").alias("shown"), readers.first_allowed(F.array(F.col("s_nationkey").cast("long"), k), [3, 7]).alias("room"))


@query("SELECT objectID, title, artist, '' AS culture, isHighlight FROM (SELECT p_partkey AS objectID, p_name AS title, p_brand AS artist, p_size % 10 = 0 AS isHighlight FROM part UNION ALL SELECT d.doc_id + 1000000, split_part(text, chr(10), 1), '', coalesce(quality, 0) = 1 FROM documents d LEFT JOIN labels USING (doc_id))")
def united_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with different columns in one schema."""
    docs = document_objects(spark, sf_dir).withColumn("objectID", F.col("objectID") + 1_000_000)
    return schema.union_sources(part_objects(spark, sf_dir), docs).select("objectID", "title", "artist", "culture", "isHighlight")


@query("WITH p AS (SELECT *, count(*) OVER (PARTITION BY p_type) AS n FROM part) SELECT CASE WHEN p_type = 'ECONOMY' THEN 'no p_type' WHEN n <= 400 THEN 'p_type=' || p_type ELSE 'p_type=' || p_type || ',p_brand=' || p_brand END AS part, count(*) AS rows FROM p GROUP BY 1")
def facet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint parts under a window; oversized facets split again; a negated rest."""
    p = table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_type") != "ECONOMY", F.col("p_type")))
    out = None
    for name, part in readers.facet_partitions(p, "p_type", "p_brand", 400):
        n = part.groupBy(F.lit(name).alias("part")).agg(F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT o_orderkey AS id, coalesce(string_agg(n_name, '|' ORDER BY pos), '') AS names FROM (SELECT o_orderkey, unnest([o_custkey % 30, o_orderkey % 30, o_custkey % 7]) AS k, generate_subscripts([1, 2, 3], 1) AS pos FROM orders) LEFT JOIN nation ON n_nationkey = k GROUP BY o_orderkey")
def taxonomy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of an array as names, in order, unknown ones out."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.array(F.col("o_custkey") % 30, F.col("o_orderkey") % 30, F.col("o_custkey") % 7).alias("ids"))
    terms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return readers.resolve_terms(o, "ids", terms, "key").select(F.col("key").alias("id"), F.array_join("names", "|").alias("names"))


@query("SELECT o_orderkey AS id, n_name AS location FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 0")
def joined_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a known location."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    objects = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("loc"))
    locations = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("loc"), F.col("n_name").alias("location"))
    return readers.join_locations(objects, locations, "loc").select("id", "location")


@query("SELECT user_id AS subject, arg_min(value, event_id) FILTER (event_type = 'view') AS view, arg_min(value, event_id) FILTER (event_type = 'click') AS click FROM events GROUP BY user_id")
def property_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a subject from property pairs, the first value of each."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("prop"), "value", F.col("event_id").alias("ordinal"))
    return readers.property_rows(e, ["view", "click"])


@query("SELECT code, min(floor) AS floor, len(list_distinct(flatten(list(ids)))) AS members, string_agg(title, ' / ' ORDER BY floor, key) AS title FROM (SELECT s_nationkey % 5 AS code, s_suppkey % 3 AS floor, s_suppkey AS key, [s_suppkey, s_suppkey // 2] AS ids, s_name AS title FROM supplier) GROUP BY code")
def merged_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan rooms of one code merged."""
    k = F.col("s_suppkey")
    plan = table(spark, sf_dir, "supplier").select(k.alias("key"), (k % 3).alias("floor"), (F.col("s_nationkey") % 5).alias("code"), F.col("s_name").alias("title"), F.array(k, F.floor(k / 2)).alias("ids"))
    m = readers.merge_members(plan.unionByName(plan.withColumn("floor", F.col("floor") + 5)))
    return m.select("code", "floor", F.size("ids").alias("members"), "title")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'en' || c_name WHEN c_custkey % 3 = 1 THEN 'nl' || c_name ELSE 'xx' || c_name END AS title FROM customer")
def preferred_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title in the first preferred language, from JSON."""
    k = F.col("c_custkey")
    entry = lambda lang: F.struct(F.lit(lang).alias("language"), F.concat(F.lit(lang), "c_name").alias("content"))
    raw = F.to_json(F.when(k % 3 == 0, F.array(entry("nl"), entry("en"))).when(k % 3 == 1, F.array(entry("xx"), entry("nl"))).otherwise(F.array(entry("xx"), entry("yy"))))
    values = F.from_json(raw, "array<struct<language:string,content:string>>")
    return table(spark, sf_dir, "customer").select(k.alias("id"), readers.pick_language(values, ("en", "nl")).alias("title"))


@query("SELECT 'id' || s_suppkey AS identifier, s_suppkey % 4 = 0 AS deleted, 'tok' AS token, 100::BIGINT AS total FROM supplier")
def harvested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of XML pages, twenty a page, after the structure guard."""
    s = table(spark, sf_dir, "supplier")
    rec = F.concat(F.lit("<record><header"), F.when(F.col("s_suppkey") % 4 == 0, ' status="deleted"').otherwise(""), F.lit("><identifier>id"), F.col("s_suppkey").cast("string"), F.lit("</identifier><datestamp>2024-01-01</datestamp></header></record>"))
    pages = s.select((F.col("s_suppkey") % 5).alias("page"), rec.alias("r")).groupBy("page").agg(F.concat(F.lit("<ListRecords>"), F.concat_ws("", F.collect_list("r")), F.lit('<resumptionToken completeListSize="100">tok</resumptionToken></ListRecords>')).alias("xml"))
    out = readers.oai_records(pages)
    readers.guard(out, {"identifier": F.col("identifier") != "", "datestamp": F.col("datestamp") != ""})
    return out.select("identifier", "deleted", "token", "total")


@query("SELECT s_suppkey AS id, replace('https://example.org/o/{sourceId}', '{sourceId}', CAST(s_suppkey AS VARCHAR)) AS url, concat_ws(', ', CASE WHEN s_suppkey % 2 = 0 THEN 'Case ' || s_suppkey % 9 END, CASE WHEN s_suppkey % 3 = 0 THEN 'Shelf ' || s_suppkey % 4 END) AS note, CASE WHEN s_name LIKE 'The %' THEN substr(s_name, 5) ELSE s_name END AS bare FROM supplier")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar helpers of §2.14: templates, location notes, articles."""
    k = F.col("s_suppkey")
    note = F.concat_ws(", ", F.when(k % 2 == 0, F.concat(F.lit("Case "), (k % 9).cast("string"))), F.when(k % 3 == 0, F.concat(F.lit("Shelf "), (k % 4).cast("string"))))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.replace(F.lit("https://example.org/o/{sourceId}"), F.lit("{sourceId}"), k.cast("string")).alias("url"), note.alias("note"), tx.strip_article(F.col("s_name")).alias("bare"))


@query("SELECT user_id AS key, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY ALL")
def walked_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values taken from nested JSON through the variant type."""
    nested = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit('{"a": [{"b": '), "props", F.lit('}], "u": '), F.col("user_id").cast("string"), F.lit("}")).alias("j"))
    v = nested.select("user_id", F.try_parse_json("j").alias("v"))
    k = v.select(F.col("user_id").alias("key"), F.try_variant_get("v", "$.a[0].b.k", "string").alias("value"))
    return k.groupBy("key", "value").agg(F.count("*").alias("n"))
