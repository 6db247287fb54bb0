"""Browsing and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import browse
from ..registry import query, table
from ..sources.adapters import part_objects
from .search import PARTS, _toks


@query(f"WITH {PARTS} SELECT objectID, galleryNumber, row_number() OVER (PARTITION BY galleryNumber ORDER BY isHighlight DESC, objectID) AS position, count(*) OVER (PARTITION BY galleryNumber) AS total FROM part_o WHERE galleryNumber <> ''")
def gallery_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and size within a gallery, by window instead of a correlated count."""
    return browse.positions(part_objects(spark, sf_dir), ["galleryNumber"]).select("objectID", "galleryNumber", "position", "total")


@query(f"""WITH {PARTS} SELECT objectID, coalesce(lag(objectID) OVER w, last_value(objectID) OVER f) AS previous, coalesce(lead(objectID) OVER w, first_value(objectID) OVER f) AS following FROM part_o
    WINDOW w AS (PARTITION BY galleryNumber, artist ORDER BY isHighlight DESC, objectID), f AS (PARTITION BY galleryNumber, artist ORDER BY isHighlight DESC, objectID ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def gallery_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and following, cyclic; small groups so that lone rows occur."""
    return browse.neighbours(part_objects(spark, sf_dir), ["galleryNumber", "artist"]).select("objectID", "previous", "following")


@query(f"WITH {PARTS} SELECT objectID, galleryNumber, row_number() OVER (PARTITION BY galleryNumber ORDER BY isHighlight DESC, objectID) AS position FROM part_o QUALIFY position <= 5")
def capped_gallery_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each gallery."""
    return browse.capped(part_objects(spark, sf_dir), ["galleryNumber"], 5).select("objectID", "galleryNumber", "position")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS galleryNumber, row_number() OVER (ORDER BY (n_nationkey = 1)::INT DESC, n_nationkey) AS place FROM nation WHERE starts_with(CAST(n_nationkey AS VARCHAR), '1') QUALIFY place <= 4")
def code_prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that begin with '1', the exact one first, in numeric order, four at most."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("galleryNumber"))
    out = browse.match_codes(n, "1")
    w = Window.orderBy((F.col("galleryNumber") == "1").cast("int").desc(), tx.natural_key(F.col("galleryNumber")))
    return out.withColumn("place", F.row_number().over(w))


@query("SELECT c_custkey AS ordinal, c_mktsegment AS title FROM customer WHERE (starts_with(lower(c_mktsegment), 'mach') OR starts_with(CAST(c_nationkey AS VARCHAR), 'mach')) AND (starts_with(CAST(c_nationkey AS VARCHAR), '2') OR starts_with(lower(c_mktsegment), '2'))")
def word_prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of '2 mach' begins a word of code and title."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_nationkey").cast("string").alias("galleryNumber"), F.col("c_mktsegment").alias("title"))
    return browse.match_words(c, "2 mach").select("ordinal", "title")


@query(
    """WITH q AS (SELECT * FROM (VALUES ('where are the toilets'), ('water lilies'), ('drinking water fountains'), ('coffee'), ('lifts'), ('information desk'), ('sunflowers'), ('bars and lifts'), ('')) t(q)),
    w AS (SELECT q, list_transform(string_split(q, ' '), lambda x: regexp_replace(x, 's$', '')) AS w FROM q)
    SELECT q AS query, CASE WHEN list_has_any(w, ['restroom','bathroom','toilet','washroom','lavatory','wc','loo']) THEN 'restroom'
      WHEN list_has_any(w, ['cafe','cafeteria','coffee','food','restaurant','dining','eat','eating','lunch','dinner','snack','bar']) THEN 'dining'
      WHEN list_has_any(w, ['elevator','lift']) THEN 'elevator' WHEN list_has_any(w, ['info','information']) THEN 'info'
      WHEN list_contains(w, 'fountain') AND (list_contains(w, 'water') OR list_contains(w, 'drinking')) THEN 'water' END AS intent FROM w"""
)
def amenity_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: first kind that matches, plurals folded, water only with a fountain."""
    qs = ["where are the toilets", "water lilies", "drinking water fountains", "coffee", "lifts", "information desk", "sunflowers", "bars and lifts", ""]
    q = spark.createDataFrame([(x,) for x in qs], "query string")
    return q.withColumn("intent", browse.amenity_intent(F.col("query")))


@query("SELECT s_suppkey AS id, kind, s_name AS name FROM (SELECT *, CASE s_nationkey % 3 WHEN 0 THEN 'restroom' WHEN 1 THEN 'elevator' ELSE 'stairs' END AS kind FROM supplier) WHERE contains(kind, 'elevator') OR contains(lower(s_name), 'elevator')")
def amenity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11: 'Lift' finds elevators through its synonym."""
    kind = F.when(F.col("s_nationkey") % 3 == 0, "restroom").when(F.col("s_nationkey") % 3 == 1, "elevator").otherwise("stairs")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), kind.alias("kind"), F.col("s_name").alias("name"))
    return browse.match_amenities(s, " Lift ")


@query(
    f"""WITH {PARTS}, l AS (SELECT objectID AS label, CASE WHEN objectID % 3 = 0 THEN upper(accession) ELSE '' END AS accession, upper(title) AS title, artist FROM part_o),
    a AS (SELECT replace(lower(accession), ' ', '') AS k, min(objectID) AS ia FROM part_o GROUP BY 1 HAVING count(*) = 1),
    t AS (SELECT title AS k, min(objectID) AS it FROM (SELECT objectID, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title FROM part_o) GROUP BY 1 HAVING count(*) = 1),
    r AS (SELECT title AS k, artist AS k2, min(objectID) AS ir FROM (SELECT objectID, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title, trim(regexp_replace(lower(artist), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS artist FROM part_o) GROUP BY ALL HAVING count(*) = 1),
    n AS (SELECT label, replace(lower(accession), ' ', '') AS na, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS nt, trim(regexp_replace(lower(artist), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS nr FROM l)
    SELECT label, coalesce(ia, it, ir) AS objectID, CASE WHEN ia IS NOT NULL THEN 'accession' WHEN it IS NOT NULL THEN 'title' WHEN ir IS NOT NULL THEN 'artist' END AS via
    FROM n LEFT JOIN a ON a.k = na AND na <> '' LEFT JOIN t ON t.k = nt AND nt <> '' LEFT JOIN r ON r.k = nt AND r.k2 = nr AND nt <> '' AND nr <> ''"""
)
def label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read labels matched by accession, title, or title and artist, if unique."""
    parts = part_objects(spark, sf_dir)
    labels = parts.select(F.col("objectID").alias("label"), F.when(F.col("objectID") % 3 == 0, F.upper("accession")).otherwise("").alias("accession"), F.upper("title").alias("title"), "artist")
    return browse.match_labels(labels, parts)


@query("SELECT p_partkey AS objectID, p_name AS title FROM part WHERE p_partkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object by key; the filter reaches the scan."""
    return table(spark, sf_dir, "part").where("p_partkey = 42").select(F.col("p_partkey").alias("objectID"), F.col("p_name").alias("title"))


@query("SELECT id, CASE WHEN contains(id, ':') THEN split_part(id, ':', 1) ELSE 'siteA,siteB' END AS sites, CASE WHEN contains(id, ':') THEN split_part(id, ':', 2) ELSE id END AS code FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'site' || n_regionkey || ':' || n_nationkey ELSE CAST(n_nationkey AS VARCHAR) END AS id FROM nation)")
def gallery_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoped ids pin a site, bare ids mean the legacy sites."""
    n = table(spark, sf_dir, "nation")
    code = F.col("n_nationkey").cast("string")
    ids = n.select(F.when(F.col("n_nationkey") % 2 == 0, tx.scoped_id(F.concat(F.lit("site"), F.col("n_regionkey").cast("string")), code)).otherwise(code).alias("id"))
    s = browse.scope(F.col("id"), ("siteA", "siteB"))
    return ids.select("id", F.concat_ws(",", s["sites"]).alias("sites"), s["code"].alias("code"))


@query("SELECT code, row_number() OVER (ORDER BY letter, num, suffix) AS place FROM (SELECT DISTINCT chr(97 + p_size % 2) || p_size || CASE WHEN p_size % 5 = 0 THEN '.bis' ELSE '' END AS code, chr(97 + p_size % 2) AS letter, p_size AS num, CASE WHEN p_size % 5 = 0 THEN '.bis' ELSE '' END AS suffix FROM part)")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: a9 before a10 before a10.bis."""
    p = table(spark, sf_dir, "part")
    code = F.concat(F.when(F.col("p_size") % 2 == 0, "a").otherwise("b"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 0, ".bis").otherwise(""))
    codes = p.select(code.alias("code")).distinct()
    return codes.withColumn("place", F.row_number().over(Window.orderBy(tx.natural_key(F.col("code")))))


@query("SELECT n_name AS name, coalesce(CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 END, 0) AS known, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 1000 END, n_nationkey) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def floor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floors in registry order, unknown ones last."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    at = F.array_position(F.array(F.lit("EUROPE"), F.lit("ASIA")), F.col("r_name"))
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).withColumn("known", at)
    w = Window.orderBy(F.when(F.col("known") == 0, 1000).otherwise(F.col("known")), "n_nationkey")
    return j.select(F.col("n_name").alias("name"), "known", F.row_number().over(w).alias("place"))


@query(f"WITH d AS (SELECT doc_id, {_toks('text')} AS t FROM documents), x AS (SELECT doc_id, unnest(list_distinct(t)) AS term FROM d), f AS (SELECT term, count(*) AS df FROM x GROUP BY term) SELECT doc_id, term, df, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS place FROM x JOIN f USING (term) QUALIFY place <= 2")
def rarest_two_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rarest words of each text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    df = d.groupBy("term").agg(F.count("*").alias("df"))
    w = Window.partitionBy("doc_id").orderBy("df", "term")
    return d.join(df, "term").withColumn("place", F.row_number().over(w)).where("place <= 2").select("doc_id", "term", "df", "place")
