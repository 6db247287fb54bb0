"""Retrieval and typo correction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import fuzzy, retrieve
from ..operators.shared import written
from ..registry import query, table
from ..sources.adapters import document_objects, part_galleries, part_objects

PART_WEIGHTS = {"title": 10.0, "artist": 8.0, "classification": 5.0}
DOC_WEIGHTS = {"title": 10.0, "body": 1.0}

_TOK = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"


def _toks(c: str) -> str:
    return _TOK.format(c=c)


PARTS = "part_o AS (SELECT p_partkey AS objectID, p_name AS title, p_brand AS artist, p_type AS classification, CAST(p_size AS VARCHAR) AS galleryNumber, printf('%.2f', p_retailprice) AS accession, p_size % 10 = 0 AS isHighlight FROM part)"
GALLERY = "gal AS (SELECT CAST(n_nationkey AS VARCHAR) AS galleryNumber, n_name AS galleryTitle, r_name AS floor FROM nation JOIN region ON n_regionkey = r_regionkey)"
DOCS = "doc_o AS (SELECT d.doc_id AS objectID, split_part(text, chr(10), 1) AS title, text AS body, source AS museum, lang AS site, coalesce(quality, 0) = 1 AS isHighlight FROM documents d LEFT JOIN labels USING (doc_id))"


def _bm25_sql(objects: str, weights: dict[str, float], words: list[str], prefix: bool, every: bool) -> str:
    fields = " UNION ALL ".join(f"SELECT objectID, {w} AS w, unnest({_toks(c)}) AS term FROM {objects}" for c, w in weights.items())
    sizes = " + ".join(f"len({_toks(c)})" for c in weights)
    test = "starts_with(term, q)" if prefix else "term = q"
    values = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    having = f"HAVING count(*) = {len(words)}" if every else ""
    return f"""post AS (SELECT objectID, term, sum(w) AS tf FROM ({fields}) GROUP BY ALL),
    lens AS (SELECT objectID, {sizes} AS len FROM {objects}),
    st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
    qs AS (SELECT * FROM (VALUES {values}) t(tok, q)),
    hits AS (SELECT objectID, tok, sum(tf) AS tf FROM post JOIN qs ON {test} GROUP BY ALL),
    dfs AS (SELECT tok, count(*) AS df FROM hits GROUP BY tok),
    sc AS (SELECT objectID, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score
      FROM hits JOIN dfs USING (tok) JOIN lens USING (objectID), st GROUP BY objectID {having})"""


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {PARTS}, {GALLERY}, {_bm25_sql("part_o", PART_WEIGHTS, ["sma", "ri"], True, True)}
    SELECT objectID, title, artist, galleryNumber, floor, round(score - CASE WHEN isHighlight THEN 2.0 ELSE 0 END, 6) AS score
    FROM part_o JOIN sc USING (objectID) LEFT JOIN gal USING (galleryNumber) ORDER BY score - CASE WHEN isHighlight THEN 2.0 ELSE 0 END, objectID LIMIT 8"""
)
def autocomplete_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3, R5-R7, J1, J2, T1: 'sma ri' over the parts, highlights boosted, floor joined, best 8."""
    out = retrieve.search(part_objects(spark, sf_dir), "sma ri", PART_WEIGHTS, part_galleries(spark, sf_dir))
    return _round(out.select("objectID", "title", "artist", "galleryNumber", "floor", "score"))


@query(
    f"""WITH {PARTS}, {GALLERY}, {_bm25_sql("part_o", PART_WEIGHTS, ["small", "economy"], False, False)}
    SELECT objectID, title, floor, round(score - CASE WHEN isHighlight THEN 2.0 ELSE 0 END, 6) AS score
    FROM part_o JOIN sc USING (objectID) JOIN gal USING (galleryNumber) WHERE floor = 'ASIA'"""
)
def full_search_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopwords dropped, any word, filtered on the floor of the left-joined gallery."""
    out = retrieve.search(part_objects(spark, sf_dir), "show me the small economy", PART_WEIGHTS, part_galleries(spark, sf_dir), relaxed=True, filters=retrieve.Filters(floor="ASIA"), limit=None)
    return _round(out.select("objectID", "title", "floor", "score"))


@query(
    f"""WITH {DOCS}, {_bm25_sql("doc_o", DOC_WEIGHTS, ["the", "er"], True, True)}
    SELECT objectID, museum, site, round(score - CASE WHEN isHighlight THEN 2.0 ELSE 0 END - CASE WHEN museum = 'src1' THEN 2.5 ELSE 0 END, 6) AS score
    FROM doc_o JOIN sc USING (objectID) WHERE site = 'en' AND museum NOT IN ('src2', 'src3')
    ORDER BY score - CASE WHEN isHighlight THEN 2.0 ELSE 0 END - CASE WHEN museum = 'src1' THEN 2.5 ELSE 0 END, objectID LIMIT 50"""
)
def full_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix search in long texts with museum boost, site filter, excluded museums."""
    f = retrieve.Filters(equals={"site": "en"}, without_museums=("src2", "src3"))
    out = retrieve.search(document_objects(spark, sf_dir), "the er", DOC_WEIGHTS, filters=f, active_museum="src1", limit=50)
    return _round(out.select("objectID", "museum", "site", "score"))


@query(f"""WITH {PARTS} SELECT term, count(*) AS df FROM (SELECT DISTINCT objectID, unnest(list_concat({_toks("title")}, {_toks("artist")}, {_toks("classification")})) AS term FROM part_o) GROUP BY term""")
def vocabulary_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every term."""
    return retrieve.vocabulary(retrieve.postings(part_objects(spark, sf_dir), PART_WEIGHTS))


@query(f"""WITH {PARTS} SELECT objectID, term, sum(w) AS tf FROM (SELECT objectID, 10.0::DOUBLE AS w, unnest({_toks("title")}) AS term FROM part_o UNION ALL SELECT objectID, 8.0::DOUBLE, unnest({_toks("artist")}) FROM part_o UNION ALL SELECT objectID, 5.0::DOUBLE, unnest({_toks("classification")}) FROM part_o) GROUP BY ALL""")
def postings_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted postings, dealt and sorted by term as an index keeps them."""
    post = retrieve.postings(part_objects(spark, sf_dir), PART_WEIGHTS).select("objectID", "term", "tf")
    return post.repartitionByRange("term").sortWithinPartitions("term", "objectID")


@query(f"""WITH {PARTS} SELECT objectID, accession FROM part_o WHERE lower(accession) LIKE '%9%1%' ESCAPE '\\'""")
def accession_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the query in order, case-insensitive, LIKE signs literal."""
    return retrieve.accession_matches(part_objects(spark, sf_dir), "9 1").select("objectID", "accession")


@query(
    f"""WITH {PARTS}, {_bm25_sql("part_o", PART_WEIGHTS, ["brand", "2"], True, True)},
    f AS (SELECT objectID, 0 AS src, row_number() OVER (ORDER BY score - CASE WHEN isHighlight THEN 2.0 ELSE 0 END, objectID) AS rank FROM part_o JOIN sc USING (objectID) QUALIFY rank <= 40),
    a AS (SELECT objectID, 1 AS src, row_number() OVER (ORDER BY objectID) AS rank FROM part_o WHERE lower(accession) LIKE '%brand%2%'),
    u AS (SELECT objectID, min((src, rank)) AS place FROM (SELECT * FROM f UNION ALL SELECT * FROM a) GROUP BY objectID)
    SELECT objectID, row_number() OVER (ORDER BY place, objectID) AS position FROM u QUALIFY position <= 60"""
)
def search_with_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text matches, then accession matches, each id once, in rank order."""
    parts = part_objects(spark, sf_dir)
    found = retrieve.search(parts, "brand 2", PART_WEIGHTS, limit=40)
    w = Window.orderBy("score", "objectID")
    text = found.select("objectID", F.row_number().over(w).alias("rank"))
    acc = retrieve.accession_matches(parts, "brand 2").select("objectID", F.row_number().over(Window.orderBy("objectID")).alias("rank"))
    both = retrieve.first_of(text, acc, limit=60)
    return both.select("objectID", F.row_number().over(Window.orderBy("place", "objectID")).alias("position"))


@query(
    f"""WITH {PARTS}, {_bm25_sql("part_o", PART_WEIGHTS, ["blue", "bolt", "standard"], False, False)},
    r AS (SELECT round(score - CASE WHEN isHighlight THEN 2.0 ELSE 0 END, 6) AS score FROM part_o JOIN sc USING (objectID))
    SELECT count(*) AS n, min(score) AS best, count(*) < 3 OR coalesce(min(score), 0) > -6.5 AS escalate FROM r"""
)
def interpreted_search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewritten query with soft filters folded in, and whether to escalate."""
    bag = retrieve.fold_interpreted("the blue bolt", {"classification": "STANDARD", "culture": "N/A", "medium": None})
    out = _round(retrieve.search(part_objects(spark, sf_dir), bag, PART_WEIGHTS, relaxed=True, limit=None))
    return retrieve.escalation(out, top=-6.5)


@query("SELECT a.id AS objectID, a.pos AS position FROM (VALUES (5, 0), (99999999, 1), (17, 2), (3, 3), (42, 4)) a(id, pos) JOIN part ON p_partkey = a.id ORDER BY pos LIMIT 3")
def answers_restricted_to_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer ids that were seen, in the answer's order, three at most."""
    seen = part_objects(spark, sf_dir).select("objectID")
    answer = spark.createDataFrame([(5, 0), (99999999, 1), (17, 2), (3, 3), (42, 4)], "objectID long, position int")
    return seen.join(F.broadcast(answer), "objectID").orderBy("position").limit(3)


@query(
    f"""WITH {PARTS}, s AS (SELECT objectID, isHighlight, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t, trim(regexp_replace(lower(artist), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS a FROM part_o)
    SELECT objectID, CASE WHEN starts_with(t, 'red') THEN 0.0::DOUBLE WHEN contains(t, 'red') THEN 1.0 WHEN contains(a, 'red') THEN 2.0 WHEN contains(t || ' ' || a, 'red') THEN 3.0 END - CASE WHEN isHighlight THEN 0.5 ELSE 0 END AS score FROM s
    WHERE contains(t, 'red') OR contains(a, 'red')"""
)
def tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by tier, without an index."""
    return retrieve.tiered(part_objects(spark, sf_dir), "Red").select("objectID", "score")


@query("WITH m AS (SELECT 'src' || i AS museum, CASE WHEN i % 3 = 0 THEN NULL ELSE 10 + i END AS ttl, CASE WHEN i = 7 THEN NULL ELSE (100 - 2 * i) END AS age FROM range(20) t(i)), x AS (SELECT museum FROM m WHERE ttl IS NOT NULL AND age IS NOT NULL AND age > ttl - 1) SELECT source AS museum, count(*) AS n FROM documents WHERE source NOT IN (SELECT museum FROM x) GROUP BY source")
def unexpired_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of museums whose licence has lapsed are left out."""
    day, now = 86_400_000, 1_700_000_000_000
    rows = [(f"src{i}", None if i % 3 == 0 else 10 + i, None if i == 7 else now - (100 - 2 * i) * day) for i in range(20)]
    museums = spark.createDataFrame(rows, "museum string, ttlDays int, builtAtMs long")
    kept = retrieve.exclude_expired(document_objects(spark, sf_dir), retrieve.expired_museums(museums, now))
    return kept.groupBy("museum").agg(F.count("*").alias("n"))


@query("SELECT objectID, section, rank FROM (SELECT doc_id AS objectID, CASE WHEN source = 'src1' THEN 0 ELSE 1 END AS section, row_number() OVER (PARTITION BY source = 'src1' ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 20")
def sections_by_museum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active museum's section and the rest, each in rank order."""
    d = table(spark, sf_dir, "documents").withColumn("section", F.when(F.col("source") == "src1", 0).otherwise(1))
    w = Window.partitionBy("section").orderBy(F.desc("n_chars"), "doc_id")
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select(F.col("doc_id").alias("objectID"), "section", "rank")


@query(
    f"""WITH {DOCS}, w AS (SELECT DISTINCT objectID, unnest({_toks("title")}) AS term FROM doc_o), v AS (SELECT term, count(*) AS df FROM w GROUP BY term),
    g AS (SELECT term, df, unnest(list_distinct(list_transform(range(1, len(term) - 1), lambda i: substr(term, i, 3)))) AS gram FROM v WHERE len(term) >= 3),
    q AS (SELECT DISTINCT substr(v, CAST(i AS INT), 3) AS gram FROM (VALUES ('thetion'), ('htetion'), ('tehtion'), ('thteion'), ('theiton'), ('thetoin'), ('thetino')) t(v), range(1, 6) r(i))
    SELECT term, df, count(*) AS shared, row_number() OVER (ORDER BY count(*) / sqrt(len(term)) DESC, term) AS rank FROM g JOIN q USING (gram) GROUP BY term, df QUALIFY rank <= 50"""
)
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty vocabulary terms that share most trigrams with a token."""
    vocab = retrieve.vocabulary(retrieve.postings(document_objects(spark, sf_dir), {"title": 1.0}))
    return fuzzy.candidates(fuzzy.vocab_trigrams(vocab), "thetion")


@query()
def ranked_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by alignment distance, frequent terms favoured (no SQL twin: DuckDB has no such distance)."""
    vocab = retrieve.vocabulary(retrieve.postings(part_objects(spark, sf_dir), PART_WEIGHTS))
    out = fuzzy.rank_corrections(fuzzy.candidates(fuzzy.vocab_trigrams(vocab), "econmoy"), "econmoy")
    return out.withColumn("s", F.round("s", 6))


@query()
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact pass, then the corrected query ('smlal widgte')."""
    parts = part_objects(spark, sf_dir)
    post = written(retrieve.postings(parts, PART_WEIGHTS), "postings")
    exact = retrieve.search(parts, "smlal widgte", PART_WEIGHTS, post=post)
    if exact.limit(1).count():
        return _round(exact.select("objectID", "title", "score"))
    fixed = fuzzy.correct("smlal widgte", post, retrieve.vocabulary(post))
    return _round(retrieve.search(parts, fixed or "smlal widgte", PART_WEIGHTS, post=post).select("objectID", "title", "score"))


@query("SELECT doc_id AS objectID, strip_accents(lower(split_part(text, chr(10), 1))) AS folded FROM documents")
def folded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case without diacritics."""
    return document_objects(spark, sf_dir).select("objectID", tx.fold_diacritics("title").alias("folded"))


@query(
    """SELECT a.p_partkey AS a, b.p_partkey AS b,
    round(CASE WHEN greatest(len(a.p_name), len(b.p_name)) = 0 THEN 1 ELSE 1 - levenshtein(a.p_name, b.p_name) / greatest(len(a.p_name), len(b.p_name)) END, 6) AS similarity,
    contains(a.p_name, b.p_name) OR contains(b.p_name, a.p_name) OR len(list_intersect(list_distinct(list_filter(string_split(a.p_name, ' '), lambda x: len(x) > 2)), string_split(b.p_name, ' '))) * 2 >= len(list_distinct(list_filter(string_split(a.p_name, ' '), lambda x: len(x) > 2))) AS titles_match
    FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""
)
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit similarity and the containment-or-half heuristic of neighbouring titles."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    a, b = p.alias("a"), p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_partkey").alias("bk"), F.col("p_name").alias("bn")).alias("b")
    j = a.join(b, F.col("a.p_partkey") == F.col("b.k"))
    return j.select(F.col("p_partkey").alias("a"), F.col("bk").alias("b"), F.round(fuzzy.edit_similarity(F.col("p_name"), F.col("bn")), 6).alias("similarity"), fuzzy.title_match(F.col("p_name"), F.col("bn")).alias("titles_match"))


@query("WITH n AS (SELECT doc_id AS id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t, lang FROM documents) SELECT id, t <> '' AND (contains(t, lang) OR contains(lang, t)) AS echo, regexp_matches(t, '[bcdfghjklmnpqrstvwxz]{5}') AS gibberish FROM n")
def suggestion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echoes of a term and gibberish."""
    d = document_objects(spark, sf_dir)
    return d.select(F.col("objectID").alias("id"), fuzzy.literal_echo(F.col("site"), F.col("title")).alias("echo"), fuzzy.gibberish(F.col("title")).alias("gibberish"))
