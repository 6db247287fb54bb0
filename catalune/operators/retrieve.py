"""Ranked retrieval: fielded BM25 over postings, prefix and relaxed matching, boosts, filters.

A token that is matched as a prefix counts as one pseudo-term: its frequency in
a document sums all expansions, and its document frequency counts documents
that hold any. Scores are negated, so lower is better, as boosts are
subtracted. Every ordering ends with the object id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

K1, B = 1.2, 0.75
HIGHLIGHT_BOOST = 2.0
ACTIVE_BOOST = 2.5
WEIGHTS = {"title": 10.0, "artist": 8.0, "culture": 3.0, "classification": 5.0, "medium": 2.0, "tags": 4.0, "synonyms": 1.0}
IDF_FLOOR = 1e-6


def _matches(words: list[str], prefix: bool) -> Callable[[Column], Column]:
    """Whether a token is, or begins with, one of the words."""
    return lambda t: reduce(lambda x, y: x | y, (t.startswith(w) if prefix else t == w for w in words))


def postings(objects: DataFrame, weights: dict[str, float], stem: bool = False, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """(objectID, term, tf, len): weighted frequency of each term and the object's length in tokens.

    All fields are exploded in one pass; one aggregation, with partial sums
    before its shuffle, gives the postings. The length rides along, so no join
    is needed for it. ``only``: the tokens wanted; others count for the length
    but are dropped from the arrays, before they become rows.
    """

    def field_tokens(c: str) -> Column:
        t = tx.tokens(F.coalesce(F.col(c), F.lit("")))
        return tx.stems(t) if stem else t

    parts = F.array(*(F.struct(field_tokens(c).alias("words"), F.lit(float(w)).alias("w")) for c, w in weights.items()))
    length = F.aggregate(F.col("parts"), F.lit(0), lambda acc, p: acc + F.size(p["words"]))
    rows = objects.select("objectID", parts.alias("parts")).select("objectID", length.alias("len"), F.explode_outer("parts").alias("p"))
    words = F.filter("p.words", only) if only else F.col("p.words")
    rows = rows.select("objectID", "len", F.col("p.w").alias("w"), F.explode_outer(words).alias("term")).where("term is not null")
    return rows.groupBy("objectID", "term").agg(F.sum("w").alias("tf"), F.first("len").alias("len"))


def corpus(objects: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: n objects and their mean length."""
    sizes = sum((F.size(tx.tokens(F.coalesce(F.col(c), F.lit("")))) for c in weights), F.lit(0))
    return objects.agg(F.count("*").alias("n"), F.avg(sizes).alias("avg_len"))


def vocabulary(postings_: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings_.groupBy("term").agg(F.count("*").alias("df"))


def _hits(post: DataFrame, words: list[str], prefix: bool) -> DataFrame:
    """(objectID, tok, tf, len): one row for each query token an object matches."""
    test = (lambda t: F.col("term").startswith(t)) if prefix else (lambda t: F.col("term") == t)
    matched = F.array_compact(F.array(*(F.when(test(w), F.lit(i)) for i, w in enumerate(words))))
    rows = post.where(F.size(matched) > 0).select("objectID", "tf", "len", F.explode(matched).alias("tok"))
    return rows.groupBy("objectID", "tok").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))


def bm25(post: DataFrame, stats: DataFrame, words: list[str], prefix: bool, every: bool, k1: float = K1, b: float = B) -> DataFrame:
    """(objectID, score): objects that match every token (or any), best lowest."""
    hits = _hits(post, words, prefix)
    df = hits.groupBy("tok").agg(F.count("*").alias("df"))  # at most one row a query token
    n, avg = stats.first() or (0, None)
    idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(avg or 1.0))))
    scored = hits.join(F.broadcast(df), "tok").groupBy("objectID").agg((-F.sum(part)).alias("score"), F.count("*").alias("matched"))
    return (scored.where(F.col("matched") == len(words)) if every else scored).drop("matched")


@dataclass
class Filters:
    """Hard filters of a search; None leaves a column alone."""

    equals: dict[str, str] = field(default_factory=dict)
    floor: str | None = None
    has_image: bool = False
    without_museums: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        for c, v in self.equals.items():
            df = df.where(F.col(c) == v)
        if self.floor is not None:
            df = df.where(F.col("floor") == self.floor)
        if self.has_image:
            df = df.where(F.col("imageUrl") != "")
        return df.where(~F.col("museum").isin(*self.without_museums)) if self.without_museums else df


def search(
    objects: DataFrame,
    query: str,
    weights: dict[str, float],
    galleries: DataFrame | None = None,
    keys: tuple[str, ...] = ("galleryNumber",),
    relaxed: bool = False,
    filters: Filters | None = None,
    active_museum: str | None = None,
    limit: int | None = 8,
    stem: bool = False,
    post: DataFrame | None = None,
) -> DataFrame:
    """Objects with their score, best first: prefix-AND, or OR of whole words if ``relaxed``.

    Filters bound the result, not the corpus statistics. ``galleries`` is left
    joined on ``keys`` after scoring (Spark broadcasts it if it is small).
    """
    words = tx.relaxed_tokens(query) if relaxed else tx.query_tokens(query)
    if stem and relaxed:
        words = [tx.stem(w) for w in words]
    words = list(dict.fromkeys(words))
    if not words:
        return objects.withColumn("score", F.lit(0.0)).limit(0)
    post = postings(objects, weights, stem, only=_matches(words, not relaxed)) if post is None else post
    scored = bm25(post, corpus(objects, weights), words, prefix=not relaxed, every=not relaxed)
    out = objects.join(scored, "objectID")
    if galleries is not None:
        out = out.join(galleries, list(keys), "left")
    if filters:
        out = filters.apply(out)
    boost = F.when(F.col("isHighlight"), HIGHLIGHT_BOOST).otherwise(0.0)
    if active_museum is not None:
        boost = boost + F.when(F.col("museum") == active_museum, ACTIVE_BOOST).otherwise(0.0)
    out = out.withColumn("score", F.col("score") - boost)
    return out.orderBy("score", "objectID").limit(limit) if limit else out


def accession_matches(objects: DataFrame, query: str) -> DataFrame:
    """Objects whose accession holds the query's words in order; none unless some word has a digit."""
    words = query.lower().split()
    if not any(ch.isdigit() for w in words for ch in w):
        return objects.limit(0)
    return objects.where(tx.like_contains(F.col("accession"), words))


def first_of(*lists: DataFrame, limit: int | None = None) -> DataFrame:
    """(objectID, place): ids of ranked lists (objectID, rank) one after another, each once, at its first place."""
    both = lists[0].select("objectID", F.lit(0).alias("src"), "rank")
    for k, x in enumerate(lists[1:], 1):
        both = both.unionByName(x.select("objectID", F.lit(k).alias("src"), "rank"))
    out = both.groupBy("objectID").agg(F.min(F.struct("src", "rank")).alias("place"))
    return out.orderBy("place", "objectID").limit(limit) if limit else out


def hydrate(objects: DataFrame, ranked: DataFrame) -> DataFrame:
    """The objects of (objectID, rank), keeping rank; unknown ids drop out."""
    return objects.join(ranked, "objectID")


def fold_interpreted(rewritten: str, soft: dict[str, str | None]) -> str:
    """The rewritten query and usable soft filters as one bag of words."""
    junk = {"", "null", "none", "n/a"}
    kept = [v for v in soft.values() if v is not None and v.strip().lower() not in junk]
    return " ".join([rewritten, *kept]).strip()


def escalation(results: DataFrame, rows: int = 3, top: float = -11.5) -> DataFrame:
    """(n, best, escalate): too few rows, or a best score above ``top`` (a threshold of the corpus at hand)."""
    out = results.agg(F.count("*").alias("n"), F.min("score").alias("best"))
    return out.withColumn("escalate", (F.col("n") < rows) | (F.coalesce("best", F.lit(0.0)) > top))


def tiered(objects: DataFrame, query: str) -> DataFrame:
    """Scores without an index: title prefix 0, title contains 1, artist contains 2, all words somewhere 3; highlights less 0.5."""
    q = tx.normalize(F.lit(query))
    words = tx.query_tokens(query)
    title, artist = tx.normalize(F.col("title")), tx.normalize(F.col("artist"))
    both = F.concat_ws(" ", title, artist)
    every = F.lit(True)
    for w in words:
        every = every & both.contains(w)
    tier = F.when(title.startswith(q), 0.0).when(title.contains(q), 1.0).when(artist.contains(q), 2.0).when(every, 3.0)
    out = objects.withColumn("score", tier - F.when(F.col("isHighlight"), 0.5).otherwise(0.0))
    return out.where(F.col("score").isNotNull())


def expired_museums(museums: DataFrame, now_ms: int) -> DataFrame:
    """Museums whose licence has lapsed: (museum, ttlDays, builtAtMs) with age in days above ttlDays - 1; null times never lapse."""
    age = (F.lit(now_ms) - F.col("builtAtMs")) / F.lit(86_400_000.0)
    return museums.where(F.col("ttlDays").isNotNull() & F.col("builtAtMs").isNotNull() & (age > F.col("ttlDays") - 1)).select("museum")


def exclude_expired(objects: DataFrame, expired: DataFrame) -> DataFrame:
    """The one transform that every path applies at the scan."""
    return objects.join(expired, "museum", "left_anti")
