"""Keyed browsing: position in a group, cyclic neighbours, capped lists, code and label lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Query words of each kind of amenity, in order of precedence.
AMENITIES = (
    ("restroom", ("restroom", "bathroom", "toilet", "washroom", "lavatory", "wc", "loo")),
    ("dining", ("cafe", "cafeteria", "coffee", "food", "restaurant", "dining", "eat", "eating", "lunch", "dinner", "snack", "bar")),
    ("elevator", ("elevator", "lift")),
    ("info", ("info", "information")),
)
# Other names of amenities.
AMENITY_SYNONYMS = {
    "bathroom": "restroom",
    "bathrooms": "restroom",
    "toilet": "restroom",
    "toilets": "restroom",
    "wc": "restroom",
    "lift": "elevator",
    "lifts": "elevator",
    "staircase": "stairs",
    "stairway": "stairs",
}


def _order(group: list[str]):
    return Window.partitionBy(*group).orderBy(F.col("isHighlight").desc(), "objectID")


def positions(objects: DataFrame, group: list[str]) -> DataFrame:
    """position (from 1) and total in the group, highlights first; rows without a gallery are left out."""
    shown = objects.where(F.col("galleryNumber") != "")
    whole = Window.partitionBy(*group)
    return shown.withColumns({"position": F.row_number().over(_order(group)), "total": F.count("*").over(whole)})


def neighbours(objects: DataFrame, group: list[str]) -> DataFrame:
    """previous and following id, going round at the ends; a lone row is its own neighbour."""
    shown = objects.where(F.col("galleryNumber") != "")
    w = _order(group)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev = F.coalesce(F.lag("objectID").over(w), F.last("objectID").over(full))
    following = F.coalesce(F.lead("objectID").over(w), F.first("objectID").over(full))
    return shown.withColumns({"previous": prev, "following": following})


def capped(objects: DataFrame, group: list[str], cap: int = 500) -> DataFrame:
    """At most ``cap`` rows a group, in display order."""
    return positions(objects, group).where(F.col("position") <= cap)


def match_codes(galleries: DataFrame, digits: str, cap: int = 4) -> DataFrame:
    """Codes that begin with the digits: the exact one first, then by number."""
    hit = galleries.where(F.col("galleryNumber").startswith(digits))
    exact = (F.col("galleryNumber") == digits).cast("int")
    return hit.orderBy(exact.desc(), tx.natural_key(F.col("galleryNumber")), "galleryNumber").limit(cap)


def _some_begins(words: Column, q: str) -> Column:
    return F.exists(words, lambda w: w.startswith(q))


def match_words(galleries: DataFrame, query: str, cap: int | None = None, order: str = "ordinal") -> DataFrame:
    """Every query word begins some word of code and title; input order kept."""
    words = tx.tokens(F.concat_ws(" ", "galleryNumber", "title"))
    test = F.lit(True)
    for q in tx.query_tokens(query):
        test = test & _some_begins(words, q)
    out = galleries.where(test).orderBy(order)
    return out.limit(cap) if cap else out


def _fold_plural(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, "s$", ""))


def amenity_intent(c: Column) -> Column:
    """The kind of amenity asked for, or null; water needs a fountain as well."""
    words = _fold_plural(tx.tokens(c))
    out = F.when(F.array_contains(words, "fountain") & (F.array_contains(words, "water") | F.array_contains(words, "drinking")), "water")
    for kind, names in reversed(AMENITIES):
        folded = [n.removesuffix("s") for n in names]
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, folded))), kind).otherwise(out)
    return out


def match_amenities(amenities: DataFrame, query: str) -> DataFrame:
    """Amenities whose kind or name holds the query (or its synonym); none for fewer than three characters."""
    q = query.strip().lower()
    if len(q) < 3:
        return amenities.limit(0)
    q = AMENITY_SYNONYMS.get(q, q)
    return amenities.where(F.col("kind").contains(q) | F.lower("name").contains(q))


def match_labels(labels: DataFrame, objects: DataFrame) -> DataFrame:
    """(label, objectID, via): unique accession, else unique title, else unique title and artist.

    A key that several objects share decides nothing at its step.
    """
    squeeze = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))

    def unique(keys: list[Column]) -> DataFrame:
        named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
        return objects.select("objectID", *named).groupBy(*(f"k{i}" for i in range(len(keys)))).agg(F.count("*").alias("n"), F.min("objectID").alias("objectID")).where("n = 1").drop("n")

    out = labels.withColumns({"_a": squeeze(F.col("accession")), "_t": tx.normalize(F.col("title")), "_r": tx.normalize(F.col("artist"))})
    steps = (("accession", ["_a"], [squeeze(F.col("accession"))]), ("title", ["_t"], [tx.normalize(F.col("title"))]), ("artist", ["_t", "_r"], [tx.normalize(F.col("title")), tx.normalize(F.col("artist"))]))
    for name, own, keys in steps:
        u = unique(keys).withColumnRenamed("objectID", f"id_{name}")
        cond = [F.col(o) == F.col(f"k{i}") for i, o in enumerate(own)]
        for c in own:
            cond.append(F.col(c) != "")
        on = cond[0]
        for c in cond[1:]:
            on = on & c
        out = out.join(u, on, "left").drop(*(f"k{i}" for i in range(len(own))))
    via = F.when(F.col("id_accession").isNotNull(), "accession").when(F.col("id_title").isNotNull(), "title").when(F.col("id_artist").isNotNull(), "artist")
    return out.withColumns({"objectID": F.coalesce("id_accession", "id_title", "id_artist"), "via": via}).select("label", "objectID", "via")


def scope(c: Column, legacy: tuple[str, ...]) -> Column:
    """site and code of a gallery id: site:code pins the site, a bare code means the legacy sites."""
    scoped = F.instr(c, ":") > 0
    return F.struct(F.when(scoped, F.array(F.substring_index(c, ":", 1))).otherwise(F.array(*map(F.lit, legacy))).alias("sites"), F.when(scoped, F.substring_index(c, ":", -1)).otherwise(c).alias("code"))
