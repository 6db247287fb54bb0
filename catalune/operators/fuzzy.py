"""Typo correction: trigram candidates, exact distance, compound splits, set-level decisions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as tx
from .shared import written

ACCEPT = 0.34
CANDIDATES = 50
KEEP = 3


def vocab_trigrams(vocab: DataFrame) -> DataFrame:
    """(term, df, gram) of a vocabulary (term, df)."""
    n = F.length("term")
    own = F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col("term"), i, F.lit(3)))))
    return vocab.select("term", "df", n.alias("len"), F.explode(own).alias("gram"))


def candidates(grams: DataFrame, token: str, limit: int = CANDIDATES) -> DataFrame:
    """(term, df, shared, rank): vocabulary terms that share trigrams with the token or its swapped variants.

    Ranked by shared grams against the term's length, then by term.
    """
    if len(token) < 3:
        return grams.select("term", "df", F.lit(0).alias("shared"), F.lit(0).alias("rank")).limit(0)
    variants = [token] + [token[:i] + token[i + 1] + token[i] + token[i + 2 :] for i in range(len(token) - 1)]
    wanted = sorted({v[i : i + 3] for v in variants for i in range(len(v) - 2)})
    hit = grams.where(F.col("gram").isin(*wanted)).groupBy("term", "df", "len").agg(F.count("*").alias("shared"))
    hit = hit.withColumn("closeness", F.col("shared") / F.sqrt(F.col("len").cast("double")))
    top = hit.orderBy(F.desc("closeness"), "term").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("closeness"), "term"))).select("term", "df", "shared", "rank")


def score_term(token: str, term: str) -> float:
    """The least of the whole term's normalised distance and the distances to its beginnings."""
    best = tx.osa(token, term) / max(len(token), len(term), 1)
    for n in (len(token), len(token) + 1):
        if n < len(term):
            best = min(best, tx.osa(token, term[:n]) / max(len(token), n, 1) + 0.05)
    return best


@F.pandas_udf(DoubleType())
def _scores(token: pd.Series, term: pd.Series) -> pd.Series:
    return pd.Series([score_term(a, b) for a, b in zip(token, term, strict=True)])


def rank_corrections(found: DataFrame, token: str, accept: float = ACCEPT, keep: int = KEEP) -> DataFrame:
    """(term, df, s, place): accepted corrections, the frequent ones favoured, ``keep`` at most."""
    s = found.withColumn("s", _scores(F.lit(token), F.col("term"))).where(F.col("s") <= accept)
    weight = F.col("s") - 0.03 * F.log10(F.col("df") + 1.0)
    w = Window.orderBy(weight, "rank")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).select("term", "df", "s", "place")


def split_places(post: DataFrame, token: str, least: int) -> DataFrame:
    """(at): the leftmost split whose halves begin terms of one object."""
    cuts = [i for i in range(least, len(token) - least + 1)]
    if not cuts:
        return post.select(F.lit(0).alias("at")).limit(0)
    halves = post.where(" OR ".join(f"startswith(term, '{token[:i]}') OR startswith(term, '{token[i:]}')" for i in cuts))
    flags = F.array_compact(F.array(*(F.when(F.col("term").startswith(h), F.lit(2 * i + side)) for i in cuts for side, h in ((0, token[:i]), (1, token[i:])))))
    per = halves.select("objectID", F.explode(flags).alias("f")).distinct()
    both = per.groupBy("objectID", F.floor(F.col("f") / 2).alias("at")).agg(F.count("*").alias("k")).where("k = 2")
    return both.agg(F.min("at").alias("at")).where("at is not null")


@dataclass
class Correction:
    """The decision for one token: the alternatives that replace it (itself if kept)."""

    token: str
    terms: list[str]
    split: tuple[str, str] | None = None
    changed: bool = False


def plan(query: str, post: DataFrame, vocab: DataFrame) -> list[Correction] | None:
    """Decisions for all tokens, or None if nothing changes or a token has no remedy.

    Control is on the driver, one decision a token; data stays distributed and
    at most ``KEEP`` rows come back for each token.
    """
    vocab = written(vocab, "vocabulary")
    grams = vocab_trigrams(vocab)
    out: list[Correction] = []
    for token in tx.query_tokens(query):
        if vocab.where(F.col("term").startswith(token)).limit(1).count():
            out.append(Correction(token, [token]))
            continue
        found = rank_corrections(candidates(grams, token), token).orderBy("place").collect()
        best = min((r.s for r in found), default=math.inf)
        cut = split_places(post, token, 3).first() if len(token) >= 6 and 1 / len(token) < best else None
        if cut is None and not found and len(token) >= 4:
            cut = split_places(post, token, 2).first()
        if cut is not None:
            out.append(Correction(token, [], (token[: cut["at"]], token[cut["at"] :]), True))
        elif found:
            out.append(Correction(token, [r.term for r in found], changed=True))
        else:
            return None
    return out if any(c.changed for c in out) else None


def correct(query: str, post: DataFrame, vocab: DataFrame) -> str | None:
    """The query with each token's first correction."""
    decided = plan(query, post, vocab)
    if decided is None:
        return None
    return " ".join(w for c in decided for w in (c.split or (c.terms[0],)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length of normalised titles without articles; 1 for two empty ones."""
    x, y = (F.trim(F.regexp_replace(tx.normalize(c), r"\b(the|a|an)\b ?", "")) for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def title_match(a: Column, b: Column) -> Column:
    """Containment either way, or at least half of the words longer than two in common."""
    x, y = tx.normalize(a), tx.normalize(b)
    words = F.filter(F.array_distinct(tx.tokens(a)), lambda t: F.length(t) > 2)
    common = F.size(F.array_intersect(words, tx.tokens(b)))
    return x.contains(y) | y.contains(x) | ((F.size(words) > 0) & (common * 2 >= F.size(words)))


def literal_echo(term: Column, suggestion: Column) -> Column:
    """Whether a suggested synonym only repeats the term, or the term it."""
    a, b = tx.normalize(term), tx.normalize(suggestion)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def gibberish(c: Column) -> Column:
    """Whether some word has five consonants in a row."""
    return tx.normalize(c).rlike("[bcdfghjklmnpqrstvwxz]{5}")
