"""Text expressions: normalising, tokens, grams, codes, natural order."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

# The words that a relaxed query leaves out.
STOPWORDS = (
    "a", "an", "the", "of", "in", "on", "at", "by", "for", "with", "to",
    "and", "or", "is", "are", "was", "were", "that", "this", "it", "its",
    "from", "as", "i", "me", "my", "some", "any", "show", "find",
)


def normalize(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda t: t != "")


def query_tokens(q: str) -> list[str]:
    """The driver-side twin of ``tokens`` for a query string."""
    return "".join(ch if ch.isalnum() else " " for ch in q.lower()).split()


def relaxed_tokens(q: str) -> list[str]:
    """Tokens without stopwords; all of them if none would be left."""
    words = query_tokens(q)
    return [w for w in words if w not in STOPWORDS] or words


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a token and of its variants with two neighbours swapped."""
    n = F.length(c)
    swaps = F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, n))))
    words = F.concat(F.array(c), swaps)
    grams = F.flatten(F.transform(words, lambda w: F.when(F.length(w) < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))
    return F.array_distinct(grams)


def natural_key(c: Column) -> Column:
    """A key that sorts codes by their numbers: digit runs padded to twelve places."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 12, "0")).otherwise(r)), "")


def like_contains(c: Column, pattern_tokens: list[str]) -> Column:
    """ASCII case-insensitive containment of the tokens in order, with LIKE signs taken literally."""
    escaped = [t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").lower() for t in pattern_tokens]
    return F.lower(c).like("%" + "%".join(escaped) + "%")


def strip_article(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^(the|a|an)\s+", "")


def short_title(c: Column) -> Column:
    """What stands before a colon and before a comma with a number."""
    return F.trim(F.regexp_replace(F.split_part(c, F.lit(":"), F.lit(1)), r",\s*\d.*$", ""))


def first_match(c: Column, patterns: list[tuple[str, int]]) -> Column:
    """The group of the first pattern that matches, or ''."""
    out = F.lit("")
    for p, g in reversed(patterns):
        out = F.when(c.rlike(p), F.regexp_extract(c, p, g)).otherwise(out)
    return out


def strip_markup(c: Column) -> Column:
    """Tags out, the common character references decoded, white space collapsed."""
    out = F.regexp_replace(c, r"<[^>]*>", " ")
    for ref, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(ch))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def scoped_id(site: Column, code: Column, bare_sites: tuple[str, ...] = ()) -> Column:
    """site:code, or the bare code for sites that keep theirs."""
    return F.when(site.isin(*bare_sites) if bare_sites else F.lit(False), code).otherwise(F.concat(site, F.lit(":"), code))


def id48(c: Column) -> Column:
    """A 48-bit id: the first 12 hex digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 12), 16, 10).cast("long")


@pandas_udf(StringType())
def fold_diacritics(s: pd.Series) -> pd.Series:
    """Lower case without combining marks (Spark has no normalisation form)."""
    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFD", x.lower()) if not "̀" <= ch <= "ͯ"))


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance: an exchange of neighbours costs one."""
    if a == b:
        return 0
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


@pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(w: str) -> str:
    """Porter's 1980 stemmer."""
    if len(w) <= 2 or not w.isascii():
        return w

    def shape(s: str) -> str:
        out = ""
        for i, ch in enumerate(s):
            vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
            out += "v" if vowel else "c"
        return out

    def measure(s: str) -> int:
        return shape(s).count("vc")

    def has_vowel(s: str) -> bool:
        return "v" in shape(s)

    def cvc(s: str) -> bool:
        return len(s) >= 3 and shape(s)[-3:] == "cvc" and s[-1] not in "wxy"

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            rest = w[: -len(end)]
            if measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


@pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])
