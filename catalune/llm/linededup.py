"""Line dedup: exact set-similarity join of lines, on DataFrame operators only.

A line's tokens are its distinct words in lower case, separated by any white
space. A line is removed if an earlier line has a Jaccard similarity of at least
``num / den`` with it, whether that one stays or not; earlier means smaller
(doc_id, line number), null ids first, and for rows that share an id, smaller
hash of the row. Every line with a token takes part; blank lines stay.

1. Lines of equal text up to case are one class, with its earliest place. The
   classes and their token sets are a table bucketed by class, so later joins
   by class move the small side only.
2. Tokens are ordered by rarity: the number of classes with a token, summed in
   ``BUCKETS`` hash buckets, on a logarithmic scale, then by hash. Any fixed
   order keeps the join exact.
3. Heads. A band is all but one of the ``SKETCH`` tokens of least hash. The
   earliest classes of ``HEADS`` parts of a band are its heads. Each class is
   verified against that earlier head of its bands which is least apart by a
   signature. That is linear, and settles most members of large groups of near
   copies: they need not meet each other.
4. Prefix filter: similar lines share a token among their first
   n - ceil(t n) + 1. Unsettled classes meet all classes by prefix token; two
   settled ones never meet. A length filter, the positional bound on the
   overlap and a parity signature (a lower bound on the symmetric difference)
   are join conditions. What passes is verified on the whole sets.
5. A class's first line goes if a similar class begins earlier; all its other
   lines go.

Rows with the same id and text are one document here: their lines do not
remove each other, and all get the same result. Null texts have no lines;
empty tables give empty results. Columns of any name and ids of any type may
be there; n_lines and n_removed_lines are replaced. Identity of classes
is by 64 bits of hash, that of tokens within two lines by 56.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, written

NUM, DEN = 4, 5
BUCKETS = 1 << 17  # the table of ranks is a literal in the plans
SKETCH = 4
HEADS = 16
LONG, LONGER = 64, 192  # tokens of a line above which signatures have 128 and 192 bins
_TOKEN = (1 << 56) - 1  # the bits of a token's hash
#: what Python's str.split() parts words at, as one look at a character's type: a list of them takes twice the time
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _ceil(a: Column, b: int) -> Column:
    return F.floor((a + F.lit(b - 1)) / F.lit(b)).cast("int")


# Plain explode and columns that may be null make the optimizer add filters that compute the exploded
# or compared expression once more below; posexplode_outer and coalesce keep them out.


def _lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line, words, key) of the lines that are not blank; key is the class."""
    lines = docs.select(_row().alias("row"), "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "words"))
    return lines.where(F.col("words").rlike(f"[^{SPACE}]")).withColumn("key", F.xxhash64(F.lower("words")))


def _hash(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(_TOKEN))


def _parity(tokens: Column) -> Column:
    """The tokens' counts modulo 2 in 64 bins."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.coalesce(F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(bit(h))), F.lit(0).cast("long"))


def line_classes(docs: DataFrame) -> DataFrame:
    """(key, place, times, n, s0, s1, s2, low, set) of each class, bucketed by key; place: the first (doc_id, line, row).

    low are the ``SKETCH`` tokens of least hash. s0 is the parity signature in
    64 bins. For longer lines, s1 is that of one half of the tokens, and for
    still longer ones s2 of a quarter of them, in the other half, so that 128 or
    192 bins can be told from them. They are made here once, so that later steps
    read a few numbers of a class and not its set.
    """
    firsts = _lines(docs).groupBy("key").agg(F.min(F.struct("doc_id", "line", "row")).alias("place"), F.count("*").alias("times"), F.first("words").alias("words"))
    hashes = F.transform(F.split(F.lower("words"), f"[{SPACE}]"), _hash)
    sets = firsts.select("key", "place", "times", F.sort_array(F.array_remove(F.array_distinct(hashes), _hash(F.lit("")))).alias("set"))
    sets = sets.select("key", "place", "times", "set", F.coalesce(F.size("set"), F.lit(0)).alias("n"))

    def part(above: int, low: int, high: int) -> Column:
        return F.when(F.col("n") > above, _parity(F.filter("set", lambda h: h.bitwiseAND(F.lit(high)) == low))).otherwise(F.lit(0).cast("long"))

    signs = _parity(F.col("set")).alias("s0"), part(LONG, 64, 64).alias("s1"), part(LONGER, 128, 192).alias("s2")
    return bucketed(sets.select("key", "place", "times", "n", *signs, F.slice("set", 1, SKETCH).alias("low"), "set"), "key", "line-classes")


def rarity(classes: DataFrame) -> list[int]:
    """The log-scale count of each bucket, from 1 (least) to 127."""
    counts = classes.select(F.explode("set").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).count()
    got = counts.toArrow()  # at most BUCKETS rows
    table = np.ones(BUCKETS, np.uint8)
    table[got.column(0).to_numpy()] = np.minimum(127, 1 + 4 * np.log2(got.column(1).to_numpy()))
    return table.tolist()


def _ordered(ranks: list[int]) -> Column:
    """The set in order of rarity, each token as its rank above its hash."""
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<tinyint>")  # folded to one literal
    rank = lambda h: F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    # elements that may be null would be sorted as objects
    return F.sort_array(F.transform("set", lambda h: F.coalesce(F.shiftleft(rank(h).cast("long"), 56).bitwiseOR(h), F.lit(0).cast("long"))))


def _apart(least: Column) -> Column:
    """A lower bound on the tokens that only one of the lines a and b has: the bins whose parity differs; least: the shorter's size."""
    s0, s1, s2 = (F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}")) for s in ("s0", "s1", "s2"))
    rest = s0.bitwiseXOR(s1)
    thirds = F.bit_count(s1) + F.bit_count(s2) + F.bit_count(rest.bitwiseXOR(s2))
    return F.when(least <= LONG, F.bit_count(s0)).when(least <= LONGER, F.bit_count(s1) + F.bit_count(rest)).otherwise(thirds)


def _need(na: Column, nb: Column, num: int, den: int) -> Column:
    """The tokens that similar lines have in common, at least."""
    return _ceil((na + nb) * num, num + den)


def _fit(na: Column, nb: Column, num: int, den: int) -> Column:
    """The length filter and the bound of the signatures."""
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (_apart(F.least(na, nb)) <= na + nb - 2 * _need(na, nb, num, den))


def head_pairs(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): for each class b with an earlier head in one of its bands that may be similar, the one least apart.

    A band's heads are the earliest classes of ``HEADS`` parts of it. Bands go by
    hash alone: by rarity, the words that a near copy has of its own would come
    first.
    """
    spark = classes.sparkSession
    most = [F.xxhash64(*(F.get("low", F.lit(i)) for i in range(SKETCH) if i != left)) for left in range(SKETCH)]
    bands = classes.select("key", F.explode_outer(F.array_distinct(F.array(*most))).alias("band"))
    shared = bands.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("band")
    # most bands are of one class: only the others' classes meet
    met = bands.join(shared.hint("shuffle_hash"), "band")
    signed = written(spark, classes.select("key", "place", "n", "s0", "s1", "s2").join(met.hint("shuffle_hash"), "key"), "line-members")
    heads = signed.groupBy("band", F.pmod(F.xxhash64("key"), F.lit(HEADS))).agg(F.min(F.struct("place", "key", "n", "s0", "s1", "s2")).alias("head")).select("band", "head.*")
    near = heads.alias("a").join(signed.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.place") < F.col("b.place")) & _fit(F.col("a.n"), F.col("b.n"), num, den))
    nearest = near.groupBy(F.col("b.key").alias("b")).agg(F.min(F.struct(_apart(F.least("a.n", "b.n")).alias("apart"), F.col("a.place"), F.col("a.key").alias("a"))).alias("x"))
    pairs = written(spark, nearest.select("x.a", "b"), "line-near")
    discard(signed)
    return pairs


def prefixes(classes: DataFrame, settled: DataFrame, ranks: list[int], num: int, den: int) -> DataFrame:
    """(token, key, sized, s0, s1, s2): a row for each prefix token of each class; sized holds n above, then a bit for settled ones, and the position below."""
    size = (F.col("n") - _ceil(F.col("n") * num, den) + 1).cast("int")
    marked = classes.join(settled.select("key", F.lit(1 << 31).alias("shut")).hint("shuffle_hash"), "key", "left")
    head = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.coalesce("shut", F.lit(0)).cast("long")).alias("head")
    out = marked.select("key", head, "s0", "s1", "s2", F.posexplode_outer(F.slice(_ordered(ranks), 1, size)).alias("at", "token"))
    return out.select(F.col("token").bitwiseAND(F.lit((1 << 40) - 1)).alias("token"), "key", F.col("head").bitwiseOR(F.coalesce("at", F.lit(0)).cast("long")).alias("sized"), "s0", "s1", "s2")


def candidates(classes: DataFrame, settled: DataFrame, ranks: list[int], num: int, den: int) -> DataFrame:
    """(a, b) pairs of classes that pass the filters, at least one of them unsettled; a is the smaller set."""
    rows = prefixes(classes, settled, ranks, num, den)
    a, b = rows.alias("a"), rows.alias("b")
    na, nb = (F.shiftright(f"{x}.sized", 32).cast("int") for x in "ab")
    at, bt = (F.col(f"{x}.sized").bitwiseAND(F.lit((1 << 31) - 1)) for x in "ab")
    shut = F.col("a.sized").bitwiseAND(F.col("b.sized")).bitwiseAND(F.lit(1 << 31)) != 0
    order = (na < nb) | ((na == nb) & (F.col("a.key") < F.col("b.key")))
    meet = (F.col("a.token") == F.col("b.token")) & order & ~shut & (F.least(na - at, nb - bt) >= _need(na, nb, num, den)) & _fit(na, nb, num, den)
    return a.join(b, meet).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def later(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(key) of the later class of each similar pair (a, b)."""
    spark = classes.sparkSession
    # one class may head many pairs: the sets are a table of their own, so that a large group's pairs can be split
    met = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = written(spark, classes.select("key", "place", "set").join(met.hint("shuffle_hash"), "key", "left_semi"), "line-sets")
    side = lambda x: sets.select(F.col("key").alias(x), F.col("place").alias(f"p{x}"), F.col("set").alias(f"s{x}"))
    both = side("b").join(pairs, "b").join(side("a"), "a")
    similar = F.size(F.array_intersect("sa", "sb")) * (num + den) >= (F.size("sa") + F.size("sb")) * num
    out = written(spark, both.where(similar).select(F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a")).alias("key")).distinct(), "line-later")
    discard(sets, pairs)
    return out


def removed_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(row, lines array<int>) of the rows that lose lines."""
    spark = docs.sparkSession
    classes = line_classes(docs)
    ranks = rarity(classes)
    settled = later(head_pairs(classes, num, den), classes, num, den)
    others = later(written(spark, candidates(classes, settled, ranks, num, den), "line-pairs"), classes, num, den)
    gone = settled.union(others).distinct().select("key", F.lit(True).alias("later"))
    # only classes with something to remove travel on
    judged = classes.select("key", "place.line", "place.row", "times").join(gone.hint("shuffle_hash"), "key", "left").where(F.col("later") | (F.col("times") > 1))
    judged = written(spark, judged.select("key", F.col("line").alias("l"), F.col("row").alias("r"), F.coalesce("later", F.lit(False)).alias("later")), "line-judged")
    discard(classes, settled, others)
    lost = _lines(docs).select("row", "line", "key").join(judged, "key").where(F.col("later") | (F.col("row") != F.col("r")) | (F.col("line") != F.col("l")))
    return lost.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with the later similar lines taken out of ``text``; adds n_lines and n_removed_lines.

    The other columns stay; a column named n_chars is recomputed, columns named
    n_lines or n_removed_lines are replaced.
    """
    gone = removed_lines(docs, num, den)
    out = docs.select(_row().alias("row"), F.struct("*").alias("doc")).join(gone, "row", "left")
    text, parts = F.col("doc.text"), F.split("doc.text", "\n")
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col("lines"), s["i"]))
    made = {
        "text": F.when(F.col("lines").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n")),
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(parts)),
        "n_removed_lines": F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")),
    }
    names = [c for c in docs.columns if c not in made or c == "text"]
    out = out.select(*(made[c].alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in names), made["n_lines"].alias("n_lines"), made["n_removed_lines"].alias("n_removed_lines"))
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out
