"""Similarity join of names by filter and verify.

The similarity is the ratio of Ratcliff and Obershelp: twice the letters M in matching blocks over the lengths' sum T. What
it bounds decides who meets whom, so that no name is compared with the whole vocabulary:

* lengths: M is at most the shorter length, so a partner of a name of length l has between l c / (2 - c) and
  l (2 - c) / c letters at a ratio of at least c;
* pieces: at most T - 2 M letters of both names together are unmatched, and each breaks one piece at most of a name that is
  cut into pieces. Cut into one more, it has a piece that stands in the other name as it is: names meet by an equi-join on it;
* places: where the first whole piece is the i-th, at least i letters before it are unmatched (from 0), and as many as it is
  shifted by; behind it at least as many as the rest of the lengths' difference. Together they are at most T - 2 M, so a
  piece is looked up at few places;
* letters: every unmatched letter changes the letters' counts by one, so counts, held as the bits of a number, differ in at most
  T - 2 M bits. What meets is held against that in the join, then the edit distance (T - 2 M at most) is taken, and only what
  is left is aligned.

Cuts are made where few names agree by chance: by how often two names of one length have the same letter at a place. So a
beginning that all names share lies within one piece.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dokuma.operators import graph

#: Names of more letters are cut into pieces of equal news; finding their best cuts would take the cube of the letters.
LONG = 256
#: Letters are counted in so many groups, the most frequent ones each and the rest together, up to so many of each.
GROUPS, COUNTED = 21, 3
#: A task keeps the letters of so many names counted.
COUNTS = 100_000


def _matched(both: int, least: float) -> int:
    """The letters in blocks that two names with so many letters together have at least."""
    return math.ceil(least * both / 2 - 1e-9)


def _unmatched(broken: int, shift: int) -> int:
    """The unmatched letters that break so many pieces and shift what follows by so much, at least."""
    x = max(broken, abs(shift))
    return x + (x - abs(shift)) % 2


def _shifts(i: int, more: int, spare: int) -> list[int]:
    """By how much a first whole piece, the i-th, may be shifted in a name that has so many more letters."""
    return [d for d in range(-spare, spare + 1) if _unmatched(i, d) + abs(more - d) <= spare]


def _cuts(news: np.ndarray, spare: int) -> list[tuple[int, int]]:
    """(place from 0, letters) of spare + 1 pieces: a meeting by chance is as likely as the letters' news is small, and a piece
    is looked up at as many places as it has shifts."""
    n, count = len(news), spare + 1
    upto = np.concatenate([[0.0], np.cumsum(news)])
    ends = [0]
    if n > LONG:
        for i in range(1, count):
            ends.append(min(max(int(np.searchsorted(upto, upto[-1] * i / count)), ends[-1] + 1), n - count + i))
        ends.append(n)
    else:
        chance = np.exp2(np.minimum(upto[:, None] - upto[None, :], 0.0))  # [start, end]
        chance[np.tril_indices(n + 1)] = np.inf
        cost, before = np.where(np.arange(n + 1) == 0, 0.0, np.inf), []
        for i in range(count):
            step = cost[:, None] + len(_shifts(i, spare % 2, spare)) * chance
            before.append(step.argmin(axis=0))
            cost = step.min(axis=0)
        ends = [n]
        for back in reversed(before):
            ends.append(int(back[ends[-1]]))
        ends.reverse()
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _plans(left: list[int], news: dict[int, np.ndarray], least: float) -> dict[bool, list[tuple[int, int, int, int, int, int]]]:
    """For either side (right?) the (letters of a name, of its partner or of itself, spare letters, piece, place, letters of the
    piece) that are looked up or found."""
    found: dict[bool, list] = {False: [], True: []}
    cuts: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for m in sorted(news):
        for n in sorted(left):
            spare = n + m - 2 * _matched(n + m, least)
            if not n or not m or 2 * min(n, m) < least * (n + m) - 1e-9 or spare <= 0:
                continue  # without a letter to spare only equal names are alike
            if (m, spare) not in cuts:
                cuts[m, spare] = _cuts(news[m], spare)
                found[True] += [(m, m, spare, i, at + 1, size) for i, (at, size) in enumerate(cuts[m, spare])]
            for i, (at, size) in enumerate(cuts[m, spare]):
                found[False] += [(n, m, spare, i, at + d + 1, size) for d in _shifts(i, n - m, spare) if 0 <= at + d <= n - size]
    return found


def _news(names: DataFrame) -> tuple[dict[int, np.ndarray], str]:
    """For each length of names, by place, how much it tells that a letter agrees: in bits, from the share of pairs that do;
    and the most frequent letters."""
    letters = names.select(F.length("name").alias("n"), F.posexplode(F.expr("transform(sequence(1, length(name)), i -> substr(name, i, 1))")).alias("place", "letter")).where("n > 0")
    counts = letters.groupBy("n", "place", "letter").agg(F.count("*").alias("k"))
    places = counts.groupBy("n", "place").agg((-F.log2(F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k")))).alias("bits"))
    common = counts.groupBy("letter").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "letter").limit(GROUPS - 1)
    out: dict[int, dict[int, float]] = {}
    alphabet = ""
    for n, place, bits, letter in places.select("*", F.lit(None).cast("string").alias("letter")).unionByName(common.select("letter"), allowMissingColumns=True).collect():  # a row for each place of a length
        if letter is not None:
            alphabet += letter
        else:
            out.setdefault(n, {})[place] = max(bits, 0.0) + 1e-6
    return {n: np.array([x[i] for i in range(n)]) for n, x in out.items()}, alphabet


def _counted(name: Column, alphabet: str) -> Column:
    """The letters' counts as bits, a further one for each letter up to ``COUNTED``; letters that are not in the alphabet are
    counted as one."""
    full = F.lit((1 << COUNTED) - 1).cast("long")
    at = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.call_function("instr", F.lit(alphabet), F.substr(name, i, F.lit(1))) * COUNTED)
    by = lambda f, bits, n: F.call_function(f, bits, n)
    one = lambda bits, n: bits.bitwiseOR(by("shiftleft", ((by("shiftright", bits, n).bitwiseAND(full)) * 2 + 1).bitwiseAND(full), n))
    return F.aggregate(at, F.lit(0).cast("long"), one)


def _keys(names: DataFrame, plan: list[tuple[int, int, int, int, int, int]], alphabet: str, side: str) -> DataFrame:
    """(key, id, bits, spare): the pieces of every name, as few bytes as may be."""
    pieces = names.sparkSession.createDataFrame(plan, "n int, m int, spare int, piece int, place int, size int")
    each = names.where("name <> ''").select("name", F.xxhash64("name").alias(side + "id"), _counted(F.col("name"), alphabet).alias(side + "bits"), F.length("name").alias("n"))
    key = F.hash("m", "spare", "piece", F.expr("substr(name, place, size)"))
    return each.join(F.broadcast(pieces), "n").select(key.alias("key"), side + "id", side + "bits", *["spare"] * (side == "l"))


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right): different names that may be alike, from two tables of distinct ``name``."""
    if least <= 2 / 3:
        raise ValueError("the bounds need a ratio over 2/3")
    lengths = [r[0] for r in left.select(F.length("name")).distinct().collect()]  # a row a length
    news, alphabet = _news(right)
    plans = _plans(lengths, news, least)
    if not plans[False]:
        return left.select(F.col("name").alias("left"), F.col("name").alias("right")).limit(0)
    # What differs in more letters than there are to spare is dropped within the join, so that chance meetings are never written.
    meets = F.bit_count(F.col("lbits").bitwiseXOR(F.col("rbits"))) <= F.col("spare")
    met = _keys(left, plans[False], alphabet, "l").join(_keys(right, plans[True], alphabet, "r").hint("merge"), "key").where(meets).select("lid", "rid").distinct()
    # Names that share an id, if ever two do, come both; the distance and the ratio see the names themselves.
    named = met.join(left.select(F.xxhash64("name").alias("lid"), F.col("name").alias("left")), "lid").join(right.select(F.xxhash64("name").alias("rid"), F.col("name").alias("right")), "rid")
    both = F.length("left") + F.length("right")
    return named.where((F.col("left") != F.col("right")) & (F.levenshtein("left", "right") <= both - 2 * F.ceil(least * both / 2 - 1e-9))).select("left", "right")


def _ratios(left: Iterable[str], right: Iterable[str], least: float, letters: dict[str, Counter]) -> Iterator[float | None]:
    for x, y in zip(left, right):
        if len(letters) > COUNTS:  # before a pair is counted: both counts are needed at once
            letters.clear()
        for s in (x, y):
            if s not in letters:
                letters[s] = Counter(s)
        if 2 * (letters[x] & letters[y]).total() < least * (len(x) + len(y)):
            yield None
            continue
        r = SequenceMatcher(None, y, x).ratio()
        yield r if r >= least else None


def ratio(left: Column, right: Column, least: float) -> Column:
    """The ratio of two names, or null where it is below ``least``."""

    @F.pandas_udf("double")
    def aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        letters: dict[str, Counter] = {}
        for a, b in batches:
            yield pd.Series(list(_ratios(a, b, least, letters)), dtype="float64")

    return aligned(left, right)


def alike(left: DataFrame, right: DataFrame, least: float = 0.88) -> DataFrame:
    """(left, right, ratio) of all pairs of ``name`` with a ratio of at least ``least``; equal names have 1. Null names take
    no part, repeated ones count once, empty ones meet empty ones."""
    a, b = (x.select("name").where("name IS NOT NULL").distinct() for x in (left, right))
    same = a.join(b, "name").select(F.col("name").alias("left"), F.col("name").alias("right"), F.lit(1.0).alias("ratio"))
    # Pairs are dealt anew, so that a name with many candidates is aligned by many tasks.
    near = candidates(a, b, least).repartition(F.col("left"), F.col("right")).withColumn("ratio", ratio(F.col("left"), F.col("right"), least))
    return same.union(near.where("ratio IS NOT NULL"))


def closest(left: DataFrame, right: DataFrame, least: float = 0.88) -> DataFrame:
    """(left, right, ratio): the best match of every name that has one; of equal ratios the last name. A name that is there as
    it is has no better one and is not looked for."""
    a, b = (graph.saved(x.select("name").where("name IS NOT NULL").distinct(), "names") for x in (left, right))
    same = a.join(b, "name").select(F.col("name").alias("left"), F.col("name").alias("right"), F.lit(1.0).alias("ratio"))
    rest = graph.saved(a.join(b, "name", "left_anti"), "names")
    best = alike(rest, b, least).groupBy("left").agg(F.max(F.struct("ratio", "right")).alias("m"))
    return same.union(best.select("left", "m.right", "m.ratio"))
