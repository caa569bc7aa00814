"""Scoring machine-extracted records against gold records, field by field, and comparing runs.

A record's fields are compared on the workers; files, fields and runs are then weighed with aggregates. Comparing text
uses difflib's ratio, which has no column form.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.functions.pieces import pieces

# Field -> (kind, weight); parts of nested objects; for lists of objects, the parts that identify an item
# and those that are compared. Least similarity of matching items and of matching strings.
FIELDS = {
    "court_type": ("exact", 1.0),
    "court": ("text", 1.0),
    "case_number": ("id", 1.0),
    "decision_number": ("id", 1.0),
    "decision_date": ("exact", 1.0),
    "decision_type": ("exact", 1.0),
    "is_final": ("bool", 1.0),
    "finality_basis": ("text", 0.5),
    "decision_outcome": ("exact", 1.5),
    "decision_outcome_raw": ("text", 0.5),
    "vote_unanimity": ("exact", 1.0),
    "has_dissent": ("bool", 1.0),
    "dissent_summary": ("text", 0.5),
    "appellants": ("str_list", 1.0),
    "appeal_outcomes_by_role": ("obj_list", 1.0),
    "subject": ("text", 1.5),
    "summary": ("text", 2.0),
    "keywords": ("str_list", 1.5),
    "legal_issues": ("str_list", 1.5),
    "legal_concepts": ("obj_list", 2.0),
    "dispositive_reasoning": ("obj", 2.0),
    "fact_pattern": ("obj", 1.5),
    "cited_court_decisions": ("obj_list", 2.0),
    "cited_law_articles": ("obj_list", 2.0),
}
PARTS = {
    "dispositive_reasoning": {"issue": ("text", 1.0), "rule": ("text", 1.0), "application": ("text", 1.0), "conclusion": ("text", 1.0)},
    "fact_pattern": {"actor_roles": ("str_list", 1.0), "context": ("text", 1.0), "trigger": ("text", 1.0), "claim": ("text", 1.0)},
    "appeal_outcomes_by_role": {"result": ("exact", 1.0)},
    "legal_concepts": {"role": ("exact", 1.0), "context_in_reasoning": ("text", 1.0)},
    "cited_court_decisions": {"court": ("text", 1.0), "cited_court_type": ("exact", 0.5), "case_number": ("id", 1.0), "decision_number": ("id", 1.0), "relation": ("exact", 0.5), "outcome": ("exact", 0.5), "treatment": ("exact", 0.5), "context": ("text", 1.0)},
    "cited_law_articles": {"law": ("text", 1.0), "law_number": ("id", 0.5), "article": ("id", 1.0), "context": ("text", 1.0)},
}
IDENTITY = {
    "appeal_outcomes_by_role": {"role": "id"},
    "legal_concepts": {"concept": "id"},
    "cited_court_decisions": {"case_number": "id", "decision_number": "id", "court": "text"},
    "cited_law_articles": {"article": "id", "law_number": "id", "law": "text"},
}
LEAST_ITEM, LEAST_STRING = 0.7, 0.85

SCORES = "file string, field string, weight double, raw double, score double, matched int, gold_count int, result_count int, precision double, recall double, f1 double, avg_value_score double, parts map<string,double>"


@lru_cache(maxsize=1 << 14)
def _folded(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text.lower())
    return " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())


def folded(x) -> str:
    """Lower case without accents, white space collapsed; null is ''."""
    return "" if x is None else _folded(str(x))


@lru_cache(maxsize=1 << 14)
def _squeezed(text: str) -> str:
    return re.sub("[^a-z0-9]", "", _folded(text))


def squeezed(x) -> str:
    return "" if x is None else _squeezed(str(x))


def ratio(a: str, b: str) -> float:
    if a == b or not a or not b:  # equal texts need no alignment
        return float(a == b)
    return SequenceMatcher(None, a, b).ratio()


def harmonic(precision: float, recall: float) -> float:
    return 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def strings(gold, result) -> float:
    """F1 of two lists of strings; each gold string takes the first free result string that is alike. Two empty lists
    agree."""
    a, b = ([folded(x) for x in side or [] if x] for side in (gold, result))
    if not a or not b:
        return float(not a and not b)
    free = dict(enumerate(b))
    for x in a:
        hit = next((i for i, y in free.items() if x == y or ratio(x, y) >= LEAST_STRING), None)
        free.pop(hit, None)
    hits = len(b) - len(free)
    return harmonic(hits / len(b), hits / len(a))


COMPARE = {
    "exact": lambda a, b: float(folded(a) == folded(b)),
    "id": lambda a, b: float(squeezed(a) == squeezed(b)),
    "bool": lambda a, b: float(a == b),
    "text": lambda a, b: ratio(folded(a), folded(b)),
    "str_list": strings,
}


#: What of a value counts, by kind, where values agree or not; and values that identify nothing.
CHANGE = {"id": squeezed, "exact": folded, "text": folded}
BLANK = (None, "", [])


def compared(gold: dict, result: dict, parts: dict) -> tuple[float, dict]:
    """(weighted mean, score of each part)."""
    each = {name: COMPARE[kind](gold.get(name), result.get(name)) for name, (kind, _) in parts.items()}
    return sum(each[n] * w for n, (_, w) in parts.items()) / sum(w for _, w in parts.values()), each


def bounds(gold: list[dict], result: list[dict], pairs: set[tuple[int, int]], parts: dict) -> Iterator[tuple[float, int, int]]:
    """(bound of the weighted mean, i, j) of each pair; no text is aligned: texts agree as far as their lengths allow."""
    total = sum(w for _, w in parts.values())
    whole = [(kind, w / total, *([CHANGE.get(kind, lambda x: x)(x.get(n)) for x in side] for side in (gold, result))) for n, (kind, w) in parts.items()]
    for i, j in pairs:
        most = 0.0
        for kind, w, left, right in whole:
            a, b = left[i], right[j]
            if a == b:
                most += w
            elif kind == "text" and a and b:
                most += w * 2 * min(len(a), len(b)) / (len(a) + len(b))
            elif kind == "str_list":
                most += w
        yield most + 1e-9, i, j


def alike_texts(left: list[str], right: list[str], least: float) -> Iterator[tuple[int, int]]:
    """(i, j) of texts whose ratio is at least ``least``: equal ones by a hash, the others by a prefix filter. Two texts with
    that ratio have least / 2 of their letters together in common, so they share one of each other's rarest letters, n less
    that number plus one of them, repeated letters counted apart; only such pairs of near lengths are aligned."""
    where: dict[str, list[int]] = {}
    for j, y in enumerate(right):
        where.setdefault(y, []).append(j)
    tokens = {x: [(c, n) for c, k in Counter(x).items() for n in range(k)] for x in {*left, *where}}
    common = Counter(t for y in where for t in tokens[y])

    def prefix(x: str) -> list[tuple[str, int]]:
        shared = math.ceil(least / 2 * (len(x) + math.ceil(len(x) * least / (2 - least) - 1e-9)) - 1e-9)
        return sorted(tokens[x], key=lambda t: (common[t], t))[: max(len(x) - shared + 1, 0)]

    index: dict[tuple[str, int], list[str]] = {}
    for y in where:
        for t in prefix(y):
            index.setdefault(t, []).append(y)
    found: dict[str, list[str]] = {}
    for i, x in enumerate(left):
        if x not in found:
            near = {y for t in prefix(x) for y in index.get(t, ()) if y != x and 2 * min(len(x), len(y)) >= least * (len(x) + len(y))}
            letters = Counter(x)
            found[x] = [y for y in near if 2 * (letters & Counter(y)).total() >= least * (len(x) + len(y)) and ratio(x, y) >= least] + [x] * (x in where)
        yield from ((i, j) for y in found[x] for j in where[y])


def same_items(gold: list[dict], result: list[dict], identity: dict) -> set[tuple[int, int]]:
    """(i, j) of items with an identity in common: values equal by a hash, texts alike by ``alike_texts``."""
    found = set()
    for name, kind in identity.items():
        sides = [[(i, x[name]) for i, x in enumerate(side) if x.get(name) not in BLANK] for side in (gold, result)]
        if not all(sides):
            continue
        change = squeezed if kind == "id" else folded
        (gi, left), (ri, right) = (([i for i, _ in side], [change(v) for _, v in side]) for side in sides)
        if kind == "text":
            found.update((gi[a], ri[b]) for a, b in alike_texts(left, right, LEAST_ITEM))
            continue
        where: dict[str, list[int]] = {}
        for j, y in zip(ri, right):
            where.setdefault(y, []).append(j)
        found.update((i, j) for i, x in zip(gi, left) for j in where.get(x, ()))
    return found


@lru_cache
def _item(how: tuple) -> tuple[list[str], Callable]:
    """(the names of parts and identities, a function of their values that gives what counts of the parts, of the identities)."""
    parts, identity = how
    names = list(dict.fromkeys(n for n, _ in parts + identity))
    at = {n: i for i, n in enumerate(names)}
    shown, known = ([(at[n], CHANGE[kind]) for n, kind in side] for side in how)

    @lru_cache(maxsize=1 << 14, typed=True)
    def item(*given) -> tuple[tuple, tuple]:
        return tuple([f(given[i]) for i, f in shown]), tuple([None if given[i] in BLANK else f(given[i]) for i, f in known])

    return names, item


def agreeing(gold: list[dict], result: list[dict], identity: dict, parts: dict) -> list[tuple[int, int]]:
    """(i, j) of items that agree in all parts, found by a hash: only such a pair has the value 1, so all of them come before any
    other, the first of each kind with the first. Where items agree in all parts but not in what identifies them, or nothing
    does, none of their kind is taken here."""
    if any(kind not in CHANGE for kind, _ in parts.values()):
        return []
    names, item = _item((tuple((n, kind) for n, (kind, _) in parts.items()), tuple(identity.items())))
    kinds: dict[tuple, tuple[set, list[int], list[int]]] = {}
    for side, items in ((1, gold), (2, result)):
        for at, x in enumerate(items):
            try:
                values, name = item(*map(x.get, names))
            except TypeError:  # a list has no hash
                values, name = item.__wrapped__(*map(x.get, names))
            kind = kinds.get(values)
            if kind is None:
                kind = kinds[values] = (set(), [], [])
            kind[0].add(name)
            kind[side].append(at)
    return [pair for names, left, right in kinds.values() if len(names) == 1 and any(v is not None for v in next(iter(names))) for pair in zip(left, right)]


def paired(gold: list[dict], result: list[dict], identity: dict, parts: dict) -> list[tuple[float, dict]]:
    """(value, score of each part) of items paired one to one, the most alike first, ties in list order. Items that agree in
    all parts are paired first. Pairs of the others wait by a bound of their value, and a pair is compared only when its
    bound comes first and both items are free."""
    first = agreeing(gold, result, identity, parts)
    free = [[i for i in range(len(side)) if i not in gone] for side, gone in zip((gold, result), ({i for i, _ in first}, {j for _, j in first}))]
    left, right = ([side[i] for i in at] for side, at in zip((gold, result), free))
    alike = same_items(left, right, identity)
    waiting = [(-most, 0, free[0][i], free[1][j], None) for most, i, j in bounds(left, right, alike, parts)] if alike else []
    heapq.heapify(waiting)
    rows, columns, taken = set(), set(), [(-1.0, i, j, dict.fromkeys(parts, 1.0)) for i, j in first]
    while waiting:
        value, known, i, j, each = heapq.heappop(waiting)
        if i in rows or j in columns:
            continue
        if not known:
            value, each = compared(gold[i], result[j], parts)
            heapq.heappush(waiting, (-value, 1, i, j, each))
            continue
        rows.add(i)
        columns.add(j)
        taken.append((value, i, j, each))
    return [(-value, each) for value, _, _, each in sorted(taken, key=lambda t: t[:3])]


def objects(gold: list, result: list, field: str) -> dict:
    """Items with an identity in common are paired one to one (``paired``); a pair counts as a hit as far as its values agree.
    Two empty lists agree in everything."""
    parts = PARTS[field]
    sizes = {"gold_count": len(gold), "result_count": len(result)}
    if not gold or not result:
        x = float(not gold and not result)
        return sizes | dict(raw=x, matched=0, precision=x, recall=x, f1=x, avg_value_score=x, parts=dict.fromkeys(parts, x))
    taken = paired(gold, result, IDENTITY[field], parts)
    total = sum(v for v, _ in taken)
    precision, recall = total / len(result), total / len(gold)
    mean = {n: round(sum(each[n] for _, each in taken) / len(taken), 4) if taken else None for n in parts}
    f1 = harmonic(precision, recall)
    return sizes | dict(raw=f1, matched=len(taken), precision=round(precision, 4), recall=round(recall, 4), f1=round(f1, 4), avg_value_score=round(total / len(taken), 4) if taken else 0.0, parts=mean)


def field_rows(gold: dict, result: dict, fields: Iterable[str] = tuple(FIELDS)) -> Iterator[dict]:
    for name in fields:
        kind, weight = FIELDS[name]
        a, b = gold.get(name), result.get(name)
        if kind == "obj_list":
            row = objects(a or [], b or [], name)
        elif kind == "obj":
            raw, each = compared(a or {}, b or {}, PARTS[name])
            row = {"raw": raw, "parts": {n: round(x, 4) for n, x in each.items()}}
        else:
            row = {"raw": COMPARE[kind](a, b)}
        yield {"field": name, "weight": weight, "score": round(row["raw"], 4), "parts": None} | row


def scored(gold: DataFrame, results: DataFrame, fields: Iterable[str] = tuple(FIELDS)) -> DataFrame:
    """One row a file and field of files (file, record as JSON) on both sides, for the fields asked for. A record that is no
    JSON object gives one row without a field and score 0."""
    fields = tuple(fields)
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", SCORES)]

    def parsed(x: str) -> dict | None:
        try:
            got = json.loads(x)
        except (TypeError, ValueError):
            return None
        return got if isinstance(got, dict) else None

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "gold", "result"):
            rows = []
            for file, a, b in zip(pdf.file, pdf.gold, pdf.result):
                a, b = parsed(a), parsed(b)
                rows += [{"file": file, "raw": 0.0, "score": 0.0, "parts": None}] if a is None or b is None else [{"file": file} | r for r in field_rows(a, b, fields)]
            yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(("matched", "gold_count", "result_count"), "Int32"))

    both = gold.select("file", F.col("record").alias("gold")).join(results.select("file", F.col("record").alias("result")), "file")
    return both.mapInPandas(work, SCORES)


def by_file(scores: DataFrame) -> DataFrame:
    """(file, overall): the weighted mean of the fields."""
    weighed = F.sum(F.col("raw") * F.col("weight")) / F.sum("weight")
    return scores.groupBy("file").agg(F.round(F.coalesce(weighed, F.lit(0.0)), 4).alias("overall"))


def by_field(scores: DataFrame) -> DataFrame:
    """(field, score, ...) over files, weakest field first; counts are sums."""
    mean = [F.round(F.avg(c), 4).alias(c) for c in ("score", "precision", "recall", "f1", "avg_value_score")]
    return scores.where("field IS NOT NULL").groupBy("field").agg(*mean, *[F.sum(c).alias(c) for c in ("matched", "gold_count", "result_count")]).orderBy(F.asc_nulls_last("score"), "field")


def by_part(scores: DataFrame) -> DataFrame:
    """(field, part, score) of objects and lists of objects; files without a matched item do not count."""
    rows = scores.where("field IS NOT NULL").select("field", F.explode("parts").alias("part", "score"))
    return rows.groupBy("field", "part").agg(F.round(F.avg("score"), 4).alias("score"))


def summary(gold: DataFrame, results: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: files on each side, coverage, the mean over scored files and the mean with missing files as 0."""
    sides = gold.select("file", F.lit(1).alias("g"), F.lit(0).alias("r")).union(results.select("file", F.lit(0), F.lit(1))).groupBy("file").agg(F.max("g").alias("g"), F.max("r").alias("r"))
    rows = sides.join(by_file(scores), "file", "left")
    n, zero = F.sum("g"), F.lit(0.0)
    return rows.agg(
        n.alias("files_in_gold"), F.sum("r").alias("files_in_result"), F.count_if((F.col("g") == 1) & (F.col("r") == 1)).alias("files_scored"),
        F.round(F.coalesce(F.count_if((F.col("g") == 1) & (F.col("r") == 1)) / F.nullif(n, F.lit(0)), zero), 4).alias("coverage"),
        F.round(F.coalesce(F.avg("overall"), zero), 4).alias("mean_scored"), F.round(F.coalesce(F.sum("overall") / F.nullif(n, F.lit(0)), zero), 4).alias("mean_missing_as_zero"),
    )


def unpaired(gold: DataFrame, results: DataFrame) -> DataFrame:
    """(file, side) of files that only one side has."""
    alone = lambda a, b, side: a.select("file").join(b, "file", "left_anti").select("file", F.lit(side).alias("side"))
    return alone(gold, results, "missing_in_result").union(alone(results, gold, "extra_in_result"))


def runs_compared(scores: DataFrame) -> DataFrame:
    """(field, one column a run) of scores with a column run: mean field scores side by side, weakest first."""
    table = scores.where("field IS NOT NULL").groupBy("field").pivot("run").agg(F.round(F.avg("score"), 4))
    runs = [c for c in table.columns if c != "field"]
    lowest = F.least(*[F.coalesce(c, F.lit(2.0)) for c in runs], F.lit(2.0)) if runs else F.lit(2.0)
    return table.orderBy(lowest, "field")
