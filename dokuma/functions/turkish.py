"""Stems of Turkish nouns by a finite-state machine over suffix classes, written as regular expressions.

A noun is a stem, then at most one suffix of each class in this order: plural, possessive, case (with -ki), copula. What a
suffix looks like follows from what stands before it:

* vowel harmony: A is a or e as the last vowel is back or front; I is ı, i, u or ü by its rounding too. The stem's last vowel
  decides for the first suffix; behind an A only backness is left, so I is ı or i there;
* buffer letters: between vowels stands y, in the third person s, before a genitive and every case of a third person n;
* d of a suffix may be t.

A word is tried for known stems, then for stems that end in a vowel or a consonant, of which the shorter counts, then for a bare
-I behind a stem whose last vowel is its third letter or later. A bare -A stays, since most nouns that
end so (dava, ceza) are no datives, and so do the first and second person singular, which are endings of stems more often than
suffixes. A stem that lost a suffix ends in p, ç, t, k for b, c, d, ğ. No lexicon is needed, but ``known`` stems settle what
the rules cannot: kanunun is kanun-un, not kanu-nun.

Everything is built-in functions of a column; ``stem_sql`` is the same in SQL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeıioöuü"
#: The kinds of last vowels with A and I behind them.
KINDS = (("aı", "a", "ı"), ("ei", "e", "i"), ("ou", "a", "u"), ("öü", "e", "ü"))
SOFT, HARD = "bcdğ", "pçtk"
#: Frequent stems that end as a suffix does.
KNOWN = ("alan", "esas", "insan", "kadın", "kanun", "madde", "neden", "onama", "sorun", "zaman")


def _chain(a: str, i: str, ends: str) -> str:
    """The suffixes behind a stem that ends in a consonant (C) or a vowel (V)."""
    x = "ı" if a == "a" else "i"  # I behind an A
    place = f"[dt]{a}(?:n|ki)?"
    third = lambda i: f"(?:n{a}|n{place}|n{i}n|n{i}|yl{a})"
    case = lambda i: f"(?:{place}|{i}n|l{a}|{a}|{i})"
    plural = f"l{a}r(?:{x}[mn]{x}z{case(x)}?|{x}{third(x)}?|{case(x)})?"
    own = f"[mn]{i}z{case(i)}?|s{i}{third(i)}?|y{a}|y{i}|{place}|n{i}n|yl{a}" if ends == "V" else f"{i}[mn]{i}z{case(i)}?|{i}{third(i)}|{place}|{i}n|l{a}"
    return f"(?:(?:{plural}|{own})(?:[dt][ıiuü]r)?|[dt]{i}r)"


def passes(known: Iterable[str] = KNOWN) -> list[list[str]]:
    """Patterns, one group each, that holds the stem: for known stems, for stems in a vowel or a consonant, and before a bare -I."""
    last = lambda w: next((c for c in reversed(w) if c in VOWELS), "")
    given = []
    for ends in "VC":
        for kind, a, i in KINDS:
            words = "|".join(sorted(w for w in known if w and (w[-1] in VOWELS) == (ends == "V") and last(w) and last(w) in kind))
            if words:
                given.append(f"^({words})(?:{_chain(a, i, ends)}{'|' + i if ends == 'C' else ''})$")
    free = [rf"^(\p{{L}}+?[{k}]){_chain(a, i, 'V')}$" for k, a, i in KINDS] + [rf"^(\p{{L}}*?[{k}][^{VOWELS}]+?){_chain(a, i, 'C')}$" for k, a, i in KINDS]
    return [given, free, [rf"^(\p{{L}}{{2,}}?[{k}][^{VOWELS}]+?){i}$" for k, _, i in KINDS]]


def stem(word: Column, known: Iterable[str] = KNOWN) -> Column:
    """The stem of a word in lower case, itself where it has no suffix; null stays null."""
    known = tuple(known)
    once = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))  # noqa: E731  evaluates x a single time
    sized = lambda s: F.concat(F.lpad(F.length(s).cast("string"), 6, "0"), s)
    cut = lambda w, p: once(F.nullif(F.regexp_replace(w, p, "$1"), w), sized)
    shortest = lambda w: F.coalesce(*[F.substr(F.least(*[cut(w, p) for p in own], F.lit(None), F.lit(None)), F.lit(7)) for own in passes(known)])
    hard = lambda s: F.concat(F.left(s, F.length(s) - 1), F.translate(F.right(s, F.lit(1)), SOFT, HARD))
    return once(word, lambda w: F.when(w.isin(*known), w).otherwise(F.coalesce(once(shortest(w), hard), w)))


def stem_sql(word: str, known: Iterable[str] = KNOWN) -> str:
    """The same as SQL on a column or a short expression."""
    known = tuple(known)
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    sized = lambda p: f"list_transform([nullif(regexp_replace({word}, {quoted(p)}, '\\1'), {word})], lambda s: lpad(CAST(length(s) AS VARCHAR), 6, '0') || s)[1]"
    found = "coalesce(" + ", ".join(f"substr(least({', '.join(map(sized, own)) or 'NULL'}), 7)" for own in passes(known)) + ")"
    hard = f"list_transform([{found}], lambda s: left(s, length(s) - 1) || translate(right(s, 1), {quoted(SOFT)}, {quoted(HARD)}))[1]"
    return f"CASE WHEN {word} IN ({', '.join(map(quoted, known)) or 'NULL'}) THEN {word} ELSE coalesce({hard}, {word}) END"
