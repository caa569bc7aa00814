"""Text columns: court-name keys, identifiers, Turkish case, boundaries, snippets."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Capitals with a Turkish lower case of their own, and the letters folded to ASCII.
UPPER, LOWER = "İIÇĞÖŞÜ", "iıçğöşü"
FOLD_FROM, FOLD_TO = "çğıöşüâîû", "cgiosuaiu"
#: Long forms and their short ones in folded names.
ALIASES = (("bolgeadliyemahkemesi", "bam"), ("bolgeidaremahkemesi", "bim"), ("idari", "idare"))
WORD_CHARS = "0-9A-Za-zÇĞİıÖŞÜçğıöşü"


def turkish_lower(c: Column) -> Column:
    """Lower case with i and ı told apart; the translation comes first because lower('İ') is two characters."""
    return F.lower(F.translate(c, UPPER, LOWER))


def chamber_key(c: Column) -> Column:
    """A court or chamber name without case, accents, blanks and punctuation; null gives ''."""
    out = F.regexp_replace(F.translate(turkish_lower(F.coalesce(c, F.lit(""))), FOLD_FROM, FOLD_TO), "[^a-z0-9]+", "")
    for long, short in ALIASES:
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


def compact_id(c: Column) -> Column:
    """Digits and slashes only."""
    return F.regexp_replace(c, "[^0-9/]", "")


def has_word(source: Column, token: Column) -> Column:
    """Case-sensitive search at borders of Turkish words; false for an empty token."""
    quoted = F.concat(F.lit(f"(?<![{WORD_CHARS}])\\Q"), token, F.lit(f"\\E(?![{WORD_CHARS}])"))
    return F.coalesce((F.length(token) > 0) & F.regexp_like(source, quoted), F.lit(False))


def has_number(source: Column, number: Column) -> Column:
    """The number as a run of digits of its own."""
    return F.coalesce((F.length(number) > 0) & F.regexp_like(source, F.concat(F.lit("(?<!\\d)"), number, F.lit("(?!\\d)"))), F.lit(False))


def snippet(text: Column, start: Column, width: int) -> Column:
    """Trimmed text from ``width`` characters before a 0-based place to ``width`` behind it."""
    lo = F.greatest(start - width, F.lit(0))
    return F.trim(F.substring(text, lo + 1, start + width - lo))


def sentences(text: Column) -> Column:
    """Paragraphs (at blank lines) of sentences (behind . ! ? … and white space), flattened, without empty ones."""
    parts = F.flatten(F.transform(F.split(text, "\\n{2,}"), lambda p: F.split(F.trim(p), "(?<=[.!?…])\\s+")))
    return F.filter(F.transform(parts, F.trim), lambda s: s != "")


def keywords(line: Column) -> Column:
    """A bulleted list's entries."""
    return F.filter(F.transform(F.split(line, "•"), F.trim), lambda x: x != "")


def header(text: Column, lines: int = 40) -> Column:
    """The first lines of a text without form feeds."""
    return F.array_join(F.slice(F.split(F.replace(text, F.lit("\f"), F.lit("")), "\n"), 1, lines), "\n")


def strip_fence(c: Column) -> Column:
    """JSON inside a Markdown code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "^\\s*```(?:json)?\\s*", ""), "\\s*```\\s*$", ""))


def ascii_fold(c: Column) -> Column:
    """Turkish lower case without accents; other characters stay."""
    return F.translate(turkish_lower(c), FOLD_FROM, FOLD_TO)


def slugify(c: Column) -> Column:
    """Folded letters and digits, everything else as single dashes inside."""
    return F.regexp_replace(F.regexp_replace(F.replace(ascii_fold(F.translate(c, "ıI", "ii")), F.lit("̇"), F.lit("")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def nfc(c: Column) -> Column:
    """Canonical composition; Spark has no such function. Null stays null."""
    return _nfc(c)


@F.pandas_udf(StringType())
def _nfc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))
