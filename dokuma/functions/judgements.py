"""What a decision did and what it is: outcome, vote, type, authority, treatment of a cited decision, standing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dokuma.functions.text import ascii_fold

LAST_LINES = 200

# Folded words and what they say; the first class with a word in the text counts.
OUTCOMES = (
    ("kismen_bozma", ("kismen bozulmasina", "kismen onanmasina")),
    ("bozma", ("bozulmasina",)),
    ("onama", ("onanmasina",)),
    ("red", ("reddine",)),
    ("kabul", ("kabulune",)),
    ("direnme", ("direnme",)),
)
VOTES = (("oy_birligi", ("oy birligiyle", "oybirligiyle")), ("oy_coklugu", ("oy cokluguyla", "oycokluguyla")))
TREATMENTS = (
    ("FOLLOWS", ("uygun olarak", "dogrultusunda", "emsal", "yerlesik ictihat")),
    ("REVERSES", ("bozulmasina", "bozma", "isabetsiz", "yanlis", "hatali")),
    ("AFFIRMS", ("onanmasina", "isabetli", "uygun", "ayni gorusde", "yerinde")),
    ("DISTINGUISHES", ("farkli", "uygulanmaz", "bu davada", "ayrik")),
)
CONSTITUTIONAL = (
    ("bireysel_basvuru", ("bireysel basvuru", "basvuru numarasi")),
    ("siyasi_parti_kapatma", ("siyasi parti",)),
    ("yasama_dokunulmazligi", ("yasama dokunulmazligi",)),
    ("yuce_divan", ("yuce divan",)),
)
#: Factor of a score by standing; unification decisions keep theirs.
PENALTIES = {"overruled": 0.3, "disputed": 0.6}
OPPOSITE = {"onama": "bozma", "bozma": "onama", "kabul": "red", "red": "kabul"}


def by_words(folded: Column, classes: tuple, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, words in reversed(classes):
        hit = F.lit(False)
        for w in words:
            hit = hit | folded.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def closing(text: Column, lines: int = LAST_LINES) -> Column:
    """The folded last lines of a text, white space collapsed."""
    all_lines = F.split(text, "\n")
    kept = F.slice(all_lines, F.greatest(F.size(all_lines) - lines + 1, F.lit(1)), lines)
    return F.regexp_replace(ascii_fold(F.array_join(kept, " ")), "\\s+", " ")


def disposition(text: Column) -> Column:
    """The outcome that the closing lines name; null text and no known word: unknown."""
    return by_words(closing(text), OUTCOMES, "unknown")


def voting(text: Column) -> Column:
    return by_words(closing(text), VOTES, "unknown")


def treatment(snippet: Column) -> Column:
    """How a citing passage takes the cited decision; NEUTRAL without a known word."""
    return by_words(F.regexp_replace(ascii_fold(snippet), "\\s+", " "), TREATMENTS, "NEUTRAL")


def decision_type(court: Column, level: Column, text: Column) -> Column:
    constitutional = by_words(F.regexp_replace(ascii_fold(text), "\\s+", " "), CONSTITUTIONAL, "norm_denetimi")
    return (
        F.when(court == "Sayıştay", "sayistay").when(court == "Uyuşmazlık", "uyusmazlik").when(court == "AYM", constitutional).when(court == "AİHM", "aihm")
        .when(level == 1, "karar").when(level == 2, "istinaf_incelemesi").when(level == 3, "temyiz_incelemesi").otherwise("unknown")
    )


def decision_authority(court: Column, chamber: Column) -> Column:
    name = ascii_fold(F.coalesce(chamber, F.lit("")))
    supreme = court.isin("Yargıtay", "Danıştay")
    return (
        F.when(court == "AYM", "aym").when(court == "Uyuşmazlık", "uyusmazlik").when(court == "AİHM", "aihm")
        .when(supreme & name.rlike("birlestirme|\\bibk\\b"), "ibk").when(supreme & name.rlike("genel kurul|dava daireleri kurulu|\\b(hgk|cgk|iddk|vddk)\\b"), "genel_kurul_karari")
        .when(supreme & name.contains("daire"), "daire_karari").otherwise("unknown")
    )


def standing_score(score: Column, standing: Column, authority: Column) -> Column:
    """A score lowered for overruled and disputed decisions, never for unification decisions."""
    factor = F.lit(1.0)
    for name, x in PENALTIES.items():
        factor = F.when(standing == name, x).otherwise(factor)
    return score * F.when(authority == "ibk", 1.0).otherwise(factor)
