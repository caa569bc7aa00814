"""Court citations in running text: headers that name a court, and the case and decision numbers behind them.

Both searches claim spans in order of priority, which no column expression can say, so they run over Arrow batches of
documents with compiled patterns; a document's work is bounded by its own length. A null or empty text gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.functions.pieces import pieces

#: Characters behind a header in which its numbers are looked for, on each side of a snippet, and kept behind a number.
WINDOW, AROUND, TAIL = 300, 120, 40

# The pieces of court names, the headers in order of priority with the name each gives, the ways of
# writing case and decision numbers in order of priority, and the form of dated unification decisions. ``bare`` is the
# name given when no chamber number was found.
SUFFIX = r"(?:['’]?[A-Za-zçğıöşüÇĞİÖŞÜ]+)?"
CITY = r"(?P<city>[A-ZÇĞİÖŞÜ][A-Za-zçğıöşüÇĞİÖŞÜ]+)"
CHAMBER = rf"(?:(?P<kind>Hukuk|Ceza)\s+Dairesi{SUFFIX}|(?P<short>H\.?D\.?|C\.?D\.?))"
ORDINALS = {"Birinci": 1, "İkinci": 2, "Üçüncü": 3, "Dördüncü": 4, "Beşinci": 5, "Altıncı": 6, "Yedinci": 7, "Sekizinci": 8, "Dokuzuncu": 9, "Onuncu": 10, "On Birinci": 11, "On İkinci": 12, "On Üçüncü": 13}
FIRST_INSTANCE = r"Asliye\s+Ticaret|Asliye\s+Hukuk|Asliye\s+Ceza|Sulh\s+Hukuk|Sulh\s+Ceza|Ağır\s+Ceza|İş|İcra\s+Hukuk|İdare|Vergi|Tüketici|Aile|Kadastro|Fikr[iî]\s+ve\s+Sın[aâî]+\s+Haklar\s+Hukuk"
HEADERS = (
    # (pattern, name, bare)
    (rf"(?:Yargıtay\s+)?Hukuk\s+Genel\s+Kurulu{SUFFIX}", "Yargıtay Hukuk Genel Kurulu", None),
    (rf"(?:Yargıtay\s+)?Ceza\s+Genel\s+Kurulu{SUFFIX}", "Yargıtay Ceza Genel Kurulu", None),
    (rf"(?:Yargıtay\s+)?Hukuk\s+Daireleri\s+Başkanlar\s+Kurulu{SUFFIX}", "Yargıtay Hukuk Daireleri Başkanlar Kurulu", None),
    (rf"(?:Yargıtay\s+)?Ceza\s+Daireleri\s+Başkanlar\s+Kurulu{SUFFIX}", "Yargıtay Ceza Daireleri Başkanlar Kurulu", None),
    (rf"(?:Yargıtay\s+)?İçtihadı\s+Birleştirme\s+Büyük\s+Genel\s+Kurulu{SUFFIX}", "Yargıtay YIBBGK", None),
    (rf"(?:Yargıtay\s+)?İçtihadı\s+Birleştirme\s+Hukuk\s+Genel\s+Kurulu{SUFFIX}", "Yargıtay IBHGK", None),
    (rf"(?:Yargıtay|Y\.)\s*(?P<n>\d{{1,2}})\s*\.\s*{CHAMBER}", "Yargıtay {n}. {kind} Dairesi", None),
    (rf"Danıştay{SUFFIX}\s+(?:İdari?\s+Dava\s+Daireleri\s+Kurulu|İDDK|İDDGK)", "Danıştay İdare Dava Daireleri Kurulu", None),
    (rf"Danıştay{SUFFIX}\s+(?:Vergi\s+Dava\s+Daireleri\s+Kurulu|VDDK)", "Danıştay Vergi Dava Daireleri Kurulu", None),
    (rf"Vergi\s+Dava\s+Daireleri\s+Kurulu{SUFFIX}", "Danıştay Vergi Dava Daireleri Kurulu", None),
    (rf"Danıştay{SUFFIX}\s+İçtihadları?\s+Birleştirme(?:\s+Kurulu)?", "Danıştay IBK", None),
    (rf"Danıştay{SUFFIX}\s+(?P<n>\d{{1,2}})\s*\.\s*Daire(?:si|\s+Başkanlığı)?{SUFFIX}", "Danıştay {n}. Daire", None),
    (rf"Danıştay{SUFFIX}\s+(?P<ordinal>On\s+Üçüncü|On\s+İkinci|On\s+Birinci|Onuncu|Dokuzuncu|Sekizinci|Yedinci|Altıncı|Beşinci|Dördüncü|Üçüncü|İkinci|Birinci)\s*Daire(?:si(?:nin|nce)?)?{SUFFIX}", "Danıştay {n}. Daire", None),
    (rf"Anayasa\s+Mahkemesi{SUFFIX}", "Anayasa Mahkemesi", None),
    (rf"Sayıştay{SUFFIX}\s+(?P<n>\d{{1,2}})\s*\.\s*Daire(?:si)?{SUFFIX}", "Sayıştay {n}. Dairesi", None),
    (rf"Uyuşmazlık\s+Mahkemesi{SUFFIX}(?:\s+(?P<n>Hukuk|Ceza|İdari|Idari)\s+Bölümü)?", "Uyuşmazlık Mahkemesi {n} Bölümü", "Uyuşmazlık Mahkemesi"),
    (rf"{CITY}\s+(?:Bölge\s+Adliye\s+Mahkemesi|BAM){SUFFIX}(?:\s+(?P<n>\d{{1,2}})\s*\.?\s*(?:(?P<kind>Hukuk|Ceza)\s+Dairesi{SUFFIX}|(?P<short>HD|CD|H\.D\.?|C\.D\.?)))?", "{city} Bölge Adliye Mahkemesi {n}. {kind} Dairesi", "{city} Bölge Adliye Mahkemesi"),
    (rf"{CITY}\s+(?:Bölge\s+İdare\s+Mahkemesi|BİM){SUFFIX}(?:\s+(?P<n>\d{{1,2}})\s*\.?\s*(?:(?P<division>Vergi\s+Dava\s+Dairesi|İdar[ei]\s+Dava\s+Dairesi)|(?P<letters>VDD|İDD)))?", "{city} BİM {n}. {letters}", "{city} Bölge İdare Mahkemesi"),
    (rf"{CITY}(?:\s+(?P<region>Anadolu|Batı|Doğu|Kuzey|Güney))?(?:\s*\([^)]{{1,40}}\))?\s+(?P<n>\d{{1,2}})\s*\.\s*(?P<court>{FIRST_INSTANCE})\s+Mahkemesi{SUFFIX}", "{city} {region} {n}. {court} Mahkemesi", None),
)
CASE, DECISION = (rf"(?<!\d)(?P<{x}y>\d{{4}})\s*[/\-]\s*(?P<{x}n>\d+)(?!\d)" for x in "ek")
CASE_AFTER, DECISION_AFTER = r"\s*(?:Esas|E(?:sas)?\.)", r"\s*(?:Karar|K(?:arar)?\.)"
CASE_BEFORE, DECISION_BEFORE = r"E(?:sas)?\s*[:\.]\s*", r"K(?:arar)?\s*[:\.]\s*"
NUMBERS = (
    (CASE + CASE_AFTER + r"[^\d]{0,40}" + DECISION + DECISION_AFTER, re.IGNORECASE),
    (CASE_BEFORE + CASE + r"[^\d]{0,40}" + DECISION_BEFORE + DECISION, re.IGNORECASE),
    (CASE + r"\s*[-–]\s*" + DECISION + r"\s*E\.?\s*K\.?", 0),
    (r"B\.?\s*No\.?\s*[:\.]?\s*" + CASE, re.IGNORECASE),
    (CASE + CASE_AFTER, re.IGNORECASE),
    (CASE_BEFORE + CASE, re.IGNORECASE),
    (DECISION + DECISION_AFTER, re.IGNORECASE),
    (DECISION_BEFORE + DECISION, re.IGNORECASE),
)
APPLICATION, APPLICATION_COURT = 3, "Anayasa Mahkemesi"
UNIFICATION = r"(\d{1,2})[.\-](\d{1,2})[.\-](\d{4})\s+tarih(?:\s+ve)?\s+(\d+)\s*/\s*(\d+)\s+[Ss]ayılı\s+(?:İçtiha[dt][ıi]|İnançları|İçtihatları)\s+Birleştirme"
UNIFICATION_BODY = "İçtihatları Birleştirme HGK"

HEADER_RULES = tuple((re.compile(p), name, bare) for p, name, bare in HEADERS)
NUMBER_RULES = tuple(re.compile(p, flags) for p, flags in NUMBERS)
DATED = re.compile(UNIFICATION)
CITATION = "doc_id string, citation_index int, raw_text string, daire string, esas_no string, karar_no string, snippet string"


class Claims:
    """Disjoint spans, kept in order; a span that touches a claimed one is refused."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def court_name(m: re.Match, name: str, bare: str | None) -> str:
    """The stored name of a header: the template's fields from the match, abbreviations written out."""
    g = {k: v or "" for k, v in m.groupdict().items()}
    if g.get("short"):
        g["kind"] = "Hukuk" if g["short"][0] == "H" else "Ceza"
    if g.get("division"):
        g["letters"] = "VDD" if g["division"].startswith("Vergi") else "İDD"
    if g.get("ordinal"):
        g["n"] = str(ORDINALS[" ".join(g["ordinal"].split())])
    return " ".join((bare if bare and not g.get("n") else name).format(**g).split())


def headers(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) in order of place; an earlier rule keeps its span against later ones."""
    claims, found = Claims(), []
    for pattern, name, bare in HEADER_RULES:
        for m in pattern.finditer(text):
            if claims.free(*m.span()):
                claims.add(*m.span())
                found.append((*m.span(), court_name(m, name, bare)))
    return sorted(found)


def numbers(window: str, applications: bool) -> Iterator[tuple[str | None, str | None, int]]:
    """(case number, decision number, place), pairs first, then single numbers; applications only where asked for."""
    claims = Claims()
    for i, pattern in enumerate(NUMBER_RULES):
        if i == APPLICATION and not applications:
            continue
        for m in pattern.finditer(window):
            if not claims.free(*m.span()):
                continue
            claims.add(*m.span())
            g = m.groupdict()
            yield (*(f"{g[x + 'y']}/{g[x + 'n']}" if x + "y" in g else None for x in "ek"), m.start())


def citations(text: str) -> Iterator[tuple[str, str, str | None, str | None, str]]:
    """(raw, court, case number, decision number, snippet); of equal (court, numbers) the first stays. Dated unification
    decisions come first and need no header; a header's window ends at the next header."""
    seen = set()

    def new(*key) -> bool:
        fresh = key not in seen
        seen.add(key)
        return fresh

    around = lambda at: text[max(0, at - AROUND) : at + AROUND].strip()
    for m in DATED.finditer(text):
        _, _, year, case, decision = m.groups()
        if new(UNIFICATION_BODY, f"{year}/{case}", f"{year}/{decision}"):
            yield m.group(0).strip(), UNIFICATION_BODY, f"{year}/{case}", f"{year}/{decision}", around(m.start())
    found = headers(text)
    for (start, end, court), after in zip(found, [*[h[0] for h in found[1:]], len(text)]):
        for case, decision, at in numbers(text[end : min(end + WINDOW, after)], court == APPLICATION_COURT):
            if new(court, case, decision):
                yield text[start : end + at + TAIL].strip(), court, case, decision, around(start)


def extract_citations(docs: DataFrame) -> DataFrame:
    """One row a citation of (doc_id, text), numbered in the order found."""
    names = [c.split()[0] for c in CITATION.split(", ")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text"):
            rows = [(d, i, *c) for d, t in zip(pdf.doc_id, pdf.text) if t for i, c in enumerate(citations(t))]
            yield pd.DataFrame(rows, columns=names).astype({"citation_index": "int32"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(work, CITATION)
