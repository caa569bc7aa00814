"""Metadata of decisions from four layers: first line, printed header, old header, file name; the first that knows wins.

Each layer is a table of patterns. They run over Arrow batches, as upper case and titles follow Unicode rules that column
functions do not share; only the first forty lines of a document are looked at, as the rules ask. Branch and level are
columns. A null or blank text is excluded as an empty file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dokuma.functions import courts, text
from dokuma.functions.pieces import pieces

HEADER_LINES, OLD_MARK_WITHIN = 40, 500

# Abbreviations in names, and the patterns of each layer in order, with court and chamber.
FULL = {
    "HD": "Hukuk Dairesi", "CD": "Ceza Dairesi", "hd": "Hukuk Dairesi", "cd": "Ceza Dairesi", "HGK": "Hukuk Genel Kurulu", "CGK": "Ceza Genel Kurulu",
    "YİBBGK": "İçtihatları Birleştirme BGK", "İDDK": "İdari Dava Daireleri Kurulu", "VDDK": "Vergi Dava Daireleri Kurulu",
    "HUKUK DAİRESİ": "Hukuk Dairesi", "CEZA DAİRESİ": "Ceza Dairesi",
}
FIRST_LINE = (
    (r"^Yargıtay\s+(\d+)\.\s+(HD|CD)\.", "Yargıtay", "{0}. {1}"),
    (r"^Yargıtay\s+\d+\.\s+(HGK|CGK)\.", "Yargıtay", "{0}"),
    (r"^Yargıtay\s+(HGK|CGK|YİBBGK)\.", "Yargıtay", "{0}"),
    (r"^Danıştay\s+(\d+)\.\s+D\.", "Danıştay", "{0}. Daire"),
    (r"^Danıştay\s+IBK\.", "Danıştay", "İçtihatları Birleştirme Kurulu"),
    (r"^Danıştay\s+(İDDK|VDDK)\.", "Danıştay", "{0}"),
    (r"Anayasa Mahkemesi", "AYM", "Anayasa Mahkemesi"),
    (r"^(\w+)\s+(\d+)\.\s+(İdare Mahkemesi|İş Mahkemesi|Asliye Ticaret Mahkemesi)", "İlk Derece", "{0} {1}. {2}"),
    (r"(\w+)\s+(\d+)\.\s+(Fikr[iî]\s+[Vv]e\s+Sın(?:ai|aî)\s+Haklar\s+Ceza\s+Mahkemesi)", "İlk Derece", "{0} {1}. {2}"),
    (r"Danıştay\s+(\d+)\.\s+Daire\s+Başkanlığı", "Danıştay", "{0}. Daire"),
    (r"^Yargıtay\s+(\d+)\.\s+(HD|CD)\s+E:", "Yargıtay", "{0}. {1}"),
    (r"^Yargıtay\s+(\d+)\.\s+(Hukuk Dairesi|Ceza Dairesi)", "Yargıtay", "{0}. {1}"),
    (r"^(\w+)\s+BAM,?\s+(\d+)\.\s+(CD|HD)\.", "BAM", "{0} BAM {1}. {2}"),
    (r"^(\w+)\s+BİM,?\s+(\d+)\.\s+VDD", "BİM", "{0} BİM {1}. Vergi Dava Dairesi"),
)
PRINTED_TOP = (
    (r"T\.C\.\s+Danıştay\s+Başkanlığı\s*-\s*(.+)", "Danıştay", "{0}"),
    (r"T\.C\.\s+Yargıtay\s+Başkanlığı\s*-\s*(.+)", "Yargıtay", "{0}"),
    (r"(\S+(?:\s+\S+)?)\s+BAM\s*-\s*(.+)", "BAM", "{0} BAM {1}"),
)
PRINTED_REGIONAL = ((r"(\S+)\s+BİM\s*-\s*(.+)", "BİM", "{0} BİM {1}"),)
PRINTED_CONSTITUTIONAL = (r"Anayasa Mahkemesi|ANAYASA MAHKEMESĠ", r"Anayasa Mahkemesi\s*-\s*(.+)", r"Ba[ĢşŞ]vuru\s+Numarası:\s*(\d{4}/\d+)")
PRINTED_REST = (
    (r"YARGITAY\s+(\d+)\.\s+(HUKUK DAİRESİ|CEZA DAİRESİ)", "Yargıtay", "{0}. {1}"),
    (
        r"(\w+(?:\s+\w+)?)\s+(\d+)\.\s+(İdare Mahkemesi|Asliye Ticaret Mahkemesi|Asliye Hukuk Mahkemesi|Aile Mahkemesi|İcra Hukuk Mahkemesi|Tüketici Mahkemesi|"
        r"Fikr[iî]\s+[Vv]e\s+Sın(?:ai|aî)\s+Haklar\s+Ceza\s+Mahkemesi|Ağır Ceza Mahkemesi|Asliye Ceza Mahkemesi|İş Mahkemesi|ACM)",
        "İlk Derece",
        "{0} {1}. {2}",
    ),
)
#: (court, its letters, city before the name, chamber of the printed header, chamber of the old header), on upper case.
APPEAL = ("BAM", r"(\w+(?:\s+\w+)?)\s+BÖLGE\s+ADLİYE\s+MAHKEMESİ", r"(\d+)\.\s+(HUKUK|CEZA)\s+DAİRESİ", r"(\d+)\.\s+(HUKUK|CEZA)\s+DAİRESİ")
ADMINISTRATIVE = ("BİM", r"(\w+(?:\s+\w+)?)\s+BÖLGE\s+İDARE\s+MAHKEMESİ", r"(\d+)\.\s+(VERG[İI]\s+DAVA\s+DAİRESİ|DAİRE)", r"(\d+)\.\s+(VERG[İI]\s+DAVA\s+DAİRESİ|İDARE\s+DAVA\s+DAİRESİ|DAİRE)")
CHAMBERS = {"HUKUK": "Hukuk Dairesi", "CEZA": "Ceza Dairesi"}
OLD_BOARD = ((r"Hukuk Genel Kurulu", "Yargıtay", "Hukuk Genel Kurulu"),)
OLD = (
    (r"(\d+)\.\s+(Hukuk Dairesi|Ceza Dairesi|HUKUK DAİRESİ|CEZA DAİRESİ)", "Yargıtay", "{0}. {1}"),
    (r"Danıştay\s+(\d+)\.\s+Daire\s+Başkanlığı", "Danıştay", "{0}. Daire"),
)
OLD_MARKS = ("İçtihat Metni", "MAHKEMESİ")
SLUG_TAIL = r"(\d+)-(\d+)-k-(\d+)-(\d+)-t-(\d+)-(\d+)-(\d+)"
SLUGS = (
    (r"(\d+)-hukuk-dairesi-e-", "Yargıtay", "{0}. Hukuk Dairesi"),
    (r"(\d+)-ceza-dairesi-e-", "Yargıtay", "{0}. Ceza Dairesi"),
    (r"hukuk-genel-kurulu-e-", "Yargıtay", "Hukuk Genel Kurulu"),
    (r"ictihatlari-birlestirme-hgk-e-", "Yargıtay", "İçtihatları Birleştirme HGK"),
    (r"(\d+)-d-e-", "Danıştay", "{0}. Daire"),
    (r"vddk-e-", "Danıştay", "Vergi Dava Daireleri Kurulu"),
    (r"iddk-e-", "Danıştay", "İdari Dava Daireleri Kurulu"),
    (r"ibk-e-", "Danıştay", "İçtihatları Birleştirme Kurulu"),
    (r"(\w+)-bam(\d+)-(cd|hd)-e-", "BAM", "{0} BAM {1}. {2}"),
    (r"(\w+)-bim(\d+)-vdd-e-", "BİM", "{0} BİM {1}. Vergi Dava Dairesi"),
    (r"(\w+)-(\d+)-idare-mahkemesi-e-", "İlk Derece", "{0} {1}. İdare Mahkemesi"),
    (r"\w+-\d+-[\w-]+-mahkemesi-e-", "İlk Derece", ""),
    (r"\w+-(?:\d+\w*|[\w]+-[\w]+)-e-", "İlk Derece", ""),
    (r"istanbul-anadolu-\d+-[\w-]+-e-", "İlk Derece", ""),
)
DATE = r"T\.\s+(\d{1,2}\.\d{1,2}\.\d{4})"
#: Per layer: field -> patterns, the first that is found counts.
FIRST_NUMBERS = {"esas_no": (r"E[.:]\s*(\d{4}/\d+)", r"(\d{4}/\d+)\s+Esas", r"B\.\s+(\d{4}/\d+)"), "karar_no": (r"K[.:]\s*(\d{4}/\d+)", r"(\d{4}/\d+)\s+Karar"), "decision_date": (DATE,)}
PRINTED_NUMBERS = {"esas_no": (r"Esas\s+No\.?:\s*(\d{4}/\d+)",), "karar_no": (r"Karar\s+No\.?:\s*(\d{4}/\d+)",), "decision_date": (r"Karar\s+tarihi:\s*(\d{2}\.\d{2}\.\d{4})",)}
PRINTED_LOOSE = {"esas_no": (r"E\.\s+(\d{4}/\d+)",), "karar_no": (r"K\.\s+(\d{4}/\d+)",)}
OLD_NUMBERS = {
    "esas_no": (r"(\d{4}[/_:]\d+)\s*E\b", r"E[.:]\s*(\d{4}[/_]\d+)", r"(?i:Esas\s+no\s*:\s*(\d{4}/\d+))"),
    "karar_no": (r"(\d{4}[/_:]\d+)\s*K\b", r"K[.:]\s*(\d{4}[/_]\d+)", r"(?i:Karar\s+no\s*:\s*(\d{4}/\d+))"),
    "decision_date": (r"TARİHİ\s*:\s*(\d{1,2}[./]\d{1,2}[./]\d{4})", DATE),
}

#: Words without which a court's patterns, which begin with any word, need not be tried.
NEEDED = {"BAM": ("BAM",), "BİM": ("BİM",), "İlk Derece": ("Mahkemesi", "ACM")}

FIELDS = ("court", "daire", "esas_no", "karar_no", "decision_date")
PARSED = "doc_id string, filename string, court string, daire string, esas_no string, karar_no string, decision_date string, topic_keywords array<string>, excluded boolean, exclude_reason string"


def padded(date: str) -> str:
    day, month, year = re.split(r"[./]", date)
    return f"{day:0>2}.{month:0>2}.{year}"


def named(rules: tuple, line: str) -> dict:
    """Court and chamber by the first rule found; abbreviations are written out."""
    for pattern, court, chamber in rules:
        if not any(w in line for w in NEEDED.get(court, ("",))):
            continue
        if m := re.search(pattern, line):
            return {"court": court, "daire": chamber.format(*(FULL.get(g.strip(), g.strip()) for g in m.groups()))}
    return {}


def regional(rule: tuple, header: str, old: bool) -> dict:
    court, city, *chamber = rule
    upper = header.upper()
    if "BÖLGE" not in upper or not (m := re.search(city, upper)):
        return {}
    c = re.search(chamber[old], upper)
    tail = f" {c[1]}. {CHAMBERS.get(c[2], c[2].strip().title())}" if c else ""
    return {"court": court, "daire": f"{m[1].strip().title()} {court}{tail}"}


def numbered(patterns: dict, header: str) -> dict:
    out = {}
    for field, options in patterns.items():
        hit = next((m[1] for p in options if (m := re.search(p, header))), None)
        if hit:
            out[field] = padded(hit) if field == "decision_date" else re.sub("[_:]", "/", hit)
    return out


def bullets(header: str) -> list[str]:
    """The first run of phrases of words set apart by bullets with white space on both sides."""
    run: list[str] = []
    wordy = lambda s: re.fullmatch(r"[\w\s]*", s) is not None
    pieces = header.split("•")
    for left, right in zip(pieces, pieces[1:]):
        if not run:
            cut = len(left)
            while cut and wordy(left[cut - 1]):
                cut -= 1
            if len(left) - cut < 2 or not left[-1].isspace():
                continue
            run = [left[cut:]]
        end = 0
        while end < len(right) and wordy(right[end]):
            end += 1
        if end < 2 or not right[0].isspace():
            if len(run) > 1:
                break
            run = []
            continue
        run.append(right[:end])
        if end < len(right) or len(right) < 3 or not right[-1].isspace():
            break
    return [w for w in (r.strip() for r in run) if w] if len(run) > 1 else []


def printed(header: str) -> dict:
    out = numbered(PRINTED_NUMBERS, header)
    court = named(PRINTED_TOP, header) or regional(APPEAL, header, False) or named(PRINTED_REGIONAL, header) or regional(ADMINISTRATIVE, header, False)
    body, division, application = PRINTED_CONSTITUTIONAL
    if not court and re.search(body, header):
        m = re.search(division, header)
        court = {"court": "AYM", "daire": m[1].strip() if m else "Anayasa Mahkemesi"}
        out = numbered({"esas_no": (application,)}, header) | out
    if not court:
        court = named(PRINTED_REST, header)
        out = numbered(PRINTED_LOOSE, header) | out
    return court | out


def old(header: str) -> dict:
    if OLD_MARKS[0] not in header and OLD_MARKS[1] not in header[:OLD_MARK_WITHIN]:
        return {}
    court = named(OLD_BOARD, header) or regional(APPEAL, header, True) or regional(ADMINISTRATIVE, header, True) or named(OLD, header)
    return court | numbered(OLD_NUMBERS, header)


def from_slug(stem: str) -> dict:
    for prefix, court, chamber in SLUGS:
        if m := re.match(prefix + SLUG_TAIL, stem):
            *name, ey, en, ky, kn, day, month, year = m.groups()
            name = [FULL.get(g, g.capitalize()) for g in name]
            return {"court": court, "daire": chamber.format(*name), "esas_no": f"{ey}/{en}", "karar_no": f"{ky}/{kn}", "decision_date": padded(f"{day}.{month}.{year}")}
    return {}


def merged(stem: str, header: str) -> dict:
    layers = (numbered(FIRST_NUMBERS, line := header.split("\n")[0].strip()) | named(FIRST_LINE, line), printed(header), old(header), from_slug(stem))
    out = {f: next((layer[f] for layer in layers if layer.get(f)), "") for f in FIELDS}
    out["decision_date"] = out["decision_date"] or numbered({"decision_date": (DATE,)}, stem.replace("_", "/")).get("decision_date", "")
    return out | {"topic_keywords": bullets(header)}


def parse(docs: DataFrame, excluded: dict[str, str] | None = None) -> DataFrame:
    """The manifest row of each (filename, text)."""
    names = [c.split()[0] for c in PARSED.split(", ")]
    nothing = dict.fromkeys(FIELDS, "") | {"topic_keywords": []}

    def row(filename: str, header: str) -> dict:
        stem = filename.removesuffix(".md")
        why = (excluded or {}).get(stem) or ("" if header.strip() else "empty file")
        return {"doc_id": stem, "filename": filename, "excluded": bool(why), "exclude_reason": why} | (nothing if why else merged(stem, header))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "filename", "header"):
            yield pd.DataFrame([row(f or "", h or "") for f, h in zip(pdf.filename, pdf.header)], columns=names)

    rows = docs.select("filename", text.header(F.col("text"), HEADER_LINES).alias("header")).mapInPandas(work, PARSED)
    known = F.col("court") != ""
    branch, level = courts.law_branch(F.col("court"), F.col("daire")), courts.court_level(F.col("court"))
    return rows.select("doc_id", "filename", "court", "daire", F.when(known, branch).otherwise("").alias("law_branch"), F.when(known, level).otherwise(0).alias("court_level"), *names[4:])


# Old file names, and the slugs they get.
CHAMBER_SLUG = {"hd": "hukuk-dairesi", "cd": "ceza-dairesi"}
OLD_NAMES = (
    (r"(?i)^(\d+)\.\s+(Hukuk Dairesi|Ceza Dairesi)\s+(\d{4})[/_](\d+)\s*E\.?\s*[,.]?\s*(\d{4})[/_](\d+)\s*K", "$1-$2-e-$3-$4-k-$5-$6-1"),
    (r"^Hukuk Genel Kurulu\s+(\d{4})[/_](\d+)\s*E\.?\s*[,.]?\s*(\d{4})[/_](\d+)\s*K", "hukuk-genel-kurulu-e-$1-$2-k-$3-$4-1"),
    (r"^Hukuk Genel Kurulu\s+(\d{4})[/_](\d+)\s*E", "hukuk-genel-kurulu-e-$1-$2-1"),
    (r"(?iu)^Danıştay\s+(\d+)\.\s+Daire\s+Başkanlığı\s+(\d{4})[/_](\d+)\s*E\.?\s*[,.]?\s*(\d{4})[/_](\d+)\s*K", "danistay-$1-daire-e-$2-$3-k-$4-$5-1"),
    (r"(?iu)^T\.C\.\s+YARGITAY\s+(\d+)\.\s+(HUKUK DAİRESİ|CEZA DAİRESİ)\s+E\.?\s*(\d{4})[/_](\d+)\s+K\.?\s*(\d{4})[/_](\d+).*?T\.?\s+0?(\d{1,2})\.0?(\d{1,2})\.(\d{4})", "$1-$2-e-$3-$4-k-$5-$6-t-$7-$8-$9-1"),
    (r"(?iu)^T\.C\.\s+YARGITAY\s+(\d+)\.\s+(HUKUK DAİRESİ|CEZA DAİRESİ)\s+E\.?\s*(\d{4})[/_](\d+)\s+K\.?\s*(\d{4})[/_](\d+)", "$1-$2-e-$3-$4-k-$5-$6-1"),
    (r"(?iu)^Yargıtay\s+(\d+)\.\s+(Hukuk Dairesi|Ceza Dairesi|HD|CD)\s+(\d{4})[/_](\d+)\s*Esas\s+(\d{4})[/_](\d+)\s*Karar", "$1-$2-e-$3-$4-k-$5-$6-1"),
    (r"^Yargıtay\s+(\d+)\.\s+(HD|CD)\s+E[_:]\s*(\d{4})[/_](\d+)\s+K[_:]\s*(\d{4})[/_](\d+)", "$1-$2-e-$3-$4-k-$5-$6-1"),
    (r"^(\d{4})-(\d+)$", "aym-b-$1-$2-1"),
)


def slug(stem: Column) -> Column:
    """The slug of an old file name: by the first pattern it fits, else letters and digits joined by dashes."""
    out = stem
    for pattern, form in reversed(OLD_NAMES):
        out = F.when(stem.rlike(pattern), F.regexp_replace(stem, f"{pattern}.*$", form)).otherwise(out)
    out = text.slugify(out)
    for short, full in CHAMBER_SLUG.items():
        out = F.regexp_replace(out, f"^(\\d+)-{short}-e-", f"$1-{full}-e-")
    return out


def renamed(files: DataFrame) -> DataFrame:
    """(old, new) of the stems (stem) that are no slugs. Where a new name is taken, by a file that is a slug already or
    by an earlier stem, it gets -2, -3 and so on, in order of stems."""
    good = F.col("stem").rlike("^[a-z0-9][-a-z0-9]*$")
    bad = files.where(~good).select(F.col("stem").alias("old"), slug(F.col("stem")).alias("new"))
    taken = files.where(good).select(F.col("stem").alias("new"), F.lit(1).alias("there")).distinct()
    w = Window.partitionBy("new").orderBy("old")
    place = F.row_number().over(w) + F.coalesce("there", F.lit(0))
    return bad.join(taken, "new", "left").select("old", F.when(place > 1, F.concat("new", F.lit("-"), place.cast("string"))).otherwise(F.col("new")).alias("new"))
