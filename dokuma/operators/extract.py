"""Text to rows: sentence-greedy chunks, fixed token windows, law references, citations.

The extractors consume spans in order of priority within one document, which no column expression can say; they run over
batches of documents with compiled patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.functions.courts import LAWS
from dokuma.functions.pieces import pieces

CHUNK = "doc_id string, chunk_index int, text string, token_count int"
LAW = "doc_id string, law_code string, law_no int, article int, paragraph int, subparagraph string, raw_text string, snippet string"

#: Fixed patterns: how an article is written, and how laws are named before it.
ABBREVIATIONS = "TKHK|İYUK|HUMK|CMUK|İİK|TTK|TBK|TMK|HMK|CMK|TCK|KMK|VUK|AİHS|İK|MK|BK|AY"
ARTICLE = r"m\.?\s*(?P<article>\d{1,4})(?:[/]\s*(?P<slash>\d{1,3})|,\s*[fF]\.?\s*(?P<fikra>\d{1,3}))?(?:\s*[-–]\s*(?P<sub>[a-z]))?"
ORDINAL = r"(?P<article>\d{1,4})\s*['.]\s*maddes"
LAW_PATTERNS = (
    (rf"\b(?P<code>{ABBREVIATIONS})\s+{ARTICLE}", re.UNICODE),
    (rf"\b(?P<code>{ABBREVIATIONS})['‘’ʼ]?\w*\s+{ORDINAL}", re.UNICODE | re.IGNORECASE),
    (rf"(?P<no>\d{{3,5}})\s+(?:sayılı|s\.)\s+[^\n;]{{0,80}}?{ARTICLE}", re.UNICODE | re.IGNORECASE),
    (rf"(?P<no>\d{{3,5}})\s+(?:sayılı|s\.)\s+[^\n;]{{0,80}}?{ORDINAL}", re.UNICODE | re.IGNORECASE),
    (r"(?P<ay>Anayasa)['‘’ʼ]?\w*\s+m\.?\s*(?P<article>\d{1,3})", re.UNICODE | re.IGNORECASE),
    (r"(?P<ay>Anayasa)['‘’ʼ]?\w*\s+(?P<article>\d{1,3})\s*['.]\s*maddes", re.UNICODE | re.IGNORECASE),
)
BY_NUMBER = {number: code for code, (_, number, _) in LAWS.items() if number}


def law_references(text: str, width: int = 80) -> Iterator[tuple]:
    """(code, number, article, paragraph, subparagraph, raw, snippet); of equal (code, article) the first in pattern
    order stays."""
    seen = set()
    for pattern, flags in LAW_PATTERNS:
        for m in re.finditer(pattern, text, flags):
            g = m.groupdict()
            if g.get("no"):
                number = int(g["no"])
                code = BY_NUMBER.get(number, f"KANUN_{number}")
            elif g.get("ay"):
                code, number = "AY", LAWS["AY"][1]
            else:
                code = g["code"].upper()
                number = LAWS.get(code, (None, None))[1]
            article = int(g["article"])
            if (code, article) in seen:
                continue
            seen.add((code, article))
            paragraph = g.get("slash") or g.get("fikra")
            around = text[max(0, m.start() - width) : m.start() + width].strip()
            yield code, number, article, int(paragraph) if paragraph else None, g.get("sub"), m.group(0)[:200], around


def extract_laws(docs: DataFrame) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text"):
            rows = [(r.doc_id, *x) for r in pdf.itertuples() if r.text for x in law_references(r.text)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in LAW.split(", ")])
            yield out.astype({"law_no": "Int32", "article": "int32", "paragraph": "Int32"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(work, LAW)


SENTENCE_END, PARAGRAPH = re.compile(r"(?<=[.!?…])\s+"), re.compile(r"\n{2,}")


def count_words(text: str) -> int:
    return len(text.split())


def chunks_of(text: str, most: int = 1024, overlap: int = 128, tokens: Callable[[str], int] = count_words) -> list[tuple[str, int]]:
    """Chunks of whole sentences: a sentence is never split; a paragraph's end closes a chunk that is three quarters
    full; the next chunk begins with the sentences at the end of the last one that fit ``overlap``; a sentence longer
    than ``most`` stands alone. Where overlap and sentence do not fit together, the overlap is dropped, not the sentence."""
    out: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    size = 0  # tokens in held
    fresh = 0  # sentences in held that are not overlap

    def close() -> None:
        nonlocal held, size, fresh
        if fresh:
            whole = " ".join(s for s, _ in held)
            out.append((whole, tokens(whole)))
        tail, n = [], 0
        for s, c in reversed(held):
            if n + c > overlap:
                break
            tail.append((s, c))
            n += c
        held, size, fresh = tail[::-1], n, 0

    for paragraph in PARAGRAPH.split(text or ""):
        for sentence in filter(None, (s.strip() for s in SENTENCE_END.split(paragraph.strip()))):
            n = tokens(sentence)
            if fresh and size + n > most:
                close()
            if not fresh and size + n > most:
                held, size = [], 0
            held.append((sentence, n))
            size += n
            fresh += 1
            if n > most:
                close()
                held, size = [], 0
        if fresh and size >= 0.75 * most:
            close()
    if fresh:
        close()
    return out


def chunk(docs: DataFrame, most: int = 1024, overlap: int = 128, tokens: Callable[[str], int] = count_words) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text"):
            rows = [(r.doc_id, i, t, n) for r in pdf.itertuples() for i, (t, n) in enumerate(chunks_of(r.text, most, overlap, tokens))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text", "token_count"]).astype({"chunk_index": "int32", "token_count": "int32"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(work, CHUNK)


def token_windows(docs: DataFrame, most: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_index, text, token_count) of windows over blank-separated tokens, every most - overlap; the last
    window is the first that reaches the end."""
    step = most - overlap
    words = F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")
    n = F.size("w")
    last = F.greatest(F.ceil((n - most) / step), F.lit(0)).cast("int")
    rows = docs.select("doc_id", words.alias("w")).where(n > 0).select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    piece = F.slice("w", F.col("chunk_index") * step + 1, most)
    return rows.select("doc_id", "chunk_index", F.array_join(piece, " ").alias("text"), F.size(piece).alias("token_count"))


# Folded beginnings of heading lines and the section they open.
SECTIONS = (
    ("karsi_oy", ("karsi oy", "muhalefet serhi")),
    ("istem_ozeti", ("istemin ozeti",)),
    ("tetkik_hakimi", ("danistay tetkik hakimi", "tetkik hakimi")),
    ("alt_derece_karari", ("ilk derece", "bam karari", "bolge adliye mahkemesi karari")),
    ("taraflar", ("taraflar", "basvurucu", "davaci", "davali")),
    ("iddia", ("iddia", "davaci istemi", "dava dilekcesi")),
    ("savunma", ("savunma", "davali cevabi", "davalinin cevabi")),
    ("gerekce", ("gerekce", "degerlendirme", "hukuki degerlendirme")),
    ("hukum", ("hukum", "sonuc")),
)
#: A heading is a line of at most so many characters.
HEADING = 60
SECTION = "doc_id string, chunk_index int, section_type string, text string, token_count int"
FOLD = str.maketrans("İIÇĞÖŞÜçğıöşüâîû", "iicgosucgiosuaiu")


def section_of(line: str) -> str | None:
    """The section that a line opens: it begins with a heading's words and is in capitals, or has nothing but a colon,
    full stop or dash behind them."""
    line = line.strip()
    plain = re.sub(r"^[^a-z]+", "", line.translate(FOLD).lower())
    if not plain or len(line) > HEADING:
        return None
    fits = lambda w: plain.startswith(w) and (line.isupper() or re.match(r"\s*(?:[:.\-–]|$)", plain[len(w) :]))
    return next((name for name, words in SECTIONS if any(fits(w) for w in words)), None)


def sections_of(text: str, most: int = 1024, tokens: Callable[[str], int] = count_words) -> Iterator[tuple[str, str, int]]:
    """(section, text, tokens): chunks end where a heading opens another section; a longer section is cut between
    paragraphs, a longer paragraph between sentences, a longer sentence not at all. Before the first heading: giris."""
    name, held = "giris", []
    parts: list[tuple[str, list[str]]] = []
    for line in (text or "").split("\n"):
        if (other := section_of(line)) is not None:
            parts.append((name, held))
            name, held = other, []
        held.append(line)
    for name, lines in [*parts, (name, held)]:
        pieces = []
        for paragraph in PARAGRAPH.split("\n".join(lines)):
            paragraph = paragraph.strip()
            pieces += [("\n\n", paragraph)] if tokens(paragraph) <= most else [(" ", s) for s in SENTENCE_END.split(paragraph)]
        now, n = "", 0
        for joint, piece in pieces:
            size = tokens(piece)
            if now and n + size > most:
                yield name, now, tokens(now)
                now, n = "", 0
            if piece:
                now, n = (now + joint + piece if now else piece), n + size
        if now:
            yield name, now, tokens(now)


def chunk_sections(docs: DataFrame, most: int = 1024, tokens: Callable[[str], int] = count_words) -> DataFrame:
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text"):
            rows = [(d, i, *c) for d, t in zip(pdf.doc_id, pdf.text) for i, c in enumerate(sections_of(t, most, tokens))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SECTION.split(", ")]).astype({"chunk_index": "int32", "token_count": "int32"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(work, SECTION)
