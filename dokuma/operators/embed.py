"""Embedding of texts: which client a model needs, batches with retries, and an embedder that needs no network."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from dokuma.functions.vectors import cosine
from dokuma.operators import evaluate
from dokuma.operators.graph import saved
from dokuma.operators.retrieve import usable

#: Model -> (kind of client, dimensions).
MODELS = {
    "text-embedding-3-small": ("openai", 1536),
    "text-embedding-3-large": ("openai", 3072),
    "BAAI/bge-m3": ("compatible", 1024),
    "multilingual-e5-large": ("local", 1024),
    "bge-base-en-v1.5": ("local", 768),
    "gemini-embedding-2-preview": ("gemini", 3072),
}
WORD = re.compile(r"[^ \t\n\r\f\v]+")
Embedder = Callable[[list[str]], list[list[float]]]


class Busy(Exception):
    """An embedder's server is busy or away; the batch is worth another try."""


def client_for(model: str, keys: dict[str, str] | None = None) -> str:
    """The kind of client: openai, compatible (own address), local or gemini, which needs a key."""
    if model not in MODELS:
        raise ValueError(f"unknown embedding model {model}")
    kind = MODELS[model][0]
    if kind == "gemini" and not (keys or {}).get("gemini"):
        raise ValueError("this model needs a key")
    return kind


def extraction_backend(model: str, base_url: str = "", keys: dict[str, str] | None = None) -> str:
    """The back end of an extraction stage: an own address before a claude model with a key before gemini with one."""
    keys = keys or {}
    if base_url:
        return "compatible"
    if model.startswith("claude") and (keys.get("stage") or keys.get("anthropic")):
        return "anthropic"
    if keys.get("gemini"):
        return "gemini"
    raise RuntimeError("no back end: give a base_url, or a key for the model")


def hashing(dimensions: int = 64) -> Embedder:
    """Words to places and signs by their md5, counted and normalised: the same vectors on every machine. A text without
    words is a zero vector."""

    @lru_cache(1 << 16)
    def place(word: str) -> tuple[int, int]:
        h = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
        return int(h[:6], 16) % dimensions, 1 if int(h[6], 16) < 8 else -1

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0] * dimensions
            for w in WORD.findall(text.lower()):
                i, sign = place(w)
                v[i] += sign
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n if n else 0.0 for x in v])
        return out

    return embed


def patient(embedder: Embedder, texts: list[str], tries: int | None, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """The embedder's answer; a busy or unreachable one is asked again, a second, two, four ... a minute later."""
    n = 0
    while True:
        try:
            return embedder(texts)
        except (Busy, ConnectionError, TimeoutError):
            n += 1
            if tries is not None and n >= tries:
                raise
            sleep(min(60.0, 2.0 ** (n - 1)))


def embed(chunks: DataFrame, make: Callable[[], Embedder], *, batch: int = 100, prefix: str = "", tries: int | None = 8, text: str = "text") -> DataFrame:
    """The rows with ``embedding`` and ``status`` ("ok", or what went wrong, with a null embedding): batches of so many
    texts go to the embedder that ``make`` gives each task. A null text is empty. A batch that fails is tried text by
    text, so one bad text costs only itself."""
    columns = chunks.columns
    schema = chunks.select(*columns).schema.add("embedding", ArrayType(DoubleType())).add("status", StringType())

    def one(embedder: Embedder, texts: list[str]) -> list[tuple]:
        try:
            return [(list(map(float, v)), "ok") for v in patient(embedder, texts, tries)]
        except Exception as e:  # noqa: BLE001  an answer of its own for this text
            if len(texts) > 1 and not isinstance(e, (Busy, ConnectionError, TimeoutError)):
                return [x for t in texts for x in one(embedder, [t])]
            return [(None, f"{type(e).__name__}: {e}"[:200])] * len(texts)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make()
        for pdf in frames:
            texts = [prefix + ("" if pd.isna(t) else t) for t in pdf[text]]
            got = [x for i in range(0, len(texts), batch) for x in one(embedder, texts[i : i + batch])]
            yield pdf.assign(embedding=[v for v, _ in got], status=[s for _, s in got])

    return chunks.mapInPandas(work, schema)


def separation_of(pairs: DataFrame, make: Callable[[], Embedder], **options) -> DataFrame:
    """``evaluate.separation`` of pairs (a, b, related boolean) of texts, such as synonyms and words of other fields: each
    different text is embedded once. Pairs with a null, or with a text that cannot be embedded or has no direction, take no
    part."""
    both = pairs.where("a IS NOT NULL AND b IS NOT NULL AND related IS NOT NULL").select("a", "b", "related")
    texts = both.select(F.col("a").alias("text")).union(both.select("b")).distinct()
    held = saved(embed(texts, make, **options).where(usable("embedding")), "pair-vectors")
    side = lambda x: held.select(F.col("text").alias(x), F.col("embedding").alias(f"{x}_vector"))
    joined = both.join(side("a"), "a").join(side("b"), "b")
    return evaluate.separation(joined.select("related", cosine(F.col("a_vector"), F.col("b_vector")).alias("score")))
