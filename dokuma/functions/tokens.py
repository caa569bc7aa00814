"""Token counts by a byte-level vocabulary, whose file and pattern the caller names."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.functions.pieces import pieces


@lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str, pattern: str) -> Callable[[str], int]:
    """A text's number of tokens, as ``extract.chunk`` takes it. Each worker reads the file, which is there on every
    machine, once."""
    return lambda text: len(encoding(path, pattern).encode_ordinary(text))


def token_counts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null and empty ones have none."""
    count = counter(path, pattern)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text"):
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_tokens": [count(t) if t else 0 for t in pdf.text]})

    return docs.select("doc_id", "text").mapInPandas(work, docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).schema)
