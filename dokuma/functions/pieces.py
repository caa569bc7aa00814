"""Batches of texts in pieces, so that a task's memory follows the texts it works on, not the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Characters of a piece, counting 200 for a row beside its texts.
PIECE, ROW = 1 << 19, 200


def pieces(frames: Iterator[pd.DataFrame], *texts: str, most: int = PIECE) -> Iterator[pd.DataFrame]:
    """The rows of all frames in order, in pieces of about ``most`` characters of the columns ``texts``; a longer text stands
    alone with what fits before it."""
    for pdf in frames:
        size = np.full(len(pdf), ROW, np.int64)
        for name in texts:
            size += np.fromiter((len(t) if isinstance(t, str) else 0 for t in pdf[name]), np.int64, len(pdf))
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)]):
            if lo < hi:
                yield pdf.iloc[lo:hi]
