"""Order-preserving packing of documents into fixed windows by dynamic programming.

Every partition is a stream of tokens: its documents one after the other, each ended by ``end_id``. Windows are cut from
the stream without reordering. A cut costs the padding of its window, plus a penalty by place: none at a document's
end, ``SENTENCE_CUT`` at a sentence's end, ``WORD_CUT`` inside a sentence (allowed every ``STRIDE`` tokens of sentences
longer than that, so that a long unpunctuated text does not force padding). With P the stream position of a candidate,

    best[i] = penalty[i] + window - P[i] + min over j, P[i] - P[j] <= window, of (best[j] + P[j])

whose minimum over a sliding range of j is kept in a monotone queue, so that a block of m candidates takes O(m) time.
A partition is handled in blocks of about ``BLOCK`` tokens; what follows the cheapest late cut of a block opens the next
one, so memory is bounded by a block plus one document, and only a partition's last window can stay short.

Null text counts as empty: the document is ``end_id`` alone. Empty tables give an empty result. Repeated rows are packed
as often as they appear. Extra input columns are ignored. A null doc_id is kept as null.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Ragged, places

WINDOW = 2048
SENTENCE_CUT, WORD_CUT, STRIDE = 4, 48, 32
BLOCK = 1 << 20
#: Letters whose lower case and canonical composition stand alone; punctuation that closes words, without apostrophes.
WORD = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+")
IS_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
IS_CLOSER = np.array([chr(b) in '.,!?;:$#%&*|()"-' for b in range(256)])
MARK = np.array(0xFFFFFFFF, "<u4")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordIds:
    """Pieces between blanks -> ids. The tokenizer drops white space and never joins what it separates, nor letters and
    the punctuation behind them, so a text's ids are those of its pieces. Unknown words of many documents are encoded in
    one call, in lower case, and told apart by their closing tokens. All is forgotten beyond twice ``most`` pieces,
    which bounds the memory."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.plain, self.most = Tokenizer.from_file(path), most
        self.plain.encode_special_tokens = True  # their strings in a text are ordinary text
        # Words in lower case need none of the normalising and splitting that a text does.
        from tokenizers import normalizers, pre_tokenizers

        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closing = np.zeros(self.plain.get_vocab_size(), bool)  # the tokens that end a word
        for token, i in self.plain.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> dict[str, int]:
        self.pieces: dict[str, int] = {"\n": 0}  # piece -> its place in ``ids``
        self.ids = Ragged("<u4")
        self.ids.add(MARK.reshape(1), np.ones(1, np.int64))
        return self.pieces

    def learn(self, new: set[str]) -> None:
        words, others, pieces = [], [], self.pieces
        for x in new:
            (words if WORD.fullmatch(x) else others).append(x)
        low = [x.lower() for x in words]
        fresh = [x for x in dict.fromkeys(low) if x not in pieces]
        for lo in range(0, len(fresh), 8192):
            part = fresh[lo : lo + 8192]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            assert len(ends) == len(part)
            pieces.update(zip(part, range(self.ids.count, self.ids.count + len(part))))
            self.ids.add(ids, np.diff(ends, prepend=0))
        pieces.update(zip(words, [pieces[x] for x in low]))
        for x in others:
            ids = np.array(self.plain.encode_batch_fast([x], add_special_tokens=False)[0].ids, "<u4")
            pieces[x] = self.ids.count
            self.ids.add(ids, np.array([len(ids)]))

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each piece's end). Every different piece is looked up once."""
        if self.ids.used > 16 * self.most:  # long pieces
            self.forget()
        told = pieces.dictionary_encode()
        at = places(self.pieces, told.dictionary.to_pylist(), self.learn, 2 * self.most, self.forget)  # may replace the tables
        return self.ids.take(at[told.indices.to_numpy()])


_LOADED: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, most: int = 500_000) -> WordIds:
    if (path, most) not in _LOADED:
        _LOADED[path, most] = WordIds(path, most)
    return _LOADED[path, most]


def lowered(text: str) -> str:
    """In lower case, as the tokenizer would have it, where every character has a lower case of its own (Latin-1)."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def tokenize(texts: list[str | None], words: WordIds, end_id: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each document's ids and the token offsets behind its sentences, the last one being its end. A sentence ends
    with a line, or where a blank follows a full stop, question or exclamation mark. Sentence ends travel through the
    look-up as a piece of their own with a mark for an id. Texts are handled together up to ``words.most`` pieces."""
    held, size = [], 0
    for x in texts:
        x = lowered(x or "").replace("\n", " \n ").replace(". ", ". \n ").replace("? ", "? \n ").replace("! ", "! \n ")
        n = x.count(" ") + 1
        if held and size + n > words.most:
            yield from _tokenized(held, words, end_id)
            held, size = [], 0
        held.append(x)
        size += n
    yield from _tokenized(held, words, end_id)


def pieces_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts one after the other, and how many there are up to each text's end. A piece is what lies
    between blanks; where that is letters and then punctuation, each of them is a piece."""
    raw = [t.encode() for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = flat != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    letter, closer = IS_LETTER[flat], IS_CLOSER[flat]
    high = np.flatnonzero(flat >= 128)
    if len(high):
        own, before = flat[high], flat[high - 1]  # a high byte at the very start has no lead; the last byte is a blank
        latin = (before == 0xC3) & (own != 0x97) & (own != 0xB7) | (before == 0xC4) & (own <= 0xAF)
        letter[high] = (own == 0xC3) | (own == 0xC4) | (own < 0xC0) & latin
    odd = inside & ~(letter | closer)
    odd[1:] |= letter[1:] & closer[:-1]
    odds = np.cumsum(odd, dtype=np.int32)
    starts = np.flatnonzero(first)
    turn = np.flatnonzero(closer[1:] & letter[:-1]) + 1
    own = np.searchsorted(starts, turn) - 1
    ends = np.append(starts[1:], len(flat)) - 1
    plain = odds[ends] == odds[starts] - odd[starts]
    first[turn[plain[own]]] = True
    cuts = np.flatnonzero(first)
    blanks = np.cumsum(~inside, dtype=np.int32)
    body = flat[inside]
    bounds = np.append(cuts - blanks[cuts], len(body)).astype(np.int64)
    stops = np.cumsum([len(x) + 1 for x in raw]) - 1
    return pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(body)), np.searchsorted(cuts, stops)


def _tokenized(texts: list[str], words: WordIds, end_id: int) -> Iterator[tuple[bytes, np.ndarray]]:
    pieces, counts = pieces_of(texts)
    ids, ends = words.encode(pieces)
    stops = np.concatenate([[0], ends])[counts]
    marked = ids == MARK
    marks = np.flatnonzero(marked)
    before = np.concatenate([[0], np.cumsum(marked)])  # marks in front of each place
    plain, end = ids[~marked], np.array([end_id], "<u4")
    places = marks - np.arange(len(marks))
    a = 0
    for stop in stops.tolist():
        lo, hi = before[a], before[stop]
        first, last = a - lo, stop - hi
        own = places[lo:hi] - first
        n = int(last - first) + 1
        own = own[(own > 0) & (own < n - 1)]
        if len(own):
            own = own[np.diff(own, prepend=0) > 0]
        yield plain[first:last].tobytes() + end.tobytes(), np.append(own, n)
        a = stop


def best_cuts(at: list[int], penalty: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """For candidates at[0] = 0 < at[1] < ...: the least cost of cutting at each, and the cut before it on that way."""
    best, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])  # (best + at, index), both ends ordered: the first is the minimum
    for i in range(1, len(at)):
        here = at[i]
        while here - at[queue[0][1]] > window:
            queue.popleft()
        low, j = queue[0]
        best[i] = cost = penalty[i] + window - here + low
        back[i] = j
        cost += here
        while queue and queue[-1][0] >= cost:
            queue.pop()
        queue.append((cost, i))
    return best, back


def candidates(ends: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token offsets, penalties) of the cuts behind offset 0; ends: of all sentences, closing: which end a document."""
    before = np.concatenate([[0], ends[:-1]])
    total = (ends - before - 1) // STRIDE + 1  # with cuts inside long sentences
    first = np.repeat(np.cumsum(total) - total, total)
    k = np.arange(len(first)) - first + 1
    last = k == np.repeat(total, total)
    at = np.where(last, np.repeat(ends, total), np.repeat(before, total) + k * STRIDE)
    return at, np.where(last, np.where(np.repeat(closing, total), 0, SENTENCE_CUT), WORD_CUT)


def pack_stream(docs: Iterable[tuple[object, bytes, np.ndarray]], first_id: int, window: int = WINDOW, block: int = BLOCK) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, crc, doc_tokens, sequence_id, offset, ids) of documents (id, ids, ends)."""
    held: list[list] = []  # [doc_id, ids, ends, tokens already packed]
    size, sequence = 0, first_id

    def flush(final: bool) -> Iterator[tuple]:
        nonlocal held, size, sequence
        base, starts, places = 0, [], []
        for _, ids, ends, skip in held:
            starts.append(base)
            places.append((ends[ends > skip] if skip else ends) + (base - skip))
            base += (len(ids) >> 2) - skip
        places, closing = np.concatenate(places), np.cumsum([len(x) for x in places]) - 1
        own, cost = candidates(places, np.isin(np.arange(len(places)), closing, assume_unique=True))
        at, penalty = [0, *own.tolist()], [0, *cost.tolist()]
        best, back = best_cuts(at, penalty, window)
        stop = len(at) - 1
        if not final:  # the cheapest cut in the last window's reach
            late = [i for i in range(len(at) - 1, 0, -1) if at[-1] - at[i] < window]
            stop = min(late, key=lambda i: (best[i], -i))
        cuts = [stop]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        k = 0
        for a, b in zip(cuts, cuts[1:]):
            lo, hi = at[a], at[b]
            here = lo
            while here < hi:
                doc_id, ids, _, skip = held[k]
                total = len(ids) >> 2
                start = here - starts[k] + skip
                length = min(total - start, hi - here)
                piece = ids[4 * start : 4 * (start + length)]
                yield doc_id, start, length, zlib.crc32(piece), total, sequence, here - lo, piece
                here += length
                if start + length == total:
                    k += 1
            sequence += 1
        done = at[stop]
        rest = held[k:]
        if rest and not final:
            rest[0][3] += max(0, done - starts[k])
        held, size = rest if not final else [], base - done

    for doc_id, ids, ends in docs:
        held.append([doc_id, ids, ends, 0])
        size += len(ids) >> 2
        if size >= block:
            yield from flush(False)
    if held:
        yield from flush(True)


def pack_documents(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = 1, keep_ids: bool = True, cache: int = 500_000) -> DataFrame:
    """One row per piece, in the columns of SCHEMA (ids little-endian 32-bit, null unless keep_ids). sequence_id is the
    partition's number shifted by 40 bits plus a count, so no step over all rows is needed. ``cache``: pieces whose ids a
    worker keeps, about 300 bytes each, up to twice as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = word_ids(tokenizer, cache)

        def stream():
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    for doc_id, got in zip(part.column(0).to_pylist(), tokenize(part.column(1).to_pylist(), words, end_id)):
                        yield (doc_id, *got)

        rows: list[tuple] = []
        for piece in pack_stream(stream(), TaskContext.get().partitionId() << 40, window):
            rows.append(piece)
            if len(rows) >= 8192:
                yield batch_of(rows, keep_ids)
                rows = []
        if rows:
            yield batch_of(rows, keep_ids)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[7], pa.binary()) if keep_ids else pa.nulls(len(rows), pa.binary())], names)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark, sf_dir: str, path: Callable[[], str] = default_tokenizer) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, path(), keep_ids=False).drop("ids")
