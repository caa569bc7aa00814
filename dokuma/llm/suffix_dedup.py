"""Removal of repeated byte strings by a prefix-free parse of the corpus.

A rolling hash of ``GRAM`` bytes triggers about every ``PERIOD`` bytes; the text between two triggers, both included, is
a phrase. Triggers depend on content alone, so equal strings are cut alike. The suffix at a position is a suffix of a
dictionary phrase (up to the first trigger) followed by a suffix of the parse (phrase after phrase), and two positions
start the same ``length`` bytes when both parts agree to that depth. Sorting the corpus' positions therefore falls apart
into sorting the parse's suffixes and, where those agree, the dictionary's:

1. Every document is parsed. Of its phrases the long ones (plus the first phrase of windows without any of those) are
   counted over the corpus; a window with a counted phrase that occurs once cannot be repeated. Most text ends here. Windows without a whole phrase (texts without triggers, such as runs of one character) are hashed as such.
2. The documents left, each distinct text once, are written to the shared folder. Their windows fall into families with
   the same run of whole phrases (a parse suffix to the window's depth). Families are sorted by that run, then by the
   phrases around it: a family whose neighbours agree too is repeated as a whole.
3. Where only the run agrees, the windows of the family differ in phrase suffixes; they are sorted by their own hash.

Only equality to ``length`` bytes matters, not the order of what differs, so the sorts compare hashes of the strings. What
decides is 128 bits wide (the first step, 64 bits wide, only chooses what is looked at closely): among 10^14 windows two
different ones share 128 bits with a chance of 10^-11. Sorted partitions are read as streams; a phrase or passage that a third of all
documents share is a long run in one of them, never a group in memory, and a short one: a task that has sent a string
twice already deals its further finds by chance (``Seen``), for whether that string is repeated is no question any more.

With ``words``, a run of that many words that occurs in two documents is a repeated passage as well, whatever its bytes and
the white space between its words. Every such window picks the least hash among its shingles of ``SHINGLE`` words: equal
windows pick alike, so only windows whose pick occurs in two documents are hashed whole, sorted and counted.

Null and empty texts have no bytes. Repeated rows and copies repeat every string of theirs. Documents of less than
``length`` bytes (and of less than ``words`` words) stay whole. A null doc_id is an id like any other. Extra columns are
kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

LENGTH, GRAM, PERIOD, LONG = 400, 8, 40, 48
WHOLE, OPEN, GIVES = 1, 2, 4  # a family is repeated; its windows are to be sorted; it also provides windows to others
MOST = 400_000
SHINGLE = 16
PASSAGE_WORDS = 51
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ONE = np.uint64(1)
_C1, _C2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xF1357AEA2E62A9C5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BASE2 = np.uint64(0xA0761D6478BD642F)
_INVERSE2 = np.uint64(pow(int(_BASE2), -1, 1 << 64))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C2
    x = (x ^ (x >> np.uint64(29))) * _C1
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Parse:
    """A text's triggers and phrases, and the families of its windows: starts lo..hi, phrases first..last-1."""

    def __init__(self, text: bytes, length: int = LENGTH):
        self.text, self.length, n = text, length, len(text)
        b = np.frombuffer(text, np.uint8).astype(np.uint64)
        two = b[:-1] | (b[1:] << np.uint64(8))
        four = two[:-2] | (two[2:] << np.uint64(16))
        gram = four[:-4] | (four[4:] << np.uint64(32))
        self.at = t = np.flatnonzero(scrambled(gram * _C1) < np.uint64((1 << 64) // PERIOD))
        lo = np.unique(np.concatenate([[0], t + 1, t + GRAM - length]))
        self.lo = lo = lo[(lo >= 0) & (lo <= n - length)]
        self.hi = np.append(lo[1:] - 1, n - length)
        self.first, self.last = np.searchsorted(t, lo), np.searchsorted(t, lo + length - GRAM, "right") - 1
        self.cored = self.last > self.first

    @cached_property
    def phrase(self) -> np.ndarray:
        """Hashes of the phrases; the lowest bit is 0, that of a window's hash 1."""
        view, digest = memoryview(self.text), xxhash.xxh3_64_intdigest
        return np.array([digest(view[a:z]) for a, z in zip(self.at.tolist(), (self.at[1:] + GRAM).tolist())], np.uint64) & ~_ONE

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases that are counted, running count of the long ones, families that have none of those)."""
        chosen = np.diff(self.at) >= LONG
        run = np.concatenate([[0], np.cumsum(chosen)])
        chosen = chosen.copy()
        bare = self.cored & (run[np.maximum(self.last, 0)] - run[np.minimum(self.first, len(chosen))] == 0)
        chosen[self.first[bare]] = True
        return chosen, run, bare

    def starts(self, families: np.ndarray) -> np.ndarray:
        """The starts of every window of these families."""
        return np.concatenate([np.zeros(0, np.int64), *(np.arange(a, z + 1) for a, z in zip(self.lo[families].tolist(), self.hi[families].tolist()))])

    def short(self, starts: np.ndarray) -> np.ndarray:
        """64-bit hashes of the windows at these starts."""
        view, digest, n = memoryview(self.text), xxhash.xxh3_64_intdigest, self.length
        return np.array([digest(view[s : s + n], seed=2) for s in starts.tolist()], np.uint64) | _ONE

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """128-bit hashes of the windows at these starts, two columns."""
        view, digest, n = memoryview(self.text), xxhash.xxh3_128_digest, self.length
        return np.frombuffer(b"".join([digest(view[s : s + n]) for s in starts.tolist()]), np.int64).reshape(-1, 2)

    def keys(self, families: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the run of whole phrases, hash of the phrases around it) of families with a core."""
        m = len(self.phrase)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.phrase * powers(_BASE, m), dtype=np.uint64)])
        back = powers(_INVERSE, m + 1)
        first, last = self.first[families], self.last[families]
        core = scrambled(((sums[last] - sums[first]) * back[first]) ^ scrambled((last - first).astype(np.uint64) * _C1))
        head = xxhash.xxh3_64_intdigest(self.text[: int(self.at[0]) + GRAM], seed=3)  # what precedes the first trigger
        tail = xxhash.xxh3_64_intdigest(self.text[int(self.at[-1]) :], seed=4)
        before = np.concatenate([[np.uint64(head)], self.phrase])[first]
        after = np.concatenate([self.phrase, [np.uint64(tail)]])[last]
        return core, scrambled(scrambled(before + _C1) * _BASE + after)


def parsed(text: bytes, length: int) -> Parse | None:
    return Parse(text, length) if len(text) >= max(length, 16) else None


def candidates(p: Parse, known: np.ndarray) -> np.ndarray:
    """The families that may be repeated, known being the repeated hashes, sorted."""
    _, run, bare = p.counted()
    hit = np.isin(p.phrase, known)
    held = np.concatenate([[0], np.cumsum(hit & (np.diff(p.at) >= LONG))])
    m = len(hit)
    first, last = np.minimum(p.first, m), np.maximum(p.last, 0)
    all_held = (held[last] - held[first]) == (run[last] - run[first])
    at_first = np.zeros(len(p.lo), bool)
    at_first[bare] = hit[p.first[bare]]
    return np.flatnonzero(p.cored & np.where(bare, at_first, all_held))


def bare_windows(p: Parse, known: list[int]) -> np.ndarray:
    """Starts of windows without a whole phrase whose short hash is known to be repeated."""
    if not known:
        return np.zeros(0, np.int64)
    starts = p.starts(np.flatnonzero(~p.cored))
    return starts[np.isin(p.short(starts), np.array(known, np.int64).view(np.uint64))]


class Seen:
    """What a task has sent once and twice, as far as two tables of a fixed size remember it."""

    def __init__(self, bits: int = 18):
        self.shift = np.uint64(64 - bits)
        self.once = ~(np.arange(1 << bits, dtype=np.uint64) << self.shift)  # what no slot of its own would hold
        self.twice = self.once.copy()

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which of these hashes were sent twice before; the others are noted as sent."""
        slot = (h >> self.shift).astype(np.int64)
        known = self.twice[slot] == h
        again = ~known & (self.once[slot] == h)
        self.twice[slot[again]] = h[again]
        new = ~(known | again)
        self.once[slot[new]] = h[new]
        return known


def dealt(seen: Seen, keys: list[np.ndarray], count: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, known) of rows to be sorted by these keys: those known to be found twice, once before or here, get keys by
    chance, from ``own``, so that they fall anywhere. Rows with a count of 0 stay as they are: they prove nothing.
    keys, own: 64-bit integers."""
    known = np.zeros(len(count), bool)
    at = np.flatnonzero(count > 0)
    both = scrambled(sum((k[at].view(np.uint64) * c for k, c in zip(keys, (_C1, _BASE))), np.uint64(0)))
    order = np.argsort(both, kind="stable")
    first = np.concatenate([[True], np.diff(both[order]) != 0])[: len(at)]
    place = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    third = np.zeros(len(at), bool)
    third[order] = place >= 2
    known[at] = third
    sent = ~third
    known[at[sent]] = seen.known(both[sent])
    away = scrambled(own[known].view(np.uint64) * _C1 + np.arange(known.sum(), dtype=np.uint64)).view(np.int64)
    keys = [k.copy() for k in keys]
    for k in keys:
        k[known] = away
    return (*keys, known)


def repeated_rows(batches: Iterator[pa.RecordBatch], names: list[str], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Of rows (keys, count, ...) sorted by the keys: those whose keys have counts of 2 or more in all, without keys and
    count. A run of any length passes as a stream."""
    held, open_key, open_count = None, None, 0
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        n = len(cols[0])
        if not n:
            continue
        new = np.zeros(n - 1, bool)
        for k in cols[:keys]:
            new |= k[1:] != k[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        total = np.add.reduceat(cols[keys], starts).astype(np.int64)
        if open_key is not None and all(k[0] == o for k, o in zip(cols, open_key)):
            total[0] += open_count
        take = np.repeat(total >= 2, np.diff(np.append(starts, n)))
        if total[-1] >= 2:
            held, open_key, open_count = None, [k[-1] for k in cols[:keys]], 2
        else:
            held, open_key, open_count = [x[-1:] for x in cols], None, 0
        yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in cols[keys + 1 :]], names)


def settle(core: np.ndarray, around: np.ndarray, weight: np.ndarray, several: bool = False) -> np.ndarray:
    """The state of every row of whole runs of ``core``, sorted by core and around; 0: found once. several: the only
    run is known to have other neighbours elsewhere."""
    new_core = np.concatenate([[True], core[1:] != core[:-1]])
    new_class = new_core | np.concatenate([[True], around[1:] != around[:-1]])
    cls, run = np.cumsum(new_class) - 1, np.cumsum(new_core) - 1
    class_weight = np.bincount(cls, weight)
    classes = np.bincount(run[new_class])
    many = (classes[run] > 1) | several
    whole = class_weight[cls] >= 2
    return np.where(whole, WHOLE, np.where(many, OPEN, 0)) | np.where(many & whole & new_class, GIVES, 0)


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (core, around, weight, d, family[, state]) sorted by core and around -> (d, family, state) of those found twice
    or more, or whose state is known already. Only one run that goes on, of at most MOST rows, is held."""
    held: list[np.ndarray] = []
    several = False

    def out(cols: list[np.ndarray], many: bool) -> pa.RecordBatch:
        return batch_of(cols, settle(*cols[:3], many))

    def batch_of(cols: list[np.ndarray], state: np.ndarray) -> pa.RecordBatch:
        state = state | cols[5] if len(cols) > 5 else state
        take = state > 0
        return pa.RecordBatch.from_arrays([pa.array(cols[3][take]), pa.array(cols[4][take]), pa.array(state[take].astype(np.int32))], ["d", "family", "state"])

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if held:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
        core = cols[0]
        if not len(core):
            continue
        cut = int(np.searchsorted(core, core[-1]))  # where the run that may go on begins
        if cut:
            first = int(np.searchsorted(core, core[0], "right"))
            if several:
                yield out([x[:first] for x in cols], True)
                cols = [x[first:] for x in cols]
                cut -= first
                several = False
            if cut:
                yield out([x[:cut] for x in cols], False)
                cols = [x[cut:] for x in cols]
        if len(cols[0]) > MOST:  # one long run: what is complete goes
            last = int(np.searchsorted(cols[1], cols[1][-1]))
            if last:
                yield out([x[:last] for x in cols], True)
                cols, several = [x[last:] for x in cols], True
            if len(cols[0]) > MOST:  # one long class: it is repeated; a single row stands for it from here on
                yield batch_of([x[1:] for x in cols], np.full(len(core := cols[0]) - 1, WHOLE))
                cols = [x[:1].copy() for x in cols]
                cols[2][:] = 2
        held = cols
    if held and len(held[0]):
        yield out(held, several)


def removed_bytes(n: int, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the maximal runs covered by windows at these sorted starts."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + length


class Words:
    """The words of several texts one behind the other, and hashes of runs of them."""

    def __init__(self, texts: list[bytes]):
        flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(lengths + 1) - lengths - 1  # of the texts
        inside = ~SPACE[flat]
        edges = np.flatnonzero(np.diff(inside, prepend=False))  # a blank ends it, so edges come in pairs
        self.a, self.z = edges[::2], edges[1::2]
        self.text = np.searchsorted(self.begins, self.a, "right") - 1  # of each word
        sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + _ONE) * table(_BASE, len(flat)), dtype=np.uint64)])
        self.words = scrambled((sums[self.z] - sums[self.a]) * table(_INVERSE, len(flat))[self.a] + (self.z - self.a).astype(np.uint64) * _C2)

    def runs(self, k: int, base: np.uint64 = _BASE, inverse: np.uint64 = _INVERSE) -> np.ndarray:
        """A hash of every run of k words, those across texts among them."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.words * table(base, len(self.words)), dtype=np.uint64)])
        n = max(len(sums) - k, 0)
        return scrambled((sums[k:] - sums[:n]) * table(inverse, n))

    def within(self, k: int) -> np.ndarray:
        """Where the runs of k words begin that lie in one text."""
        n = max(len(self.words) - k + 1, 0)
        return np.flatnonzero(self.text[:n] == self.text[k - 1 :])

    def full(self, size: int, at: np.ndarray) -> np.ndarray:
        """128-bit hashes of the windows that begin there, two columns."""
        return np.stack([self.runs(size)[at], self.runs(size, _BASE2, _INVERSE2)[at]], 1).view(np.int64)

    def spans(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(begins, ends) in bytes of what the windows of the first text at these sorted words cover."""
        first, last = removed_bytes(len(self.words), starts, size)
        return self.a[first], self.z[last - 1]


class WordFamilies:
    """Windows of ``size`` words that begin one behind the other with one least hash among their shingles (an even
    number): first and last begin, that hash, the text, and the family's number in it."""

    def __init__(self, w: Words, size: int):
        n = max(len(w.words) - size + 1, 0)
        at, k = np.flatnonzero(w.text[:n] == w.text[size - 1 :]), min(SHINGLE, size)
        least, width, covered = w.runs(k) & ~_ONE, size - k + 1, 1
        while covered < width:
            step = min(covered, width - covered)
            least, covered = np.minimum(least[:-step], least[step:]), covered + step
        least = least[at]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(at) != 1)])[: len(at)])
        self.size, self.words, self.least = size, w, least[first]
        self.lo, self.hi = at[first], at[np.append(first[1:], len(at))[: len(first)] - 1]
        self.text = w.text[self.lo]
        self.number = np.arange(len(first)) - np.searchsorted(self.text, self.text)

    def keys(self, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the shingle, hash of all words from the first begin to the last end) of these families."""
        words, lo, end = self.words.words, self.lo[take], self.hi[take] + self.size
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * table(_BASE, len(words)), dtype=np.uint64)])
        around = scrambled(((sums[end] - sums[lo]) * table(_INVERSE, len(words))[lo]) ^ scrambled((end - lo).astype(np.uint64) * _C2))
        return scrambled(self.least[take] + _C1), around

    def starts(self, take: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.arange(a, z + 1) for a, z in zip(self.lo[take].tolist(), self.hi[take].tolist()))])


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Which rows are the first with their keys."""
    order = np.lexsort(keys[::-1])
    new = np.concatenate([[True], np.any([np.diff(k[order]) != 0 for k in keys], 0)])[: len(order)]
    out = np.zeros(len(order), bool)
    out[order] = new
    return out


_TABLES: dict[np.uint64, np.ndarray] = {}


def table(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers, kept up to a million of them."""
    if n > len(_TABLES.get(base, ())):
        if n > 1 << 20:
            return powers(base, n)
        _TABLES[base] = powers(base, min(max(2 * n, 1 << 16), 1 << 20))
    return _TABLES[base][:n]


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of these, which may overlap."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    gap = np.flatnonzero(begins[1:] > ends[:-1])
    return begins[np.concatenate([[0], gap + 1])], ends[np.concatenate([gap, [len(ends) - 1]])]


def per_text(batches: Iterator[pa.RecordBatch], work: Callable, step: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            if (part := batch.slice(lo, step)).num_rows:
                yield from work(part)


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def repeats(docs: DataFrame, *, length: int = LENGTH, words: int | None = None, keep_text: bool = False) -> tuple[DataFrame, Column, Column]:
    """Of every distinct text with something repeated: (k1, k2, n_removed, n_spans, kept_sha256, n_passages,
    passage_bytes, kept string or null); and the two columns that make a text's key. The first counts and the hash are of
    the strings of ``length`` bytes; n_passages and passage_bytes of the passages of ``words`` words (0 without words);
    ``kept`` lacks both, and the characters that a cut goes through."""
    body = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = F.xxhash64(body), F.xxhash64(F.lit(17), body)
    src = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))

    def phrases(seen: Seen) -> Callable:
        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, hashes, counts, at = [_utf8(x) for x in part.column(0).to_pylist()], [], [], []
            for i, text in enumerate(texts):
                if (p := parsed(text, length)) is not None:
                    own, n = np.unique(np.concatenate([p.phrase[p.counted()[0]], p.short(p.starts(np.flatnonzero(~p.cored)))]), return_counts=True)
                    hashes.append(own)
                    counts.append(np.minimum(n, 2))
                    at.append(np.full(len(own), i))
            if words:
                f = WordFamilies(Words(texts), words)
                take = first_of(f.text, f.least)
                hashes.append(f.least[take])
                counts.append(np.ones(take.sum(), np.int64))
                at.append(f.text[take])
            if hashes:
                h, c, at = np.concatenate(hashes).view(np.int64), np.concatenate(counts), np.concatenate(at)
                a, b = part.column(1).to_numpy()[at], part.column(2).to_numpy()[at]
                key, known = dealt(seen, [h], c, a + h)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.where(known, 2, c).astype(np.int32), a, b, h)], ["h", "c", "k1", "k2", "g"])

        return work

    long_enough = src.where(F.octet_length("text") >= (min(length, 2 * words - 1) if words else length))
    counted = long_enough.select("text", k1.alias("k1"), k2.alias("k2")).mapInArrow(lambda x: per_text(x, phrases(Seen())), "h long, c int, k1 long, k2 long, g long")
    twice = counted.repartition("h").sortWithinPartitions("h").mapInArrow(lambda x: repeated_rows(x, ["k1", "k2", "h"]), "k1 long, k2 long, h long")
    lists = twice.groupBy("k1", "k2").agg(F.collect_set("h").alias("hashes"))
    copies = long_enough.select(k1.alias("k1"), k2.alias("k2"), row_key().alias("rk")).groupBy("k1", "k2").agg(F.min("rk").alias("rk"), F.count("*").alias("copies"))
    asked = lists.join(copies, ["k1", "k2"])
    left = src.select("text", row_key().alias("rk"), k1.alias("k1"), k2.alias("k2")).join(asked.hint("shuffle_hash"), ["rk", "k1", "k2"])
    left = written(left.select("k1", "k2", "text", "hashes", F.filter("hashes", lambda x: x.bitwiseAND(F.lit(1)) == 1).alias("bare"), F.least("copies", F.lit(2)).cast("int").alias("copies"), F.monotonically_increasing_id().alias("d")), "repeating")

    def families(seen: Seen) -> Callable:
        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, out = [_utf8(x) for x in part.column(0).to_pylist()], [[], [], [], []]
            known, copies, ds = part.column(1), part.column(2).to_numpy(), part.column(3).to_numpy()
            for i, text in enumerate(texts):
                if (p := parsed(text, length)) is not None and len(own := candidates(p, np.sort(known[i].values.to_numpy().view(np.uint64)))):
                    for o, x in zip(out, (*p.keys(own), np.full(len(own), i), own)):
                        o.append(x)
            plain = sum(map(len, out[0]))
            if words:
                f, offsets = WordFamilies(Words(texts), words), known.offsets.to_numpy()
                pair = lambda i, h: scrambled(h + i.astype(np.uint64) * _C1)
                own = np.flatnonzero(np.isin(pair(f.text, f.least), pair(np.repeat(np.arange(len(texts)), np.diff(offsets)), known.flatten().to_numpy().view(np.uint64))))
                for o, x in zip(out, (*f.keys(own), f.text[own], -1 - f.number[own])):
                    o.append(x)
            if out[0]:
                core, around, at, family = (np.concatenate(o) for o in out)
                core, around = core.view(np.int64), around.view(np.int64)
                weight = copies[at].astype(np.int32)
                # What one text repeats is a repeated string, but no repeated passage.
                weight[plain:][~first_of(at[plain:], core[plain:], around[plain:])] = 0
                core, around, sure = dealt(seen, [core, around], weight, (ds[at] << 24) + family)
                state = np.where(sure, WHOLE, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (core, around, np.where(sure, 1, weight).astype(np.int32), ds[at], family.astype(np.int32), state)], ["core", "around", "weight", "d", "family", "state"])

        return work

    found = left.select("text", "hashes", "copies", "d").mapInArrow(lambda x: per_text(x, families(Seen())), "core long, around long, weight int, d long, family int, state int")
    in_order = found.repartition("core").sortWithinPartitions("core", "around")
    state_of = in_order.mapInArrow(settled, "d long, family int, state int")
    state_of = written(state_of.groupBy("d").agg(F.collect_list("family").alias("families"), F.collect_list("state").alias("states")), "families")

    def open_windows(seen: Seen) -> Callable:
        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = [[], [], [], []]
            for text, bare, fam, state, d in zip(*(part.column(c).to_pylist() for c in ("text", "bare", "families", "states", "d"))):
                text, fam, state = _utf8(text), np.array(fam or [], np.int64), np.array(state or [], np.int32)
                gives = np.sort(fam[(state & GIVES) > 0])  # of a class found twice: what it gives counts as two
                asks = np.setdiff1d(fam[(state & OPEN) > 0], gives)
                if (p := parsed(text, length)) is not None:
                    given = p.starts(gives[gives >= 0])
                    starts = np.concatenate([given, p.starts(asks[asks >= 0]), bare_windows(p, bare)])
                    for o, x in zip(out, (p.windows(starts), np.where(np.arange(len(starts)) < len(given), 2, 1), np.full(len(starts), d), starts)):
                        o.append(x)
                if len(own := -1 - np.concatenate([gives[gives < 0], asks[asks < 0]])):
                    f = WordFamilies(Words([text]), words)
                    starts, given = f.starts(own), len(f.starts(-1 - gives[gives < 0]))
                    h = f.words.full(words, starts)
                    count = np.where(np.arange(len(starts)) < given, 2, 1) * first_of(h[:, 0], h[:, 1])
                    for o, x in zip(out, (h, count, np.full(len(starts), d), -1 - starts)):
                        o.append(x)
            if out[0]:
                h, count, d, start = (np.concatenate(o) for o in out)
                a, b, sure = dealt(seen, [h[:, 0].copy(), h[:, 1].copy()], count, (d << 24) + start)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, np.where(sure, 2, count).astype(np.int32), d, start.astype(np.int32))], ["h", "i", "c", "d", "start"])

        return work

    unclear = left.select("d", "text", "bare").join(state_of.hint("shuffle_hash"), "d", "left").where("size(bare) > 0 OR exists(states, s -> s > 1)")
    opened = unclear.mapInArrow(lambda x: per_text(x, open_windows(Seen())), "h long, i long, c int, d long, start int")
    same = opened.repartition("h", "i").sortWithinPartitions("h", "i").mapInArrow(lambda x: repeated_rows(x, ["d", "start"], 2), "d long, start int")
    starts_of = same.groupBy("d").agg(F.collect_set("start").alias("starts"))

    def remove(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for a, b, text, copies, fam, state, starts in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text", "copies", "families", "states", "starts"))):
            text, starts = _utf8(text), np.array(starts or [], np.int64)
            whole = np.array(fam or [], np.int64)[(np.array(state or [], np.int32) & WHOLE) > 0]
            begins = ends = more = last = np.zeros(0, np.int64)
            if copies > 1 and len(text) >= length:
                begins, ends = np.array([0]), np.array([len(text)])
            elif (p := parsed(text, length)) is not None:
                begins, ends = removed_bytes(len(text), np.unique(np.concatenate([starts[starts >= 0], p.starts(whole[whole >= 0])])), length)
            if (whole < 0).any() or (starts < 0).any():
                f = WordFamilies(Words([text]), words)
                more, last = f.words.spans(np.unique(np.concatenate([-1 - starts[starts < 0], f.starts(-1 - whole[whole < 0])])), words)
            if not len(begins) and not len(more):
                continue
            digest = hashlib.sha256(without(text, begins, ends)).hexdigest()
            kept = without(text, *merged(*(np.concatenate(x) for x in ((begins, more), (ends, last))))).decode("utf-8", "ignore") if keep_text else None
            rows.append((a, b, int((ends - begins).sum()), len(begins), digest, len(more), int((last - more).sum()), kept))
        if rows:
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4]), *(pa.array(x, pa.int64()) for x in c[5:7]), pa.array(c[7], pa.string())], ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes", "kept"])

    notes = state_of.join(starts_of, "d", "full")
    final = left.join(notes.hint("shuffle_hash"), "d", "left").where("families IS NOT NULL OR starts IS NOT NULL OR copies > 1").select("k1", "k2", "text", "copies", "families", "states", "starts")
    result = final.mapInArrow(lambda x: per_text(x, remove), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long, kept string")
    return result.dropDuplicates(["k1", "k2"]), k1, k2


def without(text: bytes, begins: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(text[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(text)]))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The input with repeated strings and passages cut out of ``text``; characters that a cut goes through go whole."""
    result, k1, k2 = repeats(docs, keep_text=True, **options)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), k1.alias("k1"), k2.alias("k2"))
    joined = rows.join(result.select("k1", "k2", "kept"), ["k1", "k2"], "left")
    own = F.col("record")
    return joined.select(*[(F.coalesce("kept", own["text"]) if c == "text" else own[c]).alias(c) for c in docs.columns])


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and of the passages of PASSAGE_WORDS words that another document has too, however few bytes
    they take, their number and bytes. These are found, not removed: kept_sha256 follows the law of LENGTH bytes alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    result, k1, k2 = repeats(docs, words=PASSAGE_WORDS)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    each = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("sha"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return each.join(result.drop("kept"), ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), none("n_passages"), none("passage_bytes")
    )


OP6_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents
), piece AS (  -- pieces of 512 starts, so that no start is looked for from the text's beginning
  SELECT r, p, substr(h, CAST(1024 * p + 1 AS BIGINT), 1822) AS x FROM (SELECT r, h, unnest(range(0, (length(h) // 2 - 400) // 512 + 1)) AS p FROM d WHERE length(h) >= 800)
), string AS (
  SELECT r, 512 * p + s AS s, md5(substr(x, CAST(2 * s + 1 AS BIGINT), 800)) AS k FROM (SELECT r, p, x, unnest(range(0, least(512, length(x) // 2 - 399))) AS s FROM piece)
), again AS (
  SELECT r, s FROM string SEMI JOIN (SELECT k FROM string GROUP BY k HAVING count(*) > 1) USING (k)
), run AS (
  SELECT r, min(s) AS a, max(s) + 400 AS z FROM (
    SELECT r, s, sum(CASE WHEN s - before > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS g
    FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM again)) GROUP BY r, g
), between_runs AS (
  SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p FROM run
), cut AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(z) + 1 AS BIGINT)) AS kept
  FROM between_runs JOIN d USING (r) GROUP BY r
), part AS (
  SELECT r, w, i, octet_length(encode(w)) AS n FROM (
    SELECT r, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\x09-\x0D\x20]+|[\x09-\x0D\x20]+') AS l FROM d))
), placed AS (
  SELECT r, w, i, n, sum(n) OVER (PARTITION BY r ORDER BY i) AS z FROM part
), word AS (
  SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS j, z - n AS a, z FROM placed WHERE regexp_full_match(w, '[^\x09-\x0D\x20]+')
), words AS (
  SELECT r, list(w ORDER BY j) AS l FROM word GROUP BY r HAVING count(*) >= 51
), word_piece AS (
  SELECT r, p, l[256 * p + 1 : 256 * p + 306] AS x FROM (SELECT r, l, unnest(range(0, (len(l) - 51) // 256 + 1)) AS p FROM words)
), passage AS (
  SELECT r, 256 * p + s AS j, md5(array_to_string(x[s + 1 : s + 51], ' ')) AS k FROM (SELECT r, p, x, unnest(range(0, least(256, len(x) - 50))) AS s FROM word_piece)
), shared AS (
  SELECT r, j FROM passage SEMI JOIN (SELECT k FROM passage GROUP BY k HAVING count(DISTINCT r) > 1) USING (k)
), word_run AS (
  SELECT r, min(j) AS j, max(j) + 50 AS e FROM (
    SELECT r, j, sum(CASE WHEN j - before > 51 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY j) AS g
    FROM (SELECT r, j, lag(j) OVER (PARTITION BY r ORDER BY j) AS before FROM shared)) GROUP BY r, g
), passages AS (
  SELECT x.r, count(*) AS n_passages, sum(e.z - b.a) AS passage_bytes
  FROM word_run x JOIN word b ON b.r = x.r AND b.j = x.j JOIN word e ON e.r = x.r AND e.j = x.e GROUP BY x.r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(passage_bytes, 0) AS BIGINT) AS passage_bytes
FROM d LEFT JOIN cut USING (r) LEFT JOIN passages USING (r)
"""
