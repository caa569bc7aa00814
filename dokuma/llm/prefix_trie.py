"""Prefix trie of conversations by distributed MSD radix partitioning.

Every different turn (role and text) gets a number from a dictionary, so a conversation is a word over turn numbers. The
recursion starts with one bucket of all conversations, which share the empty prefix. A round splits every large bucket by
its conversations' next number: each child is a node of the trie and a bucket of its own. Three kinds of buckets end it:

* one conversation: the rest of it is a chain of nodes, stated by columns alone;
* at most ``LOCAL`` turns and conversations in all: one task finishes the bucket by multikey quicksort, three-way by the
  turn number at the depth reached, and emits its nodes while it recurses;
* no conversation that goes on: nothing is left to split.

Sums over subtrees come from the local buckets and chains as they are and are carried upwards over the large buckets, of
which there are at most (turns / LOCAL) a level. Counts of a child are combined before they are shuffled, so a turn that a
third of all conversations begin with is not gathered anywhere; a round joins conversations to their next turn by conversation.
There are as many rounds as turns that more than ``LOCAL`` others share, on the longest way.

Defined cases: rows without a conversation id belong to no conversation and take no part; null roles and texts are empty; the order of
turns with one number is that of ``turns``; a conversation without turns ends at the root; no conversations, no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .turns import keyed, numbered

#: A bucket of at most so many turns and conversations is finished in one task.
LOCAL = 1 << 12
#: Chains are listed in steps of so many turns, so that no array grows with a conversation.
STEP = 1 << 16
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def coded(conversations: DataFrame, **names: str) -> DataFrame:
    """(conv long, pos long, code long, n_bytes long): the turns of every conversation in order, each different (role, text)
    with one code."""
    rows = keyed(conversations, **names).where("conv is not null")
    turns = numbered(rows.select(F.col("conv").cast("long").alias("conv"), "turn", "role", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    turns = written(turns.select("conv", "pos", "role", "digest", "n_bytes"), "turn-keys")
    codes = written(turns.select("role", "digest").distinct().withColumn("code", F.monotonically_increasing_id()), "dictionary")
    return written(turns.join(codes, ["role", "digest"]).select("conv", "pos", "code", "n_bytes"), "coded")


def rebuilt(turns: DataFrame, *, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: c gets the first h turns of conversation c - c % every, then its own after its
    first h, h being crc32(c) % most. (turns as ``coded`` has them, members (conv, length))."""
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = own.select("conv", "n", (F.col("conv") - F.col("conv") % every).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    convs = convs.join(own.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    given = F.least("h", F.coalesce("base_n", F.lit(0))).cast("long")
    convs = written(convs.select("conv", "base", "h", given.alias("given"), (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    rest = turns.join(convs.select("conv", "h", "given"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "code", "n_bytes")
    heads = turns.where(F.col("pos") < most).join(convs.where("given > 0").select(F.col("conv").alias("to"), F.col("base").alias("conv"), "given"), "conv")
    heads = heads.where("pos <= given").select(F.col("to").alias("conv"), "pos", "code", "n_bytes")
    return written(rest.union(heads), "rebuilt-turns"), convs.select("conv", "length")


# --- one bucket in one task

def quicksorted(depth: int, convs: np.ndarray, lengths: np.ndarray, first: np.ndarray, code: np.ndarray, size: np.ndarray, parent: int | None, own: int) -> list[list]:
    """The nodes of a bucket, columns as in ``NODE``. convs ascend and share ``depth`` turns, of which the last has ``own``
    bytes; turn d > depth of conversation i is at first[i] + d - depth - 1 in code and size."""
    conv, at, above, n, kids, leaves, saved, ends, parents = [], [], [], [], [], [], [], [], []

    def node(members: np.ndarray, d: int, up: int, n_bytes: int) -> int:
        low = int(convs[members[0]])
        conv.append(low), at.append(d), above.append(up), n.append(len(members)), kids.append(0), leaves.append(0)
        saved.append((len(members) - 1) * n_bytes), parents.append(conv[up] if up >= 0 else parent)
        ended = members[lengths[members] == d]
        ends.append(hashlib.sha256(",".join(map(str, convs[ended].tolist())).encode()).hexdigest() if len(ended) else NONE)
        return len(conv) - 1

    def chain(i: int, d: int, up: int) -> None:
        """All nodes of conversation i from depth d on."""
        m, low, at_first = int(lengths[i]) - d + 1, int(convs[i]), len(conv)
        conv.extend([low] * m), at.extend(range(d, d + m)), above.extend([up, *range(at_first, at_first + m - 1)]), n.extend([1] * m), saved.extend([0] * m)
        kids.extend([0] * m), leaves.extend([0] * m), parents.extend([conv[up] if up >= 0 else parent] + [low] * (m - 1))
        ends.extend([NONE] * (m - 1) + [hashlib.sha256(str(low).encode()).hexdigest()])

    todo = [(np.arange(len(convs)), depth, node(np.arange(len(convs)), depth, -1, own))]
    while todo:
        members, d, top = todo.pop()  # a node whose members go on, or a part of them
        members = members[lengths[members] > d]
        while len(members) > 1:
            key = code[first[members] + (d - depth)]
            pivot = key[len(key) // 2]
            same, less = key == pivot, key < pivot
            equal, more = members[same], members[~same & ~less]
            if len(equal) == 1:
                chain(int(equal[0]), d + 1, top)
            else:
                todo.append((equal, d + 1, node(equal, d + 1, top, int(size[first[equal[0]] + (d - depth)]))))
            members = members[less]
            if len(more) > len(members):
                members, more = more, members
            if len(more):
                todo.append((more, d, top))
        if len(members):
            chain(int(members[0]), d + 1, top)
    for i in range(len(conv) - 1, -1, -1):  # children come after their parent
        leaves[i] = leaves[i] or 1
        if above[i] >= 0:
            kids[above[i]] += 1
            leaves[above[i]] += leaves[i]
            saved[above[i]] += saved[i]
    return [conv, at, parents, n, kids, leaves, saved, ends]


def _finish(members: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of all local buckets; up is the large bucket above, on a bucket's first node only."""
    facts = ("depth", "id", "conv", "length", "own", "parent_low", "up")
    going = members.join(turns, "conv").where("pos > depth").select(*facts, "pos", "code", "n_bytes")
    rows = going.union(members.where("length = depth").select(*facts, *[F.lit(0).cast("long")] * 3))
    names = [*(f.split()[0] for f in NODE.split(", ")), "up"]

    def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
        depth, ident, conv, length, own, code, size = (table[c].to_numpy() for c in ("depth", "id", "conv", "length", "own", "code", "n_bytes"))
        starts = np.flatnonzero(np.r_[True, (np.diff(depth) != 0) | (np.diff(ident) != 0)])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ident)]):
            first = np.flatnonzero(np.r_[True, np.diff(conv[a:b]) != 0])
            nodes = quicksorted(int(depth[a]), conv[a:b][first], length[a:b][first], first, code[a:b], size[a:b], table["parent_low"][a].as_py(), int(own[a]))
            ups = [table["up"][a].as_py()] + [None] * (len(nodes[0]) - 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in nodes[:7]), pa.array(nodes[7], pa.string()), pa.array(ups, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = (batch.column(0).to_numpy() == batch.column(0)[-1].as_py()) & (batch.column(1).to_numpy() == batch.column(1)[-1].as_py())
            if not same[0] or held and (held[-1].column(0)[-1], held[-1].column(1)[-1]) != (batch.column(0)[-1], batch.column(1)[-1]):
                cut = int(np.argmax(same))  # the last bucket may go on
                yield from finished(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield from finished(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition("depth", "id").sortWithinPartitions("depth", "id", "conv", "pos")
    return dealt.drop("pos").mapInArrow(run, f"{NODE}, up long")


def _chains(alone: DataFrame) -> DataFrame:
    """The nodes of buckets of one conversation."""
    steps = alone.select("conv", "depth", "length", "parent_low", F.explode(F.sequence("depth", "length", F.lit(STEP).cast("long"))).alias("from"))
    rows = steps.select("conv", "length", "parent_low", F.col("depth").alias("top"), F.explode(F.sequence("from", F.least(F.col("from") + STEP - 1, F.col("length")))).alias("depth"))
    one = F.lit(1).cast("long")
    last = F.col("depth") == F.col("length")
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_low")).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(NONE).alias("ends_sha256"),
    )


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, id, ends): the hash over the conversations (depth, id, conv) that end at each large bucket, in one pass over
    sorted rows that holds the hash's state alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for depth, ident, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, ident) == now:
                    state.update(f",{conv}".encode())
                else:
                    out += [(*now, state.hexdigest())] if now else []
                    now, state = (depth, ident), hashlib.sha256(str(conv).encode())
            yield batch_of(out)
            out = []
        yield batch_of([(*now, state.hexdigest())] if now else [])

    def batch_of(found: list) -> pa.RecordBatch:
        a, b, c = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], ["depth", "id", "ends"])

    return rows.repartition("depth", "id").sortWithinPartitions("depth", "id", "conv").mapInArrow(run, "depth long, id long, ends string")


def trie(turns: DataFrame, members: DataFrame, *, local: int = LOCAL) -> DataFrame:
    """The nodes (columns of ``NODE``) of the conversations ``members`` (conv, length) with ``turns`` (conv, pos, code,
    n_bytes), pos from 1 to length."""
    spark = turns.sparkSession
    whole = members.agg(F.count("*").alias("n"), F.min("conv").alias("low"), F.coalesce(F.sum(F.col("length") + 1), F.lit(0)).alias("weight")).first()
    if not whole.n:
        return spark.createDataFrame([], NODE)
    number = lambda x: F.lit(x).cast("long")
    is_large = (F.col("n") > 1) & (F.col("weight") > local)
    facts = ("id", "n", "low", "own", "up", "parent_low", "large")
    root = {"id": number(0), "n": number(whole.n), "low": number(whole.low), "own": number(0), "up": number(None), "parent_low": number(None), "large": F.lit(whole.n > 1 and whole.weight > local)}
    children = [spark.range(1).select(*[c.alias(k) for k, c in root.items()])]
    dealt = [members.select("conv", "length", *[c.alias(k) for k, c in root.items()])]
    while not children[-1].where("large").isEmpty():
        depth = len(dealt) - 1
        here = dealt[-1].where(F.col("large") & (F.col("length") > depth)).select("conv", "length", F.col("id").alias("up"), F.col("low").alias("parent_low"))
        following = here.join(turns.where(F.col("pos") == depth + 1).select("conv", "code", "n_bytes"), "conv")
        counted = following.groupBy("up", "code").agg(F.count("*").alias("n"), F.min("conv").alias("low"), F.sum(F.col("length") - depth).alias("weight"), F.max("n_bytes").alias("own"), F.max("parent_low").alias("parent_low"))
        children.append(written(counted.withColumn("large", is_large).withColumn("id", F.monotonically_increasing_id()).select("code", *facts), "children"))
        dealt.append(written(following.select("conv", "length", "up", "code").join(children[-1], ["up", "code"]).select("conv", "length", *facts), "dealt"))

    at = lambda frames: reduce(DataFrame.union, [x.withColumn("depth", number(d)) for d, x in enumerate(frames)])
    every = at(dealt)
    finished = written(_finish(every.where("n > 1 and not large"), turns), "local-nodes")
    out = finished.drop("up").union(_chains(every.where("n = 1")))
    if len(dealt) == 1:
        return out

    ends = _ends(every.where("large and length = depth").select("depth", "id", "conv"))
    firsts = finished.where("up is not null")
    below = None  # sums of the large buckets a level down
    for depth in range(len(dealt) - 2, -1, -1):
        own = children[depth].where("large")
        parts = [
            firsts.where(F.col("depth") == depth + 1).select("up", number(1).alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")),
            children[depth + 1].where("n = 1").select("up", number(1).alias("kids"), number(1).alias("leaves"), number(0).alias("saved")),
            *([] if below is None else [below.select("up", number(1).alias("kids"), "leaves", "saved")]),
        ]
        sums = reduce(DataFrame.union, parts).groupBy(F.col("up").alias("id")).agg(F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        nodes = own.select("id", "n", "low", "own", "up", "parent_low").join(sums, "id", "left")
        nodes = nodes.select("id", "n", "low", "up", "parent_low", F.coalesce("kids", number(0)).alias("kids"), F.coalesce("leaves", number(1)).alias("leaves"), (F.coalesce("saved", number(0)) + (F.col("n") - 1) * F.col("own")).alias("saved"))
        below = written(nodes.withColumn("depth", number(depth)), "large-nodes")
        large = below.join(ends, ["depth", "id"], "left").select(
            F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"),
        )
        out = out.union(large)
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(*rebuilt(coded(rows)))


OP13_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos,
    dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS code, strlen(coalesce(text, '')) AS n_bytes
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM turns GROUP BY conv_id
), given AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS given FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), rebuilt AS (
  SELECT g.conv_id, t.pos AS d, code, n_bytes FROM given g JOIN turns t ON t.conv_id = g.base AND t.pos <= g.h
  UNION ALL SELECT g.conv_id, t.pos - g.h + g.given, code, n_bytes FROM given g JOIN turns t ON t.conv_id = g.conv_id AND t.pos > g.h
), words AS (
  SELECT g.conv_id, coalesce(list(code ORDER BY d) FILTER (code IS NOT NULL), []) AS w, coalesce(list(n_bytes ORDER BY d) FILTER (code IS NOT NULL), []) AS b
  FROM given g LEFT JOIN rebuilt r USING (conv_id) GROUP BY g.conv_id
), prefixes AS (SELECT conv_id, w, b, unnest(range(0, len(w) + 1)) AS depth FROM words
), nodes AS (
  SELECT w[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE b[depth] END) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(w) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY w[1:depth], depth
), kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY p[1:depth - 1], depth - 1
), full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.p = n.p
), up AS (SELECT p, depth, own, n_convs, n_children, unnest(range(0, depth + 1)) AS k FROM full_nodes
), sums AS (
  SELECT p[1:k] AS p, k AS depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * own) AS BIGINT) AS saved_tokens FROM up GROUP BY p[1:k], k
)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.depth = n.depth AND s.p = n.p LEFT JOIN nodes a ON n.depth > 0 AND a.depth = n.depth - 1 AND a.p = n.p[1:n.depth - 1]
"""
