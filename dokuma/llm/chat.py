"""Chat formatting: reply trees, their best branches, and each chosen path as one conversation.

Messages point at the message they reply to. Iterative self-joins by pointer doubling give every message its distance
and score to the root in as many rounds as the depth has binary digits; leaves are ranked by the mean score of their path,
and the chosen leaves' paths are listed by the same pointers, each ancestor once. A conversation without branches is a
tree of one path.

The template marks the start (``<s>``), a user's turn (``[INST]text[/INST]``), an assistant's (``text</s>``) and any other
role's (``[ROLE]role[INST]text[/INST]``). A control string inside a text or role gets one backslash after its first
character, and one that has backslashes there already gets one more, so unescaping is exact and no text can end a turn.

Defined cases: null texts and roles count as empty. A null id is a tree of its own. A message whose parent is absent is a
root. Messages on a circle of replies, or below one, have no root and are in no path. Of repeated messages of one id the
first by (parent, role, text) stays; repeated rows of a conversation are turns of their own. Equal scores: the smaller leaf first. No score counts
as 0. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .turns import keyed, numbered

START, END, INST, INST_END, ROLE = "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]"
_CONTROL = r"(/?(?:s>|INST\]|ROLE\]))"
_CONTROLS = re.compile("|".join(map(re.escape, (START, END, INST, INST_END, ROLE))))
_ESCAPED = re.compile(r"([<\[])(\\*)\\" + _CONTROL)
#: A formatted conversation is held in pieces of so many turns, so that no row grows with its length.
SEGMENT = 64


# --- reply trees

def _levels(messages: DataFrame) -> list[DataFrame]:
    """Pointers by doubling: table k has (tree, node, up, length, total) of the nodes that have an ancestor 2^(k-1) above
    (table 0: all); up is the ancestor 2^k above or null, length and total count the path below it."""
    some = messages.select("tree", F.col("node").alias("up")).distinct()
    first = messages.where("parent is not null").select("tree", "node", F.col("parent").alias("up"), "score").join(some, ["tree", "up"], "left_semi")
    roots = messages.join(first.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node", F.lit(None).cast(messages.schema["node"].dataType).alias("up"), "score")
    as_level = lambda df: df.select("tree", "node", "up", F.lit(1).cast("long").alias("length"), F.col("score").alias("total"))
    levels = [written(as_level(first).union(as_level(roots)), "replies")]
    most = levels[0].count()
    while not (going := levels[-1].where("up is not null")).isEmpty():
        if 1 << (len(levels) - 1) > most:  # no path is that long: circles
            break
        ended = [x.where("up is null") for x in levels]
        above = reduce(DataFrame.union, [going, *ended]).select("tree", F.col("node").alias("up"), F.col("up").alias("upper"), F.col("length").alias("more"), F.col("total").alias("rest"))
        step = going.join(above, ["tree", "up"]).select("tree", "node", F.col("upper").alias("up"), (F.col("length") + F.col("more")).alias("length"), (F.col("total") + F.col("rest")).alias("total"))
        levels.append(written(step, "replies"))
    return levels


def reply_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, branch int from 1, depth long from 1, node) for the ``best`` branches of every tree by mean score (None:
    all); messages: (tree, node, parent, score), tree not null, each (tree, node) once."""
    levels = _levels(messages)
    whole = reduce(DataFrame.union, [x.where("up is null") for x in levels])
    leaves = whole.join(messages.select("tree", F.col("parent").alias("node")).where("node is not null").distinct(), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), "node")
    ranked = leaves.withColumn("branch", F.row_number().over(order))
    ranked = ranked if best is None else ranked.where(F.col("branch") <= best)
    paths = written(ranked.select("tree", F.col("node").alias("leaf"), "branch", F.col("length").alias("depth"), "node"), "paths")
    for k in reversed(range(len(levels))):  # distances by binary digits: every ancestor is reached once
        up = levels[k].where("up is not null").select("tree", "node", "up")
        if up.isEmpty():
            continue
        higher = paths.join(up, ["tree", "node"]).select("tree", "leaf", "branch", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("node"))
        paths = written(paths.union(higher), "paths")
    return paths


# --- template

def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1$2\\$3")


def _turn(role: Column, text: Column) -> Column:
    body = escaped(text)
    user = F.concat(F.lit(INST), body, F.lit(INST_END))
    return F.when(role == "assistant", F.concat(body, F.lit(END))).when(role == "user", user).otherwise(F.concat(F.lit(ROLE), escaped(role), user))


def formatted(path_turns: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """(tree, branch, segment long, text, loss array<struct<start int, end int>>) of (tree, branch, depth, role, text). The
    pieces of a path, one after the other, are its conversation; loss has the spans of assistants' texts in a piece, in
    code points."""
    first = F.when(F.col("depth") == 1, F.lit(START)).otherwise(F.lit(""))
    learnt = F.when(F.col("role") == "assistant", F.length(escaped(F.col("text")))).otherwise(0)
    piece = F.struct("depth", F.concat(first, _turn(F.col("role"), F.col("text"))).alias("piece"), F.length(first).alias("lead"), learnt.alias("learnt"))
    parts = path_turns.groupBy("tree", "branch", F.floor((F.col("depth") - 1) / segment).alias("segment")).agg(F.sort_array(F.collect_list(piece)).alias("p"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    span = lambda at, p: F.array(F.struct((at + p["lead"]).alias("start"), (at + p["lead"] + p["learnt"]).alias("end")))
    step = lambda a, p: F.struct((a["at"] + F.length(p["piece"])).alias("at"), F.when(p["learnt"] > 0, F.concat(a["loss"], span(a["at"], p))).otherwise(a["loss"]).alias("loss"))
    loss = F.aggregate("p", F.struct(F.lit(0).alias("at"), none.alias("loss")), step, lambda a: a["loss"])
    return parts.select("tree", "branch", "segment", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("text"), loss.alias("loss"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in a formatted piece."""
    role, at = "user", 0
    for m in _CONTROLS.finditer(text):
        between, at = unescaped(text[at : m.start()]), m.end()
        if m[0] == ROLE:
            role = None
        elif m[0] == INST:
            role = between if role is None else "user"
        elif m[0] == INST_END:
            yield role, between
        elif m[0] == END:
            yield "assistant", between


# --- conversations

def conversation_messages(conversations: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(messages, texts): each conversation as a chain of replies, (tree string, node long, parent long, score double, turn,
    role, digest), and the texts by (tree, turn, role, digest), each once. tree is "" for a null id, else "=" and the id."""
    rows = keyed(conversations, **names)
    tree = F.when(F.col("conv").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv").cast("string")))
    keys = numbered(rows.drop("text"))
    messages = keys.select(tree.alias("tree"), F.col("pos").alias("node"), F.when(F.col("pos") > 1, F.col("pos") - 1).alias("parent"), F.lit(0.0).alias("score"), "turn", "role", "digest")
    texts = rows.select(tree.alias("tree"), "turn", "role", "digest", "text").dropDuplicates(["tree", "turn", "role", "digest"])
    return messages, texts


def formatted_conversations(conversations: DataFrame, *, segment: int = SEGMENT, **names: str) -> DataFrame:
    """The pieces of every conversation's text, as ``formatted`` has them."""
    messages, texts = conversation_messages(conversations, **names)
    messages = written(messages, "messages")
    paths = reply_paths(messages.select("tree", "node", "parent", "score"))
    turns = paths.select("tree", "branch", "depth", "node").join(messages.select("tree", "node", "turn", "role", "digest"), ["tree", "node"])
    t = texts.select(F.col("tree").alias("t"), F.col("turn").alias("n"), F.col("role").alias("r"), F.col("digest").alias("d"), "text")
    turns = turns.join(t, (turns["tree"] == t["t"]) & turns["turn"].eqNullSafe(t["n"]) & (turns["role"] == t["r"]) & (turns["digest"] == t["d"]))
    return formatted(turns.select("tree", "branch", "depth", "role", "text"), segment=segment)


def formatted_replies(messages: DataFrame, best: int | None = 1, *, segment: int = SEGMENT) -> DataFrame:
    """The pieces of the ``best`` branches of every reply tree (None: all) from (tree, node, parent, score, role, text)."""
    whole = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    own = messages.where("node is not null").groupBy(F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("tree"), "node").agg(F.min(whole).alias("m")).select("tree", "node", "m.*")
    paths = reply_paths(own.select("tree", "node", "parent", "score"), best)
    return formatted(paths.join(own.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "branch", "depth", "role", "text"), segment=segment)


def digests(pieces: DataFrame) -> DataFrame:
    """What is read back from formatted pieces, one row a path: the pieces of a path come one after the other and only the
    hashes' states are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, out = None, []

        def close() -> None:
            if now is not None:
                out.append((*now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        for batch in batches:
            for tree, branch, _, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if (tree, branch) != now:
                    close()
                    now, counts, turns, loss = (tree, branch), [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                for role, body in read_back(text):
                    counts[0] += 1
                    turns.update(f"{role}\n{body}\n".encode())
                for s in spans:
                    learnt = unescaped(text[s["start"] : s["end"]])
                    counts[1] += len(learnt)
                    loss.update(learnt.encode())
                counts[2] += len(text)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema)

    schema = pa.schema([("tree", pa.string()), ("branch", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    whole = pieces.repartition("tree", "branch").sortWithinPartitions("tree", "branch", "segment")
    return whole.select("tree", "branch", "segment", "text", "loss").mapInArrow(run, "tree string, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    found = digests(formatted_conversations(rows.union(more)))
    return found.select(F.expr("try_cast(substring(tree, 2) AS BIGINT)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP11_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, sha256(text) AS digest, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))', '\1\2\\\3', 'g')) AS n,
    length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))', '\1\2\\\3', 'g')) AS n_role FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, digest)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, digest) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 ELSE 19 + n_role END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
