"""Reply trees to training conversations.

Messages name the message they answer. Iterative self-joins double the distance that each
step up a tree covers, so a branch of a million replies takes twenty joins; the same steps
then list the messages of the chosen branches, each once. Branches are ranked by score
within their tree, and each chosen one is formatted as one conversation, with the spans
that count in the loss.

The template: `<s>` once, then for each turn, by role,
    user       [INST] text [/INST]
    system     [SYS] text [/SYS]
    assistant  a space, text, </s>
    any other  [ROLE] role[:] text [/ROLE]
A control string inside a text or role gets a backslash after its first character (one more
where it has some), which reading takes away again; so no text can close or open a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadro.llm.common import SHORT_BATCHES, stage
from quadro.operators.ordered import numbered

CONTROL = re.compile(r"<\\*/?s>|\[\\*(?:/?(?:INST|SYS|ROLE)|:)\]")
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", "</s>")}
OTHER, NAMED = ("[ROLE] ", " [/ROLE]"), "[:] "
#: Code points of one row of a formatted conversation; a longer one goes on in further rows, cut between turns.
PART = 1 << 20


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, the text, and what stands after it."""
    if role in MARKS:
        return MARKS[role][0], escaped(text), MARKS[role][1]
    return OTHER[0] + escaped(role) + NAMED, escaped(text), OTHER[1]


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of formatted turns, without the `<s>` before them."""
    at = 0
    while at < len(formatted):
        role = next((r for r in ("user", "system") if formatted.startswith(MARKS[r][0], at)), None)
        start, end = MARKS[role] if role else OTHER if formatted.startswith(OTHER[0], at) else MARKS["assistant"]
        stop = formatted.index(end, at + len(start))
        inside, at = formatted[at + len(start) : stop], stop + len(end)
        if (start, end) == OTHER:
            role, _, inside = inside.partition(NAMED)
        yield unescaped("assistant" if role is None else role), unescaped(inside)


def branches(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """The messages of each tree's best branches: root, rank, leaf, place, id (place from 0 at the root).

    messages: id (unique), parent, score. A branch runs from a message that nothing answers to
    the message that answers nothing; one whose parent is null, itself or no message counts as
    a root. Its score is the sum of its messages' (null: 0). Branches of a tree are ranked by
    score, then length, both falling, then by the leaf's id; `keep` of them stay (None: all).
    Messages that answer each other in a circle hang on no root and are left out.
    """
    m = stage(messages.select("id", F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "messages")
    known = m.select(F.col("id").alias("parent"))
    own = m.where("parent is not null").join(known, "parent", "left_semi")
    step = stage(own.select("id", F.col("parent").alias("up"), F.col("score").alias("sum")), "steps")
    steps, n = [], m.count()
    while not step.isEmpty() and 1 << len(steps) <= n:  # only a circle goes on for longer
        steps.append(step)
        over = step.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("sum").alias("more"))
        step = stage(step.join(over, "up").select("id", F.col("far").alias("up"), (F.col("sum") + F.col("more")).alias("sum")), "steps")
    answered = own.select(F.col("parent").alias("id"))
    leaves = m.join(answered, "id", "left_anti").select(F.col("id").alias("leaf"), F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("total"))
    for k in reversed(range(len(steps))):
        up = steps[k].select(F.col("id").alias("root"), "up", "sum")
        leaves = leaves.join(up, "root", "left").select("leaf", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth"), (F.col("total") + F.coalesce("sum", F.lit(0.0))).alias("total"))
    tops = m.join(own.select("id"), "id", "left_anti").select(F.col("id").alias("root"), F.col("score").alias("first"))
    ends = leaves.join(tops, "root")  # what hangs on a circle has come to none of them
    ranked = ends.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc(F.col("total") + F.col("first")), F.desc("depth"), "leaf")))
    if keep is not None:  # each task keeps its own best of a tree before they meet
        ranked = ranked.where(F.col("rank") <= keep)
    chosen = stage(ranked.select("root", "rank", "leaf", "depth"), "branches")
    path = chosen.select("root", "rank", "leaf", F.col("leaf").alias("id"), F.col("depth").alias("place"))
    for k in reversed(range(len(steps))):  # every distance is one sum of powers of two
        there, above = F.struct("id", "place"), F.struct(F.col("up").alias("id"), (F.col("place") - (1 << k)).alias("place"))
        both = path.join(steps[k].select("id", "up"), "id", "left").select("root", "rank", "leaf", F.explode(F.when(F.col("up").isNull(), F.array(there)).otherwise(F.array(there, above))).alias("at"))
        path = both.select("root", "rank", "leaf", "at.id", "at.place")
    return path


def _by_conversation(batches: Iterable[pa.RecordBatch], columns: list[str], key: str) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows of the same key; the rows are read as they are used."""
    at = columns.index(key)
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
    return groupby(rows, key=lambda r: r[at])


def _flushed(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def formatted(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One conversation for each branch: leaf, part, start, text, loss.

    messages: id, role, text (null: empty). A conversation is one row, or, beyond PART code
    points, several whose texts follow each other; start is where a row's text begins in it.
    loss: (start, end) code points in the whole conversation of each assistant turn's text, as
    escaped. Tasks read their rows sorted and write as they go, so that memory follows the
    longest turn and PART, not the conversation.
    """
    schema = pa.schema([("leaf", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for leaf, rows in _by_conversation(batches, ["leaf", "role", "text"], "leaf"):
            texts, loss, part, start, at = ["<s>"], [], 0, 0, 3
            for _, role, text in rows:
                if at - start > PART:
                    out.append((leaf, part, start, "".join(texts), loss))
                    texts, loss, part, start, held = [], [], part + 1, at, held + at - start
                pre, inside, post = turn(role or "", text or "")
                if role == "assistant":
                    loss.append({"start": at + len(pre), "end": at + len(pre) + len(inside)})
                texts += pre, inside, post
                at += len(pre) + len(inside) + len(post)
                if held > PART:
                    yield _flushed(out, schema)
                    out, held = [], 0
            out.append((leaf, part, start, "".join(texts), loss))
            held += at - start
        if out:
            yield _flushed(out, schema)

    d = paths.select("leaf", "place", "id").join(messages.select("id", "role", "text"), "id").select("leaf", "place", "role", "text")
    d = d.repartition("leaf").sortWithinPartitions("leaf", "place").select("leaf", "role", "text")
    return d.mapInArrow(write, "leaf bigint, part int, start bigint, text string, loss array<struct<start: bigint, end: bigint>>")


def read_back(conversations: DataFrame) -> DataFrame:
    """What formatted conversations say: leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The turns are parsed from the texts, and what counts in the loss is cut out of them by the
    spans, both unescaped. Digests grow as the rows of a conversation come by.
    """
    schema = pa.schema([("leaf", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for leaf, rows in _by_conversation(batches, ["leaf", "part", "start", "text", "loss"], "leaf"):
            turns, lost, n, chars, end = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, part, start, text, loss in rows:
                for role, said in parsed(text[3:] if part == 0 else text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in loss:
                    inside = unescaped(text[span["start"] - start : span["end"] - start])
                    lost.update(inside.encode())
                    chars += len(inside)
                end = start + len(text)
            out.append((leaf, n, turns.hexdigest(), chars, lost.hexdigest(), end))
            if len(out) == 1000:
                yield _flushed(out, schema)
                out = []
        if out:
            yield _flushed(out, schema)

    d = conversations.select("leaf", "part", "start", "text", "loss").repartition("leaf").sortWithinPartitions("leaf", "part")
    return d.mapInArrow(read, "leaf bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def replies(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> tuple[DataFrame, DataFrame]:
    """Conversations given as numbered turns, as (tree, texts): id, parent, score (0), and id, role, text, conversation.

    A turn answers the one before it in its conversation; turns are taken by number (null last),
    equal numbers by role and text. Rows without a conversation are one conversation. Ids come
    from ranges of the order, so a conversation of many turns is spread over tasks.
    """
    rows = turns.select(F.col(conversation).alias("conversation"), F.col(order).alias("turn"), "role", "text")
    texts = stage(numbered(rows, [F.col("conversation"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")], "id"), "turns")
    earlier = texts.select((F.col("id") + 1).alias("id"), F.col("conversation").alias("_before"), F.lit(True).alias("_any"))
    linked = F.coalesce("_any", F.lit(False)) & F.col("conversation").eqNullSafe(F.col("_before"))
    tree = texts.select("id", "conversation").join(earlier, "id", "left").select("id", F.when(linked, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"))
    return tree, texts.select("id", "role", "text", "conversation")


def conversations(tree: DataFrame, texts: DataFrame, keep: int | None = 1) -> DataFrame:
    """The best branches of a tree (id, parent, score) formatted, written: see branches() and formatted()."""
    return stage(formatted(branches(tree, keep), texts), "conversations", SHORT_BATCHES)
