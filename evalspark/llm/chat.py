"""Operator 1, chat formatting: reply trees to formatted conversations.

Messages name their parents. Root-to-leaf paths come from iterative self-joins that double their reach: jump tables
hold each message's ancestor 1, 2, 4, ... replies up, and a path that covers 2**k messages covers 2**(k+1) after one
more join, so a thread of a thousand replies takes ten joins. Paths are ranked by the mean score of their messages
(ties by leaf), the best ones of each tree are kept, and each is formatted as one conversation.

Template: system `<<SYS>> text <</SYS>>`, user `[INST] text [/INST]`, assistant `<s> text </s>`, any other role
`[ROLE] role [TEXT] text [/ROLE]`, turns joined by a line feed. Inside texts a backslash is doubled and a control
string gets a backslash after its first character, so that no control string is left and `unescape` restores the text.

Defined cases: a null text or role is the empty one; turns with equal numbers are ordered by role, then text, and are
all kept; in a tree, messages that repeat an id are one message (its least parent, best score, first role and text);
a message whose parent is missing is a root; messages on a cycle or below one have no root and are left out; turns or
messages without a conversation id are one conversation, as in GROUP BY; leaves of equal mean rank by id; an empty
table gives no conversations; further columns are not read.

Shape: paths are found on ids alone. The texts are shuffled once, by tree, where the chosen paths of the tree meet
them; a conversation, which becomes one string, is one row then.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.llm.shared import discard, materialise

CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]")
MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_UNSAFE = re.compile(r"\\|" + _CONTROL.pattern)
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """text without control strings, reversibly."""
    return _UNSAFE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """The inverse of escape."""
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> str:
    """One conversation as a formatted string."""
    out = []
    for role, text in turns:
        before, after = MARKS.get(role) or (f"[ROLE] {escape(role)} [TEXT] ", " [/ROLE]")
        out.append(f"{before}{escape(text)}{after}")
    return "\n".join(out)


def parse(formatted: str) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """The turns of a formatted string, and the spans of it under the loss mask: the assistants' texts."""
    opens = {before.strip(): role for role, (before, _) in MARKS.items()}
    turns, spans, role, begin, name = [], [], None, 0, ""
    for m in _CONTROL.finditer(formatted):
        token = m[0]
        if role is None:
            role, begin = opens.get(token, "[ROLE]"), m.end() + 1
        elif token == "[TEXT]":
            name, begin = unescape(formatted[begin : m.start() - 1]), m.end() + 1
        else:
            end = m.start() - 1
            turns.append((name if role == "[ROLE]" else role, unescape(formatted[begin:end])))
            if role == "assistant":
                spans.append((begin, end))
            role = None
    return turns, spans


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with `tree` as a struct, which is never null and so joins and groups alike."""
    return rows if isinstance(rows.schema["tree"].dataType, StructType) else rows.withColumn("tree", F.struct("tree"))


def _ancestors(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every leaf that has a root and every message above it, itself at up 0."""
    known = messages.select("tree", F.col("id").alias("parent"), F.col("id").alias("to"))
    first = materialise(messages.select("tree", "id", "parent").join(known, ["tree", "parent"], "left").select("tree", "id", "to"), "chat-jump")
    longest = first.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = [first.filter(F.col("to").isNotNull())]
    while not jumps[-1].isEmpty() and 2 ** (len(jumps) - 1) < longest:
        ahead = jumps[-1].select("tree", F.col("id").alias("to"), F.col("to").alias("further"))
        jumps.append(materialise(jumps[-1].join(ahead, ["tree", "to"]).select("tree", "id", F.col("further").alias("to")), "chat-jump"))
    # who has an ancestor as many replies up as its tree has messages is on a cycle or below one
    rootless = jumps.pop()
    has_child = jumps[0].select("tree", F.col("to").alias("id")).distinct() if jumps else rootless.select("tree", "id")
    leaves = first.join(has_child, ["tree", "id"], "left_anti").join(rootless, ["tree", "id"], "left_anti")
    paths = leaves.select("tree", F.col("id").alias("leaf"), F.col("id").alias("node"), F.lit(0).alias("up"))
    for k, jump in enumerate(jumps):
        further = paths.join(jump.withColumnRenamed("id", "node"), ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        before, paths = paths, materialise(paths.unionByName(further), "chat-paths")
        if k:
            discard(before)
    discard(*[j for j in (first, *jumps[1:], rootless) if hasattr(j, "work_path")] if jumps else [])
    return paths


def best_paths(messages: DataFrame, most: int = 1) -> DataFrame:
    """A row per message of each tree's `most` best paths: tree, rank, leaf, pos, id.

    messages: tree, id, parent (null: root) and score (null counts as 0).
    """
    score = F.coalesce(F.max("score"), F.lit(0.0)).alias("score")
    messages = materialise(_keyed(messages.select("tree", "id", "parent", "score")).groupBy("tree", "id").agg(F.min("parent").alias("parent"), score), "chat-messages")
    paths = _ancestors(messages)
    scored = paths.join(messages.select("tree", F.col("id").alias("node"), "score"), ["tree", "node"])
    ranked = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.max("up").alias("depth"))
    if most == 1:
        # one row per tree by an aggregate, which combines on the map side
        first = F.min(F.struct((-F.col("mean")).alias("worse"), "leaf", "depth")).alias("b")
        best = ranked.groupBy("tree").agg(first).select("tree", F.col("b.leaf").alias("leaf"), F.col("b.depth").alias("depth"), F.lit(1).alias("rank"))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
        best = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("mean")
    return paths.join(best, ["tree", "leaf"]).select("tree", "rank", "leaf", (F.col("depth") - F.col("up")).alias("pos"), F.col("node").alias("id"))


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """A row per path: tree, rank, leaf and the formatted conversation, of messages (tree, id, role, text)."""
    turn = F.struct("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = _keyed(messages.select("tree", "id", "role", "text")).groupBy("tree").agg(F.collect_list(turn).alias("said"))
    chosen = _keyed(paths).groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("rank", "leaf", "pos", "id"))).alias("path"))
    # texts already dealt by tree stay where they are
    both = said.join(chosen, "tree").select(F.col("tree.tree").alias("tree"), "said", "path")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, path, rows = batch.column("said"), batch.column("path"), []
            first, last = said.offsets.to_pylist(), path.offsets.to_pylist()
            ids, roles, contents = (said.values.field(c).to_pylist() for c in ("id", "role", "text"))
            steps = list(zip(*(path.values.field(c).to_pylist() for c in ("rank", "leaf", "id")), strict=True))
            for k, tree in enumerate(batch.column("tree").to_pylist()):
                content: dict[int, tuple[str, str]] = {}
                for i in range(first[k], first[k + 1]):
                    value = (roles[i], contents[i])
                    content[ids[i]] = min(content.get(ids[i], value), value)
                for (rank, leaf), of in groupby(steps[last[k] : last[k + 1]], key=lambda p: p[:2]):
                    rows.append((tree, rank, leaf, render([content[i] for *_, i in of])))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    fields = pa.schema([("tree", pa.int64()), ("rank", pa.int32()), ("leaf", pa.int64()), ("formatted", pa.string())])
    return both.mapInArrow(texts, "tree long, rank int, leaf long, formatted string")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings hold, parsed from them alone."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for tree, text in zip(batch.column("tree").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                turns, spans = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                rows.append((tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(digests, schema)


def thread_links(turns: DataFrame, tree: str = "conv_id") -> DataFrame:
    """Messages of plain threads without their texts: each of a conversation's turns replies to the one before it."""
    n = turns.groupBy(F.struct(turns[tree].cast("long").alias("tree")).alias("tree")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("tree", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("id")).select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))


def thread_messages(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(tree, id, role, text) of plain threads: turns in order from 1; equal turns go by role, then text."""
    rows = turns.select(F.struct(turns[tree].cast("long").alias("tree")).alias("tree"), turns[turn].alias("turn"), turns[role].alias("role"), turns[text].alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.select("tree", F.row_number().over(order).cast("long").alias("id"), "role", "text")
