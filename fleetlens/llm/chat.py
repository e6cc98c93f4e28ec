"""Conversations from reply trees, in a chat template that can be read back.

Messages reply to messages. Self-joins over pointers that double their reach give every message its root, its depth and the
score of the branch above it, in as many rounds as the depth has binary digits; the same pointers then list every message
of the chosen branches once. Each message becomes one fragment of its conversation by itself, so no conversation has to fit in memory; a
conversation is its fragments in order. Control strings inside texts are escaped, and come back when it is read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.shared import stored

START, END = "<|im_start|>", "<|im_end|>"

_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: Column) -> Column:
    """A backslash more after each ``<`` of ``<|``, ``<\\|``, ...: no control string is left, and none is lost."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    """As for texts; a role also stays on its line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation; raises if anything else is in it."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        at = found.end()
        turns.append((unescape(found[1]).replace("%0A", "\n").replace("%25", "%"), unescape(found[2])))
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def tree_of_turns(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", score: str | None = None
) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of a table of turns: each replies to the one before it.

    Turns are ordered by number, ties by role and text; null texts and roles are empty, and rows without a conversation form one of their own. Repeated
    rows are turns of their own.
    """
    own = rows.select(
        F.coalesce(F.col(conversation).cast("string"), F.lit("")).alias("tree"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.col(score).cast("double") if score else F.lit(0.0)).alias("score"),
    )
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    numbered = own.withColumn("node", node)
    return numbered.select("tree", "node", F.expr("if(node > 1, node - 1, null)").alias("parent"), "role", "text", "score")


def branches(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """Messages of the ``top`` branches of each tree (all if None): tree, leaf, rank, depth, node, role, text.

    A branch runs from a root to a message without replies. Branches rank by mean score (null counts as 0), then length, then the leaf's number.
    A message whose parent isn't there is a root; messages that lead into a circle of replies are in no branch. (tree, node) must be unique.
    """
    messages = stored(messages.withColumn("score", F.coalesce("score", F.lit(0.0))), "messages")
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    at = messages.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.expr("if(known, parent, null)").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")
    )
    reach = [stored(at, "reach")]
    rounds = max(messages.count(), 2).bit_length()
    while len(reach) <= rounds and reach[-1].where("up IS NOT NULL").limit(1).count():
        now = reach[-1]
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        further = now.join(above, ["tree", "up"], "left").select(
            "tree", "node", F.col("up2").alias("up"), F.expr("depth + coalesce(depth2, 0)").alias("depth"), F.expr("total + coalesce(total2, 0)").alias("total")
        )
        reach.append(stored(further, "reach"))
    replied = messages.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = reach[-1].where("up IS NULL").join(replied, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    path = ranked.select("tree", F.col("node").alias("leaf"), "rank", "node")
    for jump in reversed(reach[:-1]):
        up = jump.where("up IS NOT NULL").select("tree", "node", "up")
        path = path.unionByName(path.join(up, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node")))
        path = stored(path, "paths")
    depth = reach[-1].select("tree", "node", "depth")
    return path.join(depth, ["tree", "node"]).join(messages.drop("parent", "score"), ["tree", "node"]).select(
        "tree", "leaf", "rank", "depth", "node", "role", "text"
    )


def formatted(paths: DataFrame) -> DataFrame:
    """One fragment per message of a branch: tree, leaf, rank, depth, fragment, loss_start, loss_end.

    The loss mask covers the characters from loss_start to loss_end of a fragment: the text of an assistant's turn.
    """
    header = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    start = F.length(header)
    end = F.when(F.col("role") == "assistant", start + F.length(body)).otherwise(start)
    return paths.select(
        "tree", "leaf", "rank", "depth", F.concat(header, body, F.lit(END + "\n")).alias("fragment"), start.alias("loss_start"), end.alias("loss_end")
    )


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its fragments, which come in order."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, n, chars, loss = None, 0, 0, 0
    turns, masked = hashlib.sha256(), hashlib.sha256()
    out: list[tuple] = []
    for batch in batches:
        for tree, leaf, fragment, start, end in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "fragment", "loss_start", "loss_end"))):
            if (tree, leaf) != key:
                if key:
                    out.append((*key, n, turns.hexdigest(), loss, masked.hexdigest(), chars))
                key, n, chars, loss = (tree, leaf), 0, 0, 0
                turns, masked = hashlib.sha256(), hashlib.sha256()
            for role, text in read_turns(fragment):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            under = unescape(fragment[start:end])
            masked.update(under.encode())
            loss += len(under)
            chars += len(fragment)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names)
        out = []
    if key:
        out = [(*key, n, turns.hexdigest(), loss, masked.hexdigest(), chars)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def digests(fragments: DataFrame) -> DataFrame:
    """What reading the fragments of each conversation back gives: counts, and digests of its turns and of the text under the loss mask."""
    ordered = fragments.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "depth")
    return ordered.mapInArrow(
        _read_back, "tree string, leaf bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
