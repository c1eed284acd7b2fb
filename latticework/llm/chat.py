"""Reply trees to formatted conversations.

``enumerate_paths`` finds the root-to-leaf paths of all reply trees by iterated
self-joins. Each round joins the ancestor table with itself, so hops double
(parent, grandparent, 4th, 8th ancestor, ...) and a tree of depth d takes log2 d
rounds. Rounds shuffle ids only; texts join once, at the end. The same tables
then unfold the chosen leaves: round k adds the ancestors 2^k further up, so the
work is the size of the result. Keys are single nodes, which no hot tree skews.

``rank_branches`` ranks the leaves of a tree by path score, best first, ties to
the smaller leaf id. The top ``branches`` are found in salted subgroups first,
so a tree with most leaves is not ranked by one task.

``format_paths`` makes each chosen path one conversation in a chat template and
marks the assistant texts in a loss mask. One conversation is one value, so its
turns meet in one row; that is the only place where turns are gathered.

Escaping: inside roles and texts, every control string of the known templates
gets a backslash after its first character, and one more if it has some, so the
marks of the template are the only ones and ``unescape`` restores each text.

A reply whose parent is not in the tree starts a path of its own. Replies on a
cycle have no root and are left out. Null text counts as empty, null role as an
empty role, null trees form one tree of their own, repeated rows are turns each. Further columns are
not read. An empty table gives no paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.scratch import materialize

BEGIN, END = "<s>", "</s>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of public chat templates, cut after their first character.
_CONTROL = re.compile(r"(<)(\\*)(/?s>|/?<SYS>>|</SYS>>|\|)|(\[)(\\*)(/?(?:INST|TOOL_CALLS|AVAILABLE_TOOLS|TOOL_RESULTS)\])")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    def less(m: re.Match) -> str:
        marks = m[2] or m[5] or ""
        return f"{m[1] or m[4]}{marks[1:]}{m[3] or m[6]}"

    return _CONTROL.sub(less, text)


def _one_line(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _from_one_line(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[int], list[int]]:
    """Formatted conversation, and the starts and ends of the loss mask in code points."""
    parts, at, starts, ends = [BEGIN], len(BEGIN), [], []
    for role, text in turns:
        head, body = f"{OPEN}{_one_line(escape(role))}\n", escape(text)
        at += len(head)
        if role == loss_role:
            starts.append(at)
            ends.append(at + len(body))
        at += len(body) + len(CLOSE) + 1
        parts += [head, body, CLOSE, "\n"]
    return "".join([*parts, END]), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    if not (formatted.startswith(BEGIN) and formatted.endswith(END)):
        raise ValueError("not a formatted conversation")
    turns, at, stop = [], len(BEGIN), len(formatted) - len(END)
    while at < stop:
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        close = formatted.index(CLOSE, line + 1)
        turns.append((unescape(_from_one_line(formatted[at + len(OPEN) : line])), unescape(formatted[line + 1 : close])))
        at = close + len(CLOSE) + 1
    return turns


def masked_text(formatted: str, starts: list[int], ends: list[int]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[s:e]) for s, e in zip(starts, ends, strict=True))


def _jump_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up) of the 2^k-th ancestors, and (tree, node, score, depth) summed up to the root."""
    parents = nodes.select("tree", F.col("node").alias("up"), F.lit(True).alias("there"))
    linked = nodes.select("tree", "node", F.col("parent").alias("up"), "score").join(parents, ["tree", "up"], "left")
    up = F.when(F.col("there"), F.col("up"))
    start = materialize(linked.select("tree", "node", up.alias("up"), "score", up.isNotNull().cast("long").alias("depth")), "chat-links")
    total = start.count()
    jumps: list[DataFrame] = []
    below, at_root = start.where("up IS NOT NULL"), start.where("up IS NULL")
    # a round moves only the nodes that have not reached their root; 2^rounds > total leaves cycles alone
    while 2 ** len(jumps) <= max(1, total) and not below.isEmpty():
        jumps.append(below.select("tree", "node", "up"))
        above = at_root.unionByName(below).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("depth").alias("deeper")
        )
        stepped = below.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("deeper")).alias("depth")
        )
        stepped = materialize(stepped, "chat-state")
        below, at_root = stepped.where("up IS NOT NULL"), at_root.unionByName(stepped.where("up IS NULL"))
    return jumps, at_root.select("tree", "node", "score", "depth")


def rank_branches(leaves: DataFrame, branches: int | None, salts: int = 16) -> DataFrame:
    """``leaves(tree, node, score)`` with ``rank``, kept up to ``branches`` a tree (None: all)."""
    best = [F.col("score").desc(), F.col("node")]
    if branches is not None:
        salt = F.pmod(F.xxhash64("node"), F.lit(salts))
        first = Window.partitionBy("tree", salt).orderBy(*best)
        leaves = leaves.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= branches)
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*best)))
    return ranked if branches is None else ranked.where(F.col("rank") <= branches)


def enumerate_paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, node, up): the nodes of every chosen path, ``up`` steps above its leaf.

    ``nodes`` has tree string, node long, parent long and score double; node ids
    are unique within a tree. A path's score is the sum of its nodes'.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    jumps, scored = _jump_tables(nodes)
    inner = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rank_branches(scored.join(inner, ["tree", "node"], "left_anti"), branches)
    parts = [leaves.select("tree", F.col("node").alias("leaf"), "rank", "score", "depth", "node", F.lit(0).cast("long").alias("up"))]
    parts[0] = materialize(parts[0], "chat-path")
    for k, jump in enumerate(jumps):
        # only nodes with an ancestor that far up take part, so short paths rest while long ones unfold
        open_ = reduce(DataFrame.unionByName, parts).where(F.col("up") + 2**k <= F.col("depth"))
        step = jump.select("tree", "node", F.col("up").alias("above"))
        grown = open_.join(step, ["tree", "node"]).select(
            "tree", "leaf", "rank", "score", "depth", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up")
        )
        parts.append(materialize(grown, "chat-path"))
    return reduce(DataFrame.unionByName, parts).drop("depth")


def format_paths(paths: DataFrame, turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss_starts, loss_ends), one row per path.

    ``turns`` has tree, node, role and text.
    """
    texts = turns.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = (
        paths.join(texts, ["tree", "node"])
        .groupBy("tree", "leaf", "rank", "score")
        .agg(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text")).alias("turns"))
        .withColumn("turns", F.array_sort("turns"))
    )
    schema = "tree string, leaf long, rank int, score double, formatted string, loss_starts array<long>, loss_ends array<long>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [render([(t["role"], t["text"]) for t in turns], loss_role) for turns in frame.pop("turns")]
            for i, name in enumerate(("formatted", "loss_starts", "loss_ends")):
                frame[name] = pd.Series([m[i] for m in made], index=frame.index, dtype=object)
            yield frame

    return gathered.mapInPandas(run, schema)
