"""Conversations from reply trees: the best branches of each tree, each formatted as one text with a loss mask.

Trees are tables of nodes with their parents. Self-joins double the distance a pointer spans with each round, so paths of any
length take a number of rounds that grows with its logarithm: first every node learns the sum of the scores
above it, then the leaves are ranked, then the paths of the chosen leaves are enumerated.

The template writes a turn as ``<|im_start|>role`` newline ``text<|im_end|>`` newline. In roles and texts every backslash is
doubled and a backslash is put behind the first character of each control string, and in roles before each line break,
so no text can end or begin a turn, and reading a backslash together with the character behind it
restores the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkaudit.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that common chat templates and vocabularies treat as marks.
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_MARK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(rf"{re.escape(START)}((?:[^\\\n]|\\.)*)\n", re.DOTALL)
FORMATTED = "struct<text:string,loss:array<struct<start:bigint,end:bigint>>>"


def escaped(text: str) -> str:
    return _MARK.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: Iterable[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the spans, in code points, of the texts under the loss mask."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role).replace(chr(10), chr(92) + chr(10))}\n", escaped(text)
        if role == learned:
            loss.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    turns = []
    for part in formatted.split(f"{END}\n")[:-1]:
        head = _ROLE.match(part)
        turns.append((unescaped(head[1]), unescaped(part[head.end() :])))
    return turns


def _same(conv: str, other_conv: str, node: str, other: str) -> Column:
    return F.col(conv).eqNullSafe(F.col(other_conv)) & (F.col(node) == F.col(other))


def _lifted(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every node with the number of nodes (``depth``) and the sum of scores (``total``) from its root to itself, and the pointers
    to the ancestors 1, 2, 4, ... steps above. Nodes in or below a circle have no root and are left out."""
    known = nodes.select(F.col("conv").alias("conv_2"), F.col("node").alias("node_2"), F.lit(True).alias("there"))
    first = nodes.join(known, _same("conv", "conv_2", "parent", "node_2"), "left")
    state = first.select("conv", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    state = stored(state, "pointers")
    done, going = state.where("up IS NULL"), state.where("up IS NOT NULL")
    pointers, rounds = [], math.ceil(math.log2(max(2, state.count()))) + 1
    while not going.isEmpty() and len(pointers) < rounds:
        pointers.append(going.select("conv", "node", "up"))
        above = done.union(going).select(*[F.col(c).alias(f"{c}_2") for c in ("conv", "node", "up", "total", "depth")])
        # only nodes that have not seen their root are joined: a long conversation does not make the short ones take its rounds
        lifted = going.join(above, _same("conv", "conv_2", "up", "node_2")).select(
            "conv", "node", F.col("up_2").alias("up"), (F.col("total") + F.col("total_2")).alias("total"), (F.col("depth") + F.col("depth_2")).alias("depth")
        )
        lifted = stored(lifted, "pointers")
        done, going = done.union(lifted.where("up IS NULL")), lifted.where("up IS NOT NULL")
    return done.select("conv", "node", "total", "depth"), pointers


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``conv``, ``leaf``, ``rank``, ``node``, ``above`` (steps from the leaf up) for the best root-to-leaf paths of each conversation.

    ``nodes`` has ``conv``, ``node`` (its own within the conversation), ``parent`` (null or unknown: a root) and ``score``. Branches are ranked
    by the mean score of their nodes, then by the smaller leaf. The table must be stable.
    """
    lifted, pointers = _lifted(nodes)
    parents = nodes.select(F.col("conv").alias("conv_2"), F.col("parent").alias("node_2"))
    leaves = lifted.join(parents, _same("conv", "conv_2", "node", "node_2"), "left_anti")
    order = Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = stored(ranked.select("conv", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("above")), "paths")
    for k, pointer in enumerate(pointers):
        step = pointer.select(F.col("conv").alias("conv_2"), F.col("node").alias("node_2"), "up")
        further = paths.join(step, _same("conv", "conv_2", "node", "node_2")).select("conv", "leaf", "rank", F.col("up").alias("node"), (F.col("above") + 2**k).alias("above"))
        paths = stored(paths.union(further), "paths")
    return paths


def formatted_column(turns: Column, learned: str = "assistant") -> Column:
    """Formats an array of structs with ``role`` and ``text``; nulls are empty."""
    kind = pa.struct([("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    @F.arrow_udf(FORMATTED)
    def formatted(paths: pa.Array) -> pa.Array:
        out = []
        for path in paths:
            text, loss = format_turns([(t["role"] or "", t["text"] or "") for t in path.as_py()], learned)
            out.append({"text": text, "loss": [{"start": a, "end": b} for a, b in loss]})
        return pa.array(out, type=kind)

    return formatted(turns)


def format_trees(nodes: DataFrame, branches: int = 1, learned: str = "assistant") -> DataFrame:
    """``conv``, ``leaf``, ``rank`` and ``formatted`` (``text`` and ``loss``, spans in code points) for the best branches of each conversation.

    ``nodes`` has the columns of ``best_paths`` and ``role`` and ``text``. Each path is one row, as each is one conversation.
    """
    nodes = stored(nodes.select("conv", "node", "parent", "score", "role", "text"), "nodes")
    paths = best_paths(nodes.select("conv", "node", "parent", "score"), branches)
    said = nodes.select(F.col("conv").alias("conv_2"), F.col("node").alias("node_2"), "role", "text")
    turns = paths.join(said, _same("conv", "conv_2", "node", "node_2"))
    turn = F.struct((-F.col("above")).alias("place"), F.col("role").alias("role"), F.col("text").alias("text"))
    whole = turns.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    slim = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select("conv", "leaf", "rank", formatted_column(slim, learned).alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and masks say: ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    @F.arrow_udf("struct<n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint>")
    def read(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            text, loss = row.as_py().values()
            turns = read_turns(text)
            learned = "".join(unescaped(text[s["start"] : s["end"]]) for s in loss)
            values = len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), len(text)
            out.append({name: v for (name, _), v in zip(fields, values)})
        return pa.array(out, type=pa.struct(fields))

    return formatted.withColumn("__read", read("formatted")).select("conv", "leaf", "rank", "__read.*")


def chains(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of conversations without branches: each row replies to the one before it by turn (null first), then role, then text."""
    named = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    numbered = named.withColumn("node", place)
    return numbered.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def report(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, read back from the formatted text: its id and the columns of ``read_back``.

    Null roles and texts are empty; rows with equal turns follow each other by role and text; repeated rows are turns of their own;
    rows with a null id are one conversation; an empty table gives an empty result; further columns are ignored.
    """
    out = read_back(format_trees(chains(turns, conv, turn, role, text)))
    return out.drop("leaf", "rank").withColumnRenamed("conv", conv)
