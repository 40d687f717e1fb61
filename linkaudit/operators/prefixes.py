"""Which texts begin others: one ordered sweep over both, sorted together.

In the order of their bytes all texts that begin with a prefix follow it without a gap, so prefixes are nested intervals. Prefixes and
points are dealt by ranges of that order and sorted in each range; a sweep keeps the prefixes that are open, which are those of
the point at hand. What is open where a range begins is found from the first texts of the ranges. Nothing is cut to lengths,
and texts of one very large group are dealt to many ranges like any others.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import cut_lineage

_KIND = "_kind"


def _key(group: str, text: str) -> tuple[bytes, bytes]:
    return group.encode(), text.encode()


def _first_text(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict(
                {"part": [TaskContext.get().partitionId()], "group": [batch.column("group")[0].as_py()], "text": [batch.column("text")[0].as_py()]}
            )
            return


def _open_at(firsts: list[tuple[int, str, str]]):
    """Finds for each range the prefixes of earlier ranges that its first text begins with."""
    keys = [_key(g, t) for _, g, t in firsts]

    def run(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            found = []
            for group, text in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist()):
                name, start = _key(group, text)
                at = bisect_left(keys, (name, start))
                while at < len(keys) and keys[at][0] == name and keys[at][1].startswith(start):
                    if firsts[at][0] > part:
                        found.append((firsts[at][0], text))
                    at += 1
            if found:
                parts, texts = zip(*found)
                yield pa.RecordBatch.from_pydict({"part": list(parts), "text": list(texts)})

    return run


def _sweep(opened: dict[int, tuple[str, list[str]]]):
    def run(batches):
        group, stack = opened.get(TaskContext.get().partitionId(), (None, []))
        stack = list(stack)
        for batch in batches:
            rows, prefixes = [], []
            columns = (batch.column(name).to_pylist() for name in ("group", "text", _KIND))
            for row, (name, text, kind) in enumerate(zip(*columns)):
                if name != group:
                    group, stack = name, []
                while stack and not text.startswith(stack[-1]):
                    stack.pop()
                if kind:
                    rows += [row] * len(stack)
                    prefixes += stack
                elif not stack or stack[-1] != text:
                    stack.append(text)
            if rows:
                found = batch.take(pa.array(rows, pa.int64()))
                names = [n for n in batch.schema.names if n != _KIND]
                yield pa.RecordBatch.from_arrays([*(found.column(n) for n in names), pa.array(prefixes, pa.string())], names=[*names, "prefix"])

    return run


def beginning(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows of ``points (group, text, ...)`` once for each text of ``prefixes (group, text)`` in the same group that begins theirs, as ``prefix``.

    Groups and texts are strings; rows without them match nothing, as do points without a prefix. Equal prefixes count once. The driver holds
    a text for each range of the sorted table and the few prefixes that are open there.
    """
    present = "group IS NOT NULL AND text IS NOT NULL"
    both = points.where(present).withColumn(_KIND, F.lit(1)).unionByName(
        prefixes.where(present).select("group", "text").distinct().withColumn(_KIND, F.lit(0)), allowMissingColumns=True
    )
    order = ["group", "text", _KIND]
    swept = cut_lineage(both.repartitionByRange(*order).sortWithinPartitions(*order))
    firsts = swept.select("group", "text").mapInArrow(_first_text, "part long, group string, text string").collect()
    firsts = sorted((tuple(r) for r in firsts), key=lambda f: f[0])
    opened: dict[int, tuple[str, list[str]]] = {}
    if len(firsts) > 1:
        crossing = swept.where(F.col(_KIND) == 0).select("group", "text").mapInArrow(_open_at(firsts), "part long, text string")
        groups = {part: group for part, group, _ in firsts}
        for r in crossing.collect():
            opened.setdefault(r["part"], (groups[r["part"]], []))[1].append(r["text"])
        for _, texts in opened.values():
            texts.sort(key=len)
    fields = [f for f in both.schema.fields if f.name != _KIND]
    return swept.mapInArrow(_sweep(opened), StructType([*fields, StructField("prefix", StringType())]))
