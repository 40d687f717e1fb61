"""What filters remove together: every order of a set of filters at once, by min-plus removal ranks.

A document's failed filters are a row of a mask matrix: 0 where it fails a filter, infinity where it passes.
An order of the filters is a column of a position matrix: the inverse permutation, i.e. the step at which each filter is
applied. The min-plus product of the two is the step at which the document is removed, or infinity. Documents with equal masks share a
row, so Spark counts documents per part and mask, and one small product per part, with the counts scattered to their steps,
gives what every order keeps, removes and finds removed already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkaudit.functions.binding import let
from linkaudit.llm.common import stored

#: The filters by letter, in the order of the bits of a mask.
LETTERS = "ABCDE"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> Column:
    """The bits of the first four filters that a text (not null) fails; see ``report``."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))

    def bits(found: Column) -> Column:
        n, distinct = F.size(found), F.size(F.array_distinct(found))
        fails = [n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
        return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))

    return let(words, bits).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of a part by the set of filters they fail, and how many of them are labelled so.

    The last filter fails for a text that a smaller id has, too. Only ids and digests are shuffled, summed up first: a text
    that very many documents share is one row per task and id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    rows = narrow.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.where(f"{id_col} IS NOT NULL").groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marks = marks.where("good = 1 OR toxic = 1")
    known = rows.join(marks, "id", "left").select("id", "part", "mask", "digest", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
    known = stored(known, "masks")
    least = known.groupBy("digest").agg(F.min("id").alias("least"))
    of = least.select(F.col("digest").alias("of"), "least")
    # rows that have a text first: by id and digest, so that a text of very many ids is not one key
    first = known.join(of, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")), "left_semi")
    counts, failing = ["n", "good", "toxic"], F.col("mask").bitwiseOR(F.lit(1 << (len(LETTERS) - 1))).alias("mask")
    back = first.select("part", F.explode(F.array(F.struct("mask", F.lit(1).alias("by")), F.struct(failing, F.lit(-1).alias("by")))).alias("x"), *counts)
    back = back.select("part", "x.mask", *[(F.col(c) * F.col("x.by")).alias(c) for c in counts])
    total = known.select("part", failing, *counts).unionByName(back).groupBy("part", "mask")
    return total.agg(*[F.sum(c).cast("long").alias(c) for c in counts]).where("n > 0")


def removal_steps(letters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of the letters, the positions of the letters in each (order, letter), and the step (mask, order) at which a
    mask is removed, counted from 0; the number of letters where it is not."""
    k = len(letters)
    orders = list(permutations(range(k)))
    position = np.argsort(np.array(orders), axis=1)
    masks = np.where((np.arange(1 << k)[:, None] >> np.arange(k)) & 1, 0, k)
    step = np.full((1 << k, len(orders)), k)
    for f in range(k):  # the min-plus product, one filter at a time
        step = np.minimum(step, masks[:, f, None] + position[None, :, f])
    return ["".join(letters[f] for f in o) for o in orders], position, step


def part_table(weights: np.ndarray, letters: str = LETTERS) -> dict[str, np.ndarray]:
    """The counts of one part for every order and step, from documents, good and toxic ones per mask (3 rows)."""
    k = len(letters)
    names, position, step = removal_steps(letters)
    order = np.argsort(position, axis=1)
    n_orders = len(names)
    fails = ((np.arange(1 << k)[:, None] >> np.arange(k)) & 1).astype(bool)
    place = (np.arange(n_orders)[None, :], step)
    gone = np.zeros((3, n_orders, k + 1), dtype=np.int64)
    for row, w in zip(gone, weights):
        np.add.at(row, place, np.broadcast_to(w[:, None], step.shape))
    removed = gone[0, :, :k]
    failing = (weights[0][:, None] * fails).sum(axis=0)  # documents per filter, whatever else they fail
    only = np.array([weights[0][1 << f] for f in range(k)])
    shapley = np.zeros(k, dtype=np.int64)
    np.add.at(shapley, order, removed)
    return {
        "kept": weights[0].sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": failing[order] - removed,
        "unique_fails": only[order], "good_lost": gone[1, :, :k], "toxic_lost": gone[2, :, :k], "shapley": shapley[order],
    }


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(LETTERS)
    names, _, _ = removal_steps(LETTERS)
    orders, steps = np.repeat(names, k), np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))
    for batch in batches:
        for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            weights = np.zeros((3, 1 << k), dtype=np.int64)
            for e in entries:
                weights[:, e["mask"]] = e["n"], e["good"], e["toxic"]
            table = part_table(weights)
            columns = [pa.array([part] * len(orders)), pa.array(orders.tolist()), pa.array(steps), *[pa.array(table[c].ravel()) for c in _COUNTS]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *_COUNTS])


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with the documents of the part that are ``kept`` after the step, ``removed``
    by it, ``redundant`` (fail its filter but are gone), ``unique_fails`` (fail its filter only), ``good_lost`` and ``toxic_lost`` (removed by it
    and labelled so), and ``shapley``: what its filter removes, summed over all orders.

    A text fails A with fewer than 200 words, B if less than half of its words are distinct, C if more than 2 % of its characters are
    A-Z, D if it holds any of ``#$%&*|``, and E if a smaller id has the same text. Null texts and sources are empty ones.
    Repeated rows are documents of their own, which fail E only by a smaller id; a null id counts as larger than any other. Several labels of an id
    count as one that has what any of them has; null labels mark nothing. An empty table gives an empty result; further columns are ignored.
    """
    entry = F.struct("mask", "n", "good", "toxic")
    # at most as many entries as there are masks
    parts = mask_counts(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(entry).alias("entries"))
    kinds = ", ".join(f"{c} long" for c in _COUNTS)
    return parts.mapInArrow(_tables, f"part string, filter_order string, step int, {kinds}")
