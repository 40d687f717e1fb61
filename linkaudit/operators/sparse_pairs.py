"""Which vectors to compare: inverted lists of buckets, for vectors with few numbers that are not zero.

Buckets are ordered by how many vectors have them, rarest first. The prefix of a vector are its first buckets, up to where the rest is too
short to make up for fewer than ``l`` common buckets in both prefixes: if two unit vectors share fewer than ``l`` of them, their product is at most
the length of the ``l - 1`` largest numbers of the shorter-reaching prefix together with what follows it. So partners share ``l`` buckets of their
prefixes, and a list is kept for every set of ``l`` buckets. Each vector asks with the largest ``l``
that gives few sets (its own level) and is listed for all levels below as well; a pair meets at the lower of its two levels, and is counted
in the list of the first buckets that both prefixes share, so in one list only.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .cells import matrix

#: Longest vectors that are taken (a set of buckets is a 64-bit number), and the mean of non-zero numbers up to which lists are used.
MOST_BUCKETS, MOST_FILLED = 64, 16
#: Highest level, and sets of buckets per vector and level up to which a level is used.
MOST_SHARED, MOST_SETS = 4, 24
_SLACK = 1e-7


def fits(units: DataFrame) -> bool:
    """Whether the vectors of ``units (unit)`` are short and mostly zero."""
    filled = F.size(F.filter("unit", lambda x: x != 0))
    row = units.agg(F.max(F.size("unit")).alias("length"), F.avg(filled).alias("filled")).first()
    return row.length is not None and row.length <= MOST_BUCKETS and row.filled <= MOST_FILLED


def _prefixes(numbers: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each level the prefix of each row (rows, levels), as the bits of its buckets, and whether the level exists."""
    squares = numbers**2
    n, width = squares.shape
    largest = np.zeros((n, MOST_SHARED - 1))  # ascending
    mass = np.zeros(n)
    bits = np.zeros((n, MOST_SHARED), dtype=np.uint64)
    done = np.zeros((n, MOST_SHARED), dtype=bool)
    needed = squares.sum(axis=1) - threshold**2 + _SLACK
    for column in range(width):
        x = squares[:, column]
        bit = np.where(x > 0, np.uint64(1) << np.uint64(column), np.uint64(0))
        bits |= np.where(done, np.uint64(0), bit[:, None])
        mass += x
        largest = np.sort(np.column_stack([largest, x]), axis=1)[:, 1:]
        without = np.cumsum(largest[:, ::-1], axis=1)
        for level in range(MOST_SHARED):
            done[:, level] |= mass - (without[:, level - 1] if level else 0) > needed
    # a vector whose whole length is needed has its whole prefix at the first level
    done[:, 0] = True
    return bits, done


def _bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low)
        mask ^= low
    return out


def _listed(order: list[int], threshold: float):
    schema = "id string, key bigint, prefix bigint, asks boolean, open boolean"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                bits, exists = _prefixes(matrix(some.column("unit"))[:, order], threshold)
                ids, keys, prefixes, asks, opens = [], [], [], [], []
                for name, is_open, masks, there in zip(some.column("id").to_pylist(), some.column("open").to_pylist(), bits.tolist(), exists.tolist()):
                    sets = [_bits(m) for m in masks]
                    own = 1
                    while own < MOST_SHARED and there[own] and comb(len(sets[own]), own + 1) <= MOST_SETS:
                        own += 1
                    for level in range(1, own + 1):
                        found = [sum(c) for c in combinations(sets[level - 1], level)]
                        ids += [name] * len(found)
                        keys += found
                        prefixes += [masks[level - 1]] * len(found)
                        asks += [level == own] * len(found)
                        opens += [is_open] * len(found)
                columns = [pa.array(ids, pa.string()), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (keys, prefixes)), pa.array(asks, pa.bool_()), pa.array(opens, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "prefix", "asks", "open"])

    return run, schema


def met_first(left: dict, right: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of a list are counted there: it is that of the first buckets they share, and one of the two asks at this level."""
    key = np.asarray(left["key"]).view(np.uint64)[i]
    common = np.asarray(left["prefix"]).view(np.uint64)[i] & np.asarray(right["prefix"]).view(np.uint64)[j]
    rest, wanted = common.copy(), np.bitwise_count(key)
    for _ in range(MOST_SHARED):
        # as many of the lowest bits are cleared as the key has
        rest &= np.where(np.bitwise_count(common ^ rest) < wanted, rest - (rest > 0), rest)
    return ((common ^ rest) == key) & (np.asarray(left["asks"])[i] | np.asarray(right["asks"])[j])


def dealt_to_lists(units: DataFrame, threshold: float, block_rows: int, with_units: bool = True) -> DataFrame:
    """``(id, unit, key, prefix, asks, bin, low, high, right)``: vectors as they are sent to the blocks they are compared in.

    Short lists share a block; a long one is a block by itself, or several, where vectors that only listen meet those that ask. Where ``units`` have
    ``open``, two vectors that are not open need not meet: lists without open ones are left out, and where fewer are open than ask, only these meet all.
    Without ``with_units`` the vectors themselves are left out.
    """
    filled = units.select(F.posexplode("unit").alias("bucket", "x")).where("x <> 0").groupBy("bucket").count()
    counts = {r["bucket"]: r["count"] for r in filled.collect()}  # a row per bucket
    length = units.agg(F.max(F.size("unit"))).first()[0]
    order = sorted(range(length), key=lambda b: (counts.get(b, 0), b))
    run, schema = _listed(order, threshold)
    is_open = F.col("open") if "open" in units.columns else F.lit(True)
    listed = units.select("id", "unit", is_open.alias("open")).mapInArrow(run, schema)
    number = {name: F.sum(F.col(of).cast("bigint")).alias(name) for name, of in (("asking", "asks"), ("opened", "open"))}
    lists = listed.groupBy("key").agg(*number.values(), F.count(F.lit(1)).alias("n"))
    lists = lists.where("asking > 0 AND opened > 0 AND n > 1").withColumn("by_open", F.col("opened") < F.col("asking"))
    lists = lists.withColumn("asking", F.least("opened", "asking"))
    short = F.col("n") <= block_rows // 4
    rows_in_short = lists.agg(F.sum(F.when(short, F.col("n")))).first()[0] or 0
    bins = max(1, -(-rows_in_short // block_rows))
    lists = lists.select(
        "key", "by_open", short.alias("short"), F.when(short, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key")).alias("bin"),
        F.when(short, F.lit(1)).otherwise(F.ceil(F.col("asking") / block_rows)).cast("int").alias("ask_parts"),
        F.when(short, F.lit(0)).otherwise(F.ceil((F.col("n") - F.col("asking")) / block_rows)).cast("int").alias("other_parts"),
    )
    members = listed.join(lists, "key")
    draw = F.xxhash64("id", F.lit(7))
    meets_all = F.when(F.col("by_open"), F.col("open")).otherwise(F.col("asks"))
    part = F.when(F.col("short"), F.lit(0)).when(meets_all, F.pmod(draw, "ask_parts")).otherwise(F.col("ask_parts") + F.pmod(draw, "other_parts"))
    members = members.withColumn("part", part.cast("int"))
    none = F.array().cast("array<int>")
    last = F.col("ask_parts") + F.col("other_parts") - 1
    asking = F.col("part") < F.col("ask_parts")
    # to the right of the blocks that ask, to the left of all blocks from its own on
    before = F.least(F.col("part"), F.col("ask_parts"))
    as_right = F.when(before > 0, F.sequence(F.lit(0), before - 1)).otherwise(none)
    as_left = F.when(asking, F.sequence("part", last)).otherwise(none)
    sides = F.concat(
        F.transform(as_left, lambda j: F.struct(F.col("part").alias("low"), j.alias("high"), F.lit(False).alias("right"))),
        F.transform(as_right, lambda i: F.struct(i.alias("low"), F.col("part").alias("high"), F.lit(True).alias("right"))),
    )
    sent = members.select("id", "key", "prefix", "asks", "short", "bin", F.explode(sides).alias("side"))
    sent = sent.select("id", "key", "prefix", "asks", "short", "bin", "side.*")
    return sent.join(units.select("id", "unit").hint("merge"), "id") if with_units else sent
