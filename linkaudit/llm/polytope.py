"""Embedding near-duplicates by cross-polytope hashing.

A unit vector is rotated by random signs and a fast Hadamard transform, three times; its hash is the nearest of
the axes and their opposites. Several such hashes make the key of a table, and there are several tables. Each vector is stored in its
own bucket of every table and looked up there and in the next nearest ones. Pairs that meet are
verified by their cosine in double precision, so no link is wrong; a pair that meets nowhere is missed.
The more hashes a key has, the less often a pair meets in a table. There are as many tables as pairs at the threshold
need to be missed no more often than ``MISSED``, counted with random pairs under the rotations in use, so recall is the same
for tables of any size.

Equal vectors are one class throughout; its links count with the number of its vectors.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkaudit.llm.common import stored
from linkaudit.llm.components import components

_SEED = 20_240_607
#: Share of the pairs at the threshold that may meet in no table.
MISSED = 0.001
#: A key has fewer hashes where more would need more tables than this, or try more combinations of axes than 3 ** _MOST_PARTS.
_MOST_TABLES, _MOST_PARTS = 512, 6
#: Tables whose keys are made in one row.
_AT_ONCE = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform along the last axis, whose length is a power of two."""
    x, width = x.copy(), 1
    while width < x.shape[-1]:
        halves = x.reshape(*x.shape[:-1], -1, 2, width)
        x = np.stack([halves[..., 0, :] + halves[..., 1, :], halves[..., 0, :] - halves[..., 1, :]], axis=-2).reshape(x.shape)
        width *= 2
    return x


def padded(length: int) -> int:
    """The power of two that vectors of a length are padded to."""
    return 1 << max(1, math.ceil(math.log2(max(2, length))))


def kind(length: int) -> int:
    """Vectors of lengths of one kind have the same keys: the length itself where there are few rotations, else the padded length."""
    return max(2, length) if length <= 16 else padded(length)


def rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """Unit vectors, padded to a power of two, after the rotation of a hash."""
    size = padded(x.shape[1])
    signs = np.random.default_rng([_SEED, x.shape[1], table, part]).choice([-1.0, 1.0], size=(3, size))
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    for s in signs:
        out = hadamard(out * s) / math.sqrt(size)
    return out


def table_keys(x: np.ndarray, table: int, parts: int, probes: int, near: int = 3) -> np.ndarray:
    """Keys of the ``probes`` nearest buckets of a table for the rows of ``x``; the first is the row's own. Without hashes there is one bucket."""
    if parts == 0:
        return np.full((len(x), 1), x.shape[1] * 1_000_003 + table + 1, dtype=np.int64)
    vertices, costs = [], []
    for part in range(parts):
        y = rotated(x, table, part)
        size = np.abs(y)
        axes = np.argsort(-size, axis=1, kind="stable")[:, :near]
        best = np.take_along_axis(size, axes, axis=1)
        vertices.append(2 * axes + (np.take_along_axis(y, axes, axis=1) < 0))
        costs.append((best[:, :1] - best) ** 2)
    choices = list(product(range(vertices[0].shape[1]), repeat=parts))
    cost = np.stack([sum(c[:, k] for c, k in zip(costs, choice)) for choice in choices], axis=1)
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    with np.errstate(over="ignore"):
        keys = []
        for choice in choices:
            key = np.full(len(x), np.uint64(x.shape[1] * 1_000_003 + table + 1), dtype=np.uint64)
            for part, k in enumerate(choice):
                key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (vertices[part][:, k].astype(np.uint64) + np.uint64(part + 1))
            keys.append(key)
    return np.take_along_axis(np.stack(keys, axis=1), order, axis=1).view(np.int64)


def pairs_at(cosine: float, pairs: int, length: int, seed: int = _SEED) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and for each a partner at exactly this cosine."""
    rng = np.random.default_rng([seed, length])
    x, other = rng.normal(size=(2, pairs, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * other


def meet(x: np.ndarray, y: np.ndarray, table: int, parts: int, probes: int) -> np.ndarray:
    """Whether the rows of ``x`` and ``y`` meet in a table: one is stored in a bucket where the other is looked up."""
    a, b = table_keys(x, table, parts, probes), table_keys(y, table, parts, probes)
    return (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)


@lru_cache(maxsize=256)
def tables_needed(threshold: float, length: int, parts: int, probes: int) -> int | None:
    """The number of tables in which all but ``MISSED`` of the pairs at the threshold meet; None above ``_MOST_TABLES``.

    It is counted up to a quarter of that share, as other pairs than those that are counted fare a little worse.
    """
    pairs = max(1000, min(4000, (1 << 20) // length))
    x, y = pairs_at(min(1.0, max(-1.0, threshold)), pairs, length)
    for table in range(_MOST_TABLES):
        apart = ~meet(x, y, table, parts, probes)
        x, y = x[apart], y[apart]
        if len(x) <= MISSED * pairs / 4:
            return table + 1
        if table == 0 and len(x) / pairs > MISSED ** (1 / _MOST_TABLES):
            return None
    return None


def scheme(n: int, length: int, threshold: float, tables: int, probes: int, parts: int | None = None) -> tuple[int, int]:
    """Hashes per key and number of tables, at least ``tables``, for ``n`` vectors of a kind of length.

    There are as many hashes as give each vector a bucket of its own, or fewer where that would need too many tables. Where
    no number of tables does, as for thresholds near and below 0, all vectors meet in one bucket.
    """
    if parts is not None:
        needed = tables_needed(threshold, length, parts, probes)
        if needed is None:
            raise ValueError(f"{parts} hashes per key need more than {_MOST_TABLES} tables at a threshold of {threshold}")
        return parts, max(tables, needed)
    for k in range(min(_MOST_PARTS, max(1, math.ceil(math.log(max(2, n)) / math.log(2 * padded(length))))), 0, -1):
        needed = tables_needed(threshold, length, k, probes)
        if needed is not None:
            return k, max(tables, needed)
    return 0, 1


def unit(vector: np.ndarray | None) -> bytes | None:
    """The vector scaled to length one, as bytes of doubles; None if it is null, zero or not finite."""
    if vector is None or not len(vector) or not np.isfinite(vector).all():
        return None
    largest = np.abs(vector).max()
    if largest == 0:
        return None
    scaled = vector / largest
    return (scaled / np.linalg.norm(scaled) + 0.0).tobytes()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def unit_column(vector: Column) -> Column:
    """The unit vector and, as the name of its class, a digest of the vector itself."""

    @F.arrow_udf("struct<unit:binary,name:string>")
    def units(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            numbers = v.as_py()
            values = None if numbers is None or None in numbers else np.array(numbers, dtype=np.float64) + 0.0
            u = unit(values)
            out.append({"unit": u, "name": None if u is None else hashlib.blake2b(values.tobytes(), digest_size=16).hexdigest()})
        return pa.array(out, type=pa.struct([("unit", pa.binary()), ("name", pa.string())]))

    return units(vector)


def bucket_column(units: Column, first: Column, schemes: dict[int, tuple[int, int]], probes: int) -> Column:
    """An array for each table, from ``first`` on and ``_AT_ONCE`` at most, with the keys of the nearest buckets."""

    @F.arrow_udf("array<array<bigint>>")
    def buckets(column: pa.Array, firsts: pa.Array) -> pa.Array:
        lengths = np.array([len(u.as_py()) // 8 for u in column])
        starts = firsts.to_numpy(zero_copy_only=False)
        out: list = [None] * len(column)
        for length, start in set(zip(lengths.tolist(), starts.tolist())):
            rows = np.nonzero((lengths == length) & (starts == start))[0]
            x = _matrix(column.take(pa.array(rows)))
            parts, tables = schemes[kind(length)]
            keys = np.stack([table_keys(x, t, parts, probes) for t in range(start, min(tables, start + _AT_ONCE))], axis=1)
            for row, k in zip(rows, keys.tolist()):
                out[row] = k
        return pa.array(out, type=pa.list_(pa.list_(pa.int64())))

    return buckets(units, first)


def cosine_column(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(np.array([np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64) for x, y in zip(left.to_pylist(), right.to_pylist())], dtype=np.float64))

    return cosine(a, b)


def class_links(classes: DataFrame, threshold: float, tables: int, probes: int, parts: int | None) -> DataFrame:
    """Verified pairs ``a < b`` of classes (``class``, ``unit``, ``size`` in bytes) that meet in a bucket."""
    counts: dict[int, int] = {}
    for r in classes.groupBy((F.length("unit") / 8).cast("int").alias("length")).count().collect():
        counts[kind(r["length"])] = counts.get(kind(r["length"]), 0) + r["count"]
    schemes = {length: scheme(n, length, threshold, tables, probes, parts) for length, n in counts.items()}
    last = F.lit(0)
    for length in sorted(schemes, reverse=True):
        last = F.when(F.length("unit") <= 8 * length, F.lit(schemes[length][1] - 1)).otherwise(last)
    each = classes.select("class", "unit", F.explode(F.sequence(F.lit(0), last, F.lit(_AT_ONCE))).alias("first"))
    keyed = stored(each.select("class", bucket_column(F.col("unit"), F.col("first"), schemes, probes).alias("keys")), "buckets")
    index = keyed.select(F.col("class").alias("b"), F.explode(F.transform("keys", lambda k: k[0])).alias("b_key"))
    probe = keyed.select(F.col("class").alias("a"), F.explode(F.flatten("keys")).alias("a_key"))
    met = probe.join(index, (F.col("a_key") == F.col("b_key")) & (F.col("a") != F.col("b")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = classes.select(F.col("class").alias("a"), F.col("unit").alias("unit_a"))
    right = classes.select(F.col("class").alias("b"), F.col("unit").alias("unit_b"))
    both = pairs.join(left, "a").join(right, "b").where(F.length("unit_a") == F.length("unit_b"))
    return stored(both.where(cosine_column(F.col("unit_a"), F.col("unit_b")) >= threshold).select("a", "b"), "links")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, tables: int = 12, probes: int = 4, parts: int | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept``.

    ``parts`` hashes make a key, by default as many as give each of the vectors a bucket of its own; there are ``tables``
    tables, or more where pairs at the threshold need them (``scheme``). Null and zero
    vectors and those with null or non-finite components have no links and are components of their own. Vectors of unlike
    length have no links with each other. Equal vectors are all linked, also rows with the same id. A null id counts as larger than
    any other and is never kept. An empty table gives an empty result; further columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("id"), unit_column(F.col(vector_col)).alias("u"))
    rows = stored(rows.select("id", "u.unit", "u.name"), "units")
    classes = rows.where("name IS NOT NULL").groupBy("name").agg(F.first("unit").alias("unit"), F.min("id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "vectors")
    links = class_links(classes.select("class", "unit"), threshold, tables, probes, parts)
    sizes = classes.select(F.col("class").alias("b"), "n")
    both = links.union(links.select("b", "a"))
    others = both.join(sizes, "b").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    reached = components(links).withColumnRenamed("id", "class")
    placed = classes.join(reached, "class", "left").join(others, "class", "left")
    placed = stored(placed.select("name", "least", "n", "others", F.coalesce("component", "class").alias("component")), "placed")
    first = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(first, "component").select("name", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    named = stored(named, "named")
    # rows without a class keep a name of their own out of the join
    out = rows.select("id", "name").join(named, "name", "left")
    component = F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
