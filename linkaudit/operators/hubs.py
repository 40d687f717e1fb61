"""What a few vectors tell about the density and the clusters of all.

Some vectors are compared with all others before any two blocks are, by one pass over the table. Their own density is exact then. A vector that they
alone make a core is one for certain, and all cores within reach of a hub that is a core belong together. In a table with one large cluster
nearly all vectors are settled so, and only pairs with one of the others are left to compare.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .cells import matrix

#: Vectors that all others are compared with, and vectors of a batch that are compared with them at once.
HUBS, ROWS_AT_ONCE = 512, 4096


def roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each group after the groups of ``a`` and ``b`` are joined; ``root`` has those of the groups so far."""
    while True:
        low = np.minimum(root[a], root[b])
        lower = root.copy()
        np.minimum.at(lower, a, low)
        np.minimum.at(lower, b, low)
        np.minimum.at(lower, root[a], low)
        np.minimum.at(lower, root[b], low)
        lower = lower[lower]
        if (lower == root).all():
            return root
        root = lower


def _compared(batches, points: np.ndarray, search):
    """``(ids, weights, near)`` of some vectors, ``near`` tells which hubs are within reach of each."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(at, ROWS_AT_ONCE)
            yield some.column("id"), np.asarray(some.column("weight"), dtype="float64"), search.hits(matrix(some.column("unit")) @ points.T)


def _weighed(points: np.ndarray, search):
    def run(batches):
        total = np.zeros(len(points))
        for _, weights, near in _compared(batches, points, search):
            total += weights @ near
        yield pa.RecordBatch.from_pydict({"hub": np.arange(len(points)), "weight": total})

    return run


def _settled(points: np.ndarray, weights: np.ndarray, search, min_samples: int):
    def run(batches):
        root, none = np.arange(len(points)), pa.nulls
        for ids, own, near in _compared(batches, points, search):
            known = near.any(axis=1) & (own + near @ weights >= min_samples)
            near, first = near[known], near[known].argmax(axis=1)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(known)), pa.array(first), none(len(first), pa.int64())], names=["id", "a", "b"])
            for hub in np.unique(first):
                others = np.flatnonzero(near[first == hub].any(axis=0))
                if (root[others] != root[hub]).any():
                    root = roots(root, np.full(len(others), hub), others)
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([none(len(moved), pa.string()), pa.array(moved), pa.array(root[moved])], names=["id", "a", "b"])

    return run


def settled(places: DataFrame, search, min_samples: int) -> DataFrame:
    """``(id, name)``: vectors of ``places (id, unit, weight)`` that are cores for certain, ``name`` the smallest id of those known to be of one cluster.

    Not all cores, and not all that belongs together: what is said holds, what is not said is open. The driver holds ``HUBS`` vectors.
    """
    hubs = places.select("id", "unit", "weight").orderBy(F.xxhash64("id"), "id").limit(HUBS).collect()
    nothing = places.select("id", F.col("id").alias("name")).limit(0)
    if not hubs:
        return nothing
    points, weights = np.array([h["unit"] for h in hubs]), np.array([h["weight"] for h in hubs], dtype="float64")
    rows = places.select("id", "unit", "weight")
    # a hub is within its own reach
    density = rows.mapInArrow(_weighed(points, search), "hub long, weight double").groupBy("hub").agg(F.sum("weight").alias("weight"))
    cores = sorted(r["hub"] for r in density.where(F.col("weight") >= min_samples).collect())
    if not cores:
        return nothing
    told = cut_lineage(rows.mapInArrow(_settled(points[cores], weights[cores], search, min_samples), "id string, a long, b long"))
    pairs = np.array([(r["a"], r["b"]) for r in told.where("b IS NOT NULL").select("a", "b").distinct().collect()], dtype="int64").reshape(-1, 2)
    root = roots(np.arange(len(cores)), pairs[:, 0], pairs[:, 1])
    group = F.element_at(F.array(*(F.lit(int(r)) for r in root)), F.col("a").cast("int") + 1)
    of = told.where("b IS NULL AND id IS NOT NULL").select("id", group.alias("group"))
    names = of.groupBy("group").agg(F.min("id").alias("name"))
    return cut_lineage(of.join(F.broadcast(names), "group").select("id", "name"))
