"""A tree of pivots over vectors, and which of its cells can hold partners.

A cell with more vectors than a block is split: some of its vectors become pivots, and each vector goes to the nearest. So every
vector meets a bounded number of pivots per level, and the levels grow with the logarithm of the table. Nodes are rows of a
table (cell, parent, pivot, radius); neither the driver nor a task holds the pivots of more than one cell.

Pairs of cells descend from the root together. By the triangle inequality of angles two cells can hold partners only if their
pivots are no farther apart than the search angle and both radii, and children of cells that are too far apart are never looked at.
And where two paths part, each vector went to the nearest of the pivots there: a partner on the other path is nearer to its own pivot, so
a vector that is farther from that pivot than from its own by more than twice the search angle has no partner there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import dot
from ..session import cut_lineage

#: Most children of a cell.
FAN = 64
#: Vectors that are compared with the pivots of their cell in one task, and neighbouring cells with one cell's vectors.
SLICE, NEIGHBOURS = 1 << 14, 1024
#: Most levels; from ``BY_HASH`` on vectors that pivots do not part are dealt by a hash.
LEVELS, BY_HASH = 9, 6
_DRAWS = 1 << 40


@dataclass(frozen=True)
class PivotTree:
    """``vectors (id, unit, cell)`` with the leaf of each; ``levels`` of nodes ``(parent, cell, pivot, radius)``,
    where a node that is not split any further is its own child."""

    vectors: DataFrame
    levels: list[DataFrame] = field(default_factory=list)


def matrix(column) -> np.ndarray:
    """A list column as a matrix, without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_DRAWS))


def _spread(_, drawn):  # no type hints: Spark reads them as a choice of interface
    """Pivots among the vectors drawn from a cell, a few hundred at most: most of them far from each other, so that groups far apart
    have pivots of their own, the others as they were drawn, so that single vectors far off do not take all."""
    drawn = drawn.sort_by([("draw", "ascending"), ("id", "ascending")])
    rows, wanted = matrix(drawn["unit"]), min(len(drawn), drawn["children"][0].as_py())
    taken, apart = [0], _angles(rows, rows[:1])[:, 0]
    while len(taken) < max(2, 3 * wanted // 4) and len(taken) < wanted and apart.max() > 1e-9:
        taken.append(int(apart.argmax()))
        apart = np.minimum(apart, _angles(rows, rows[taken[-1:]])[:, 0])
    taken += [r for r in range(len(rows)) if r not in set(taken)][: wanted - len(taken)]
    kept = drawn.take(pa.array(taken))
    return pa.table({"cell": kept["cell"], "slices": kept["slices"], "at": np.arange(len(taken)), "pivot": kept["unit"]})


def _nearest(fan: int, by_hash: bool):
    def run(_, vectors, pivots):  # no type hints: Spark reads them as a choice of interface
        order = np.argsort(np.asarray(pivots["at"]))
        points, at = matrix(pivots["pivot"])[order], np.asarray(pivots["at"])[order]
        children, angles = [np.empty(0, "int64")], [np.empty(0)]
        rows, draws = matrix(vectors["unit"]), np.asarray(vectors["draw"])
        for low in range(0, len(rows), 1024):
            a = _angles(rows[low : low + 1024], points)
            child = (draws[low : low + 1024] >> 20) % len(points) if by_hash else a.argmin(axis=1)
            children.append(at[child])
            angles.append(a[np.arange(len(a)), child])
        cell = np.asarray(vectors["cell"]) * fan + np.concatenate(children)
        return pa.table({"id": vectors["id"], "unit": vectors["unit"], "cell": cell, "angle": np.concatenate(angles)})

    return run


def pivot_tree(units: DataFrame, block_rows: int, fan: int = FAN) -> PivotTree:
    """The tree of ``units (id, unit)``, which must be cheap to read twice and have unique ids; leaves hold up to ``block_rows``."""
    vectors = units.select("id", "unit", F.lit(1).cast("bigint").alias("cell"))
    tree = PivotTree(vectors)
    for depth in range(LEVELS):
        large = tree.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows)
        # a cell only just too large gets few children
        children = F.least(F.lit(fan), F.ceil(F.col("n") / block_rows))
        large = cut_lineage(large.select("cell", "n", children.alias("children"), F.ceil(F.col("n") / SLICE).alias("slices")))
        if large.isEmpty():
            break
        members = tree.vectors.join(large, "cell", "left").withColumn("draw", _draw(depth))
        split = members.where("n IS NOT NULL")
        # about eight times as many as wanted
        few = split.where(F.col("draw") < 8 * F.col("children") / F.col("n") * _DRAWS)
        chosen = few.select("cell", "slices", "children", "draw", "id", "unit").groupBy("cell").applyInArrow(_spread, "cell bigint, slices bigint, at bigint, pivot array<double>")
        pivots = cut_lineage(chosen)
        slices = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))
        offered = pivots.select(F.col("cell").alias("at_cell"), "at", "pivot", slices.alias("at_slice"))
        dealt = split.select("id", "unit", "cell", "draw", F.pmod("draw", "slices").alias("slice"))
        placed = cut_lineage(
            dealt.groupBy("cell", "slice")
            .cogroup(offered.groupBy("at_cell", "at_slice"))
            .applyInArrow(_nearest(fan, depth >= BY_HASH), "id string, unit array<double>, cell bigint, angle double")
        )
        radius = placed.groupBy("cell").agg(F.max("angle").alias("radius"))
        nodes = pivots.select(F.col("cell").alias("parent"), (F.col("cell") * fan + F.col("at")).alias("cell"), "pivot")
        level = nodes.join(radius, "cell").select("parent", "cell", "pivot", "radius")
        if tree.levels:
            whole = tree.levels[-1].join(large.select("cell"), "cell", "left_anti")
            level = level.unionByName(whole.select(F.col("cell").alias("parent"), "cell", "pivot", "radius"))
        rest = members.where("n IS NULL").select("id", "unit", "cell")
        tree = PivotTree(cut_lineage(placed.select("id", "unit", "cell").unionByName(rest)), [*tree.levels, cut_lineage(level)])
    return tree


def near_cells(tree: PivotTree, reach: float) -> DataFrame:
    """``(a, b, from_a, from_b)``, ``a <= b``: leaves that can hold vectors within the angle ``reach`` of each other, and the cells in which they part;
    null for a leaf itself and where a hash parted them. A tree without levels has none."""
    pairs = None
    for depth, level in enumerate(tree.levels):
        left = level.select(F.col("parent").alias("of_a"), F.col("cell").alias("a"), F.col("pivot").alias("pivot_a"), F.col("radius").alias("radius_a"))
        right = level.select(F.col("parent").alias("of_b"), F.col("cell").alias("b"), F.col("pivot").alias("pivot_b"), F.col("radius").alias("radius_b"))
        none = F.lit(None).cast("bigint")
        if pairs is None:  # the children of the root, of which there are ``FAN`` at most
            both = left.join(right, F.col("of_a") == F.col("of_b")).withColumns({"from_a": none, "from_b": none})
        else:
            parents = pairs.select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), "from_a", "from_b")
            both = parents.join(left, "of_a").join(right, "of_b")
        both = both.where((F.col("of_a") != F.col("of_b")) | (F.col("a") <= F.col("b")))
        between = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("pivot_a"), F.col("pivot_b")))))
        near = both.where((F.col("a") == F.col("b")) | (between - F.col("radius_a") - F.col("radius_b") <= reach))
        part = F.lit(depth < BY_HASH) & (F.col("of_a") == F.col("of_b")) & (F.col("a") != F.col("b"))
        from_a, from_b = (F.when(part, F.col(x)).otherwise(F.col(f"from_{x}")) for x in "ab")
        swap = F.col("a") > F.col("b")
        pairs = cut_lineage(
            near.select(
                F.least("a", "b").alias("a"),
                F.greatest("a", "b").alias("b"),
                F.when(swap, from_b).otherwise(from_a).alias("from_a"),
                F.when(swap, from_a).otherwise(from_b).alias("from_b"),
            )
        )
    return pairs


def _within(reach: float):
    def run(key, vectors, cells):
        own = key[0].as_py()
        rows, others = matrix(vectors["unit"]), np.asarray(cells["other"])
        near = np.zeros((len(rows), len(others)), bool)
        if len(rows) and len(others):
            near = _angles(rows, matrix(cells["pivot"])) <= np.asarray(cells["radius"])[None, :] + reach
            parted = np.flatnonzero(np.asarray(cells["theirs"].is_valid()))
            if len(parted):
                some = cells.take(pa.array(parted))
                near[:, parted] &= _angles(rows, matrix(some["theirs"])) <= _angles(rows, matrix(some["mine"])) + 2 * reach
        near |= others[None, :] == own
        found = near.any(axis=1)
        ends = np.cumsum(near.sum(axis=1)[found])
        targets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(others[np.nonzero(near)[1]]))
        kept = pa.array(found)
        return pa.table({"id": vectors["id"].filter(kept), "unit": vectors["unit"].filter(kept), "block": np.full(int(found.sum()), own), "targets": targets})

    return run


def dealt_to_cells(tree: PivotTree, reach: float) -> DataFrame:
    """``(id, unit, block, targets)``: the cell of each vector and the cells, its own included, that can hold vectors within ``reach``.

    A vector whose cell has very many neighbours has several rows, each with some of its targets.
    """
    if not tree.levels:
        return tree.vectors.select("id", "unit", F.col("cell").alias("block"), F.array("cell").alias("targets"))
    pairs = near_cells(tree, reach)
    ends = pairs.select(F.col("a").alias("cell"), F.col("b").alias("other"), F.col("from_a").alias("own_end"), F.col("from_b").alias("end")).unionByName(
        pairs.where("a <> b").select(F.col("b").alias("cell"), F.col("a").alias("other"), F.col("from_b").alias("own_end"), F.col("from_a").alias("end"))
    )
    parts = ends.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / NEIGHBOURS).alias("parts"))
    nodes = tree.levels[-1].select(F.col("cell").alias("other"), "pivot", "radius")
    made = reduce(DataFrame.unionByName, (level.where("cell <> parent").select("cell", "pivot") for level in tree.levels))
    cells = ends.join(nodes, "other").join(parts, "cell")
    for end, name in (("own_end", "mine"), ("end", "theirs")):
        cells = cells.join(made.select(F.col("cell").alias(end), F.col("pivot").alias(name)), end, "left")
    cells = cells.select(F.col("cell").alias("at_cell"), F.pmod(F.xxhash64("other"), "parts").alias("at_part"), "other", "pivot", "radius", "mine", "theirs")
    vectors = tree.vectors.join(parts, "cell").select("id", "unit", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return (
        vectors.groupBy("cell", "part")
        .cogroup(cells.groupBy("at_cell", "at_part"))
        .applyInArrow(_within(reach), "id string, unit array<double>, block bigint, targets array<bigint>")
    )
