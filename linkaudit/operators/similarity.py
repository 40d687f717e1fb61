"""Exact all-pairs cosine work over vectors, in bounded blocks.

Which vectors meet is found by a tree of pivots (``cells``) or, for vectors that are mostly zero, by lists of buckets
(``sparse_pairs``). Each pair of blocks is one matrix product in one task, and a task
never passes on all of its pairs: it returns its best pairs, a sum per vector, or a spanning
forest, each at most linear in the block.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import py_strip, text_md5
from ..functions.vectors import COSINE_DIGITS, dot, hashed_vector, unit
from ..session import cut_lineage, stored
from . import sparse_pairs
from .cells import PivotTree, dealt_to_cells, matrix, pivot_tree
from .classify import editorial
from .graph import linked_similar_filter
from .hubs import roots

#: A table is dealt to about so many blocks, each of at least and at most so many vectors: what is sent grows with the number of blocks.
BLOCKS, BLOCK_ROWS, MOST_ROWS = 16, 2048, 1 << 15
#: A task holds two blocks, the product matrix of ``TILE`` vectors with as many (8 bytes a cell), and about ``PORTION`` pairs.
TILE, PORTION = 2048, 1 << 20
#: Thresholds tried, from above, until enough pairs lie over one: the higher, the fewer cells a vector reaches.
_FALLING = (0.98, 0.95, 0.9, 0.8, 0.7)

#: Slack for angles, far above rounding errors and far below any useful threshold.
_ANGLE_SLACK = 1e-6
#: What a search goes below a known cosine, more than cosines are rounded by.
_BELOW = 1e-8


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``(id, ..., unit)`` of the non-zero vectors ``(id, embedding, ...)``."""
    scaled = vectors.withColumn("unit", unit(F.col("embedding"))).drop("embedding")
    return scaled.where("unit IS NOT NULL")


@dataclass(frozen=True)
class Search:
    """Which pairs count: cosine above ``threshold``, or equal to it if ``inclusive``."""

    threshold: float
    inclusive: bool = False

    def angle(self) -> float:
        return float(np.arccos(np.clip(self.threshold, -1.0, 1.0))) + _ANGLE_SLACK

    def least(self) -> float:
        """No cosine below it counts, whatever is rounded."""
        return self.threshold - 10.0**-COSINE_DIGITS

    def hits(self, cosines: np.ndarray) -> np.ndarray:
        rounded = np.round(cosines, COSINE_DIGITS)
        return rounded >= round(self.threshold, COSINE_DIGITS) if self.inclusive else rounded > self.threshold


# --- Blocks ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Candidates:
    """Vectors (``id``, ``unit``, further columns) with the blocks they are compared in.

    ``rows`` has the block of a vector and those it is sent to (``block``, ``targets``), or a row for each time it is sent (``short``,
    ``bin``, ``low``, ``high``, ``right``). ``met`` tells which pairs of two blocks count there, where a pair can meet in several.
    """

    rows: DataFrame
    search: Search
    met: Callable[[dict, dict], np.ndarray] | None = None

    def joined(self, other: DataFrame, how: str = "inner") -> Candidates:
        """With the columns of ``other (id, ...)``. Stored vectors are far larger in memory than in their files, so none are broadcast."""
        return replace(self, rows=self.rows.join(other.hint("merge"), "id", how))

    def stored(self) -> Candidates:
        """Where the vectors meet, without the vectors, which are joined with what a pass needs."""
        return replace(self, rows=stored(self.rows.drop("unit"), "candidates"))

    def sent(self) -> DataFrame:
        """Where ``rows`` have ``open``, those that are not open meet no block without any."""
        if "targets" not in self.rows.columns:
            return self.rows
        low, high = F.least("block", "target"), F.greatest("block", "target")
        sent = self.rows.withColumn("target", F.explode("targets"))
        if "open" in self.rows.columns:
            opened = self.rows.where("open").select(F.col("block").alias("target"), F.lit(True).alias("_opened")).distinct()
            sent = sent.join(opened, "target", "left").where("open OR _opened").drop("_opened")
        sent = sent.withColumns({"short": F.lit(False), "bin": F.lit(0).cast("bigint"), "low": low, "high": high, "right": F.col("block") > F.col("target")})
        return sent.drop("targets", "target", "block")

    def compared(self, work: Callable[[dict, dict, Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]], pa.Table], schema: str) -> DataFrame:
        """Run ``work(left, right, found)`` once for every pair of blocks that can hold hits; ``found`` has them in portions ``(i, j, cosines)``:
        row ``i`` on the left and ``j`` on the right.

        Both sides come as dicts of columns; ``unit`` is a matrix. A block by itself is both sides, and has each of its pairs once.
        """
        search, met, where = self.search, self.met, ("short", "bin", "low", "high", "right")

        def run(key, table):  # no type hints: Spark reads them as a choice of interface
            short, same = key[0].as_py(), key[2].as_py() == key[3].as_py()
            sides = []
            for is_right in (False, True):
                part = table.filter(pa.compute.equal(table["right"], is_right))
                if short:
                    part = part.sort_by("key")
                side = {n: part[n].combine_chunks() for n in part.column_names if n not in ("unit", *where)}
                side["unit"] = matrix(part["unit"])
                sides.append(side)
            left, right = sides
            if same:
                right = left
            if not short:
                return work(left, right, _portions(_hits(search, met, left, right, slice(None), same)))
            # many short lists in one block: each is compared by itself
            keys = np.asarray(left["key"])
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else []
            found = (hits for a, b in zip(edges, edges[1:]) if b > a + 1 for hits in _hits(search, met, left, left, slice(a, b), True))
            return work(left, left, _portions(found))

        return self.sent().groupBy("short", "bin", "low", "high").applyInArrow(run, schema)


def _hits(search: Search, met, left: dict, right: dict, rows: slice, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of two blocks, or of some rows of one, that count, tile by tile."""
    a, b = left["unit"][rows], right["unit"][rows]
    first = rows.start or 0
    for low in range(0, len(a), TILE):
        for at in range(low if same else 0, len(b), TILE):
            cosines = a[low : low + TILE] @ b[at : at + TILE].T
            i, j = np.nonzero(cosines >= search.least())
            cosines = cosines[i, j]
            i, j = i + low + first, j + at + first
            kept = search.hits(cosines)
            if same:
                kept &= i < j
            i, j, cosines = i[kept], j[kept], cosines[kept]
            if met is not None and len(i):
                kept = met(left, right, i, j)
                i, j, cosines = i[kept], j[kept], cosines[kept]
            if len(i):
                yield i, j, cosines


def _portions(found: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    held, n = [], 0
    for hits in found:
        held.append(hits)
        n += len(hits[0])
        if n >= PORTION:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def block_size(units: DataFrame) -> int:
    """Vectors of a block: few enough for all cores to have blocks, and so many that a large table has few blocks."""
    return min(max(BLOCK_ROWS, -(-units.count() // BLOCKS)), MOST_ROWS)


def candidates(units: DataFrame, search: Search, block_rows: int | None = None, with_units: bool = True) -> Candidates:
    """The vectors of ``units (id, unit[, open])`` and where they meet; ``units`` must be cheap to read several times and have unique ids.

    With ``open``, pairs of two vectors that are not open need not meet.
    """
    if search.threshold > 0 and sparse_pairs.fits(units):
        return Candidates(sparse_pairs.dealt_to_lists(units, search.threshold, block_rows or BLOCK_ROWS, with_units), search, sparse_pairs.met_first)
    found = in_cells(pivot_tree(units, block_rows or block_size(units)), search)
    return found.joined(units.select("id", "open")) if "open" in units.columns else found


def in_cells(tree: PivotTree, search: Search) -> Candidates:
    return Candidates(dealt_to_cells(tree, search.angle()), search)


# --- What a pair of blocks returns -----------------------------------------------------


def _pairs_of(limit: int):
    """Pairs with smaller id first; the best ``limit`` of the block pair."""

    def work(left, right, found):
        names = [np.asarray(s["id"].to_pylist(), dtype=object) for s in (left, right)]
        best = [np.empty(0, dtype=object), np.empty(0, dtype=object), np.empty(0)]
        for i, j, cosines in found:
            score = np.round(cosines, COSINE_DIGITS)
            if len(score) > limit:
                kept = score >= np.partition(score, len(score) - limit)[len(score) - limit]
                i, j, score = i[kept], j[kept], score[kept]
            a, b = names[0][i], names[1][j]
            swap = a > b
            best = [np.concatenate(x) for x in zip(best, (np.where(swap, b, a), np.where(swap, a, b), score))]
            if len(best[2]) > limit:
                a, b, score = best
                order = sorted(range(len(score)), key=lambda k: (-score[k], a[k], b[k]))[:limit]
                best = [x[order] for x in best]
        return pa.table({"source": pa.array(best[0], pa.string()), "target": pa.array(best[1], pa.string()), "similarity": best[2]})

    return work


def _both(left: dict, right: dict) -> tuple[int, int]:
    """The number of rows of both sides, and the place of the right ones among them."""
    shift = 0 if left is right else len(left["unit"])
    return shift + len(right["unit"]), shift


def _column(left: dict, right: dict, name: str) -> list:
    return left[name].to_pylist() + ([] if left is right else right[name].to_pylist())


def _neighbour_weights():
    """Summed weight of the partners of each vector, itself left out."""

    def work(left, right, found):
        n, shift = _both(left, right)
        wl, wr = (np.asarray(s["weight"], dtype="float64") for s in (left, right))
        sums = np.zeros(n)
        for i, j, _ in found:
            sums += np.bincount(i, weights=wr[j], minlength=n) + np.bincount(j + shift, weights=wl[i], minlength=n)
        some = np.flatnonzero(sums)
        ids = _column(left, right, "id")
        return pa.table({"id": pa.array([ids[r] for r in some], pa.string()), "weight": np.rint(sums[some]).astype("int64")})

    return work


def _ties():
    """What connects the cores of two blocks, the members of each connected group linked to its smallest ``name``, and the cores next to each other vector."""

    def work(left, right, found):
        n, shift = _both(left, right)
        core = np.array(_column(left, right, "is_core"), dtype=bool)
        # vectors of one name are one; names in their order, so that the smallest row of a group is its smallest name
        names, code = np.unique(np.array(_column(left, right, "name"), dtype=object), return_inverse=True)
        root = np.arange(len(names))
        near: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j, _ in found:
            k = j + shift
            both = core[i] & core[k]
            a, b = code[i[both]], code[k[both]]
            moves = root[a] != root[b]
            if moves.any():
                root = roots(root, a[moves], b[moves])
            near += [(x[one], code[y[one]]) for x, y in ((i, k), (k, i)) for one in [~core[x] & core[y]]]
        moved = np.flatnonzero(root != np.arange(len(names)))
        border, of = (np.concatenate(x) if near else np.empty(0, "int64") for x in (zip(*near) if near else ((), ())))
        ids = _column(left, right, "id")
        a = [names[r] for r in moved] + [ids[r] for r in border]
        b = [names[root[r]] for r in moved] + [names[r] for r in of]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "border": np.arange(len(a)) >= len(moved)})

    return work


def _name_ties():
    """``_ties`` where all vectors are cores."""

    def work(left, right, found):
        names, code = np.unique(np.array(_column(left, right, "name"), dtype=object), return_inverse=True)
        shift = _both(left, right)[1]
        root = np.arange(len(names))
        for i, j, _ in found:
            a, b = code[i], code[j + shift]
            moves = root[a] != root[b]
            if moves.any():
                root = roots(root, a[moves], b[moves])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": pa.array(names[moved], pa.string()), "b": pa.array(names[root[moved]], pa.string())})

    return work


def neighbour_weights(found: Candidates) -> DataFrame:
    """``(id, weight)``: summed weight of all partners, from candidates with a ``weight``."""
    return found.compared(_neighbour_weights(), "id string, weight bigint").groupBy("id").agg(F.sum("weight").alias("weight"))


def ties(found: Candidates) -> DataFrame:
    """``(a, b, border)`` of candidates with ``is_core`` and ``name``: edges between names that connect what cores that are partners connect, far fewer
    than the partner pairs; and with ``border`` the id of each vector that is no core with the names of the cores it is a partner of."""
    return found.compared(_ties(), "a string, b string, border boolean").distinct()


def name_ties(found: Candidates) -> DataFrame:
    """``(a, b)`` of candidates with ``name``, all of which are cores: edges between names that connect what partners connect. The ids are not sent."""
    return replace(found, rows=found.rows.drop("id")).compared(_name_ties(), "a string, b string").distinct()


# --- Operators ----------------------------------------------------------------------------


def similar_page_pairs(
    vectors: DataFrame,
    threshold: float = 0.6,
    limit: int = 20,
    block_rows: int | None = None,
) -> DataFrame:
    """``(source, target, similarity)`` of the most similar pages, ``source < target``.

    ``vectors (id, embedding)``; pairs count from cosines above ``threshold``. All pages are
    compared. The search begins at the least of the best ``limit`` pairs within cells; where there are not so many, it goes down from a high threshold and ends as
    soon as ``limit`` pairs lie above one. Copies of one vector are first reduced to their ``limit + 1`` smallest
    ids: as equal pairs rank by id, no other copy can be part of the result.
    """
    return _best_pairs(_tree_of_pages(vectors, limit, block_rows)[0], threshold, limit)


def _tree_of_pages(vectors: DataFrame, limit: int, block_rows: int | None = None) -> tuple[PivotTree, int]:
    """The tree in which the best ``limit`` pairs are searched, and the largest number of pairs it serves."""
    units = unit_vectors(vectors.select(F.col("id").cast("string").alias("id"), "embedding"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("id"))
    units = cut_lineage(units.withColumn("_copy", rank).where(F.col("_copy") <= limit + 1))
    whole = (units.agg(F.max("_copy")).first()[0] or 0) <= limit
    return pivot_tree(units.drop("_copy"), block_rows or block_size(units)), sys.maxsize if whole else limit


def _best_pairs(tree: PivotTree, threshold: float, limit: int) -> DataFrame:
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")

    def best_of(found: Candidates) -> DataFrame:
        pairs = found.compared(_pairs_of(limit), "source string, target string, similarity double")
        return cut_lineage(pairs.orderBy(F.desc("similarity"), "source", "target").limit(limit))

    levels = (*(t for t in _FALLING if t > threshold), threshold)
    # no vector leaves its cell: as many pairs there tell how similar the best are at least
    inside = tree.vectors.select("id", "unit", F.col("cell").alias("block"), F.array("cell").alias("targets"))
    known = best_of(Candidates(inside, Search(levels[0])))
    if not tree.levels and (len(levels) == 1 or known.count() == limit):
        return known
    least = known.agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("similarity")).first()
    if least["n"] == limit:
        levels = (max(levels[0], least["similarity"] - _BELOW),)
    for level in levels:
        best = best_of(in_cells(tree, Search(level)))
        if best.count() == limit:  # no pair below this level is among the best
            break
    return best


def unlinked_similar_pairs(vectors: DataFrame, links: DataFrame, threshold: float = 0.6, limit: int = 20) -> DataFrame:
    """The most similar pages of which neither links to the other: ``similar_page_pairs`` without linked ones.

    Linked pairs leave before the list is cut: the search is widened until ``limit`` pairs remain or there are no more. All searches go through one
    tree, unless it has too few copies of a vector for the wider one. Of the links only those between pages of a pair are looked at further.
    """
    ends = [F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")]
    linked = links.select(F.least("source", "destination").alias("low"), F.greatest("source", "destination").alias("high"))
    wanted, serves = limit, 0
    while True:
        if wanted > serves:
            tree, serves = _tree_of_pages(vectors, wanted)
        pairs = _best_pairs(tree, threshold, wanted)
        between = linked.join(pairs.select(*ends), ["low", "high"], "left_semi")
        unlinked = cut_lineage(linked_similar_filter(pairs, between.select(F.col("low").alias("source"), F.col("high").alias("destination"))))
        if unlinked.count() >= limit or pairs.count() < wanted:
            return unlinked.orderBy(F.desc("similarity"), "source", "target").limit(limit)
        wanted *= 4


#: Hexadecimal digits of a key that name its part of a cache.
PREFIX_DIGITS = 2
_CACHE = "text_md5 string, embedding array<double>, prefix string, batch string"


def _prefix(key: Column) -> Column:
    return F.substring(key, 1, PREFIX_DIGITS)


def distinct_texts(texts: DataFrame) -> DataFrame:
    """``(text_md5, text)`` of the distinct texts of three characters or more without the blanks around them."""
    kept = texts.select("text").where(F.length(py_strip(F.col("text"))) >= 3).distinct()
    return kept.select(text_md5(F.col("text")).alias("text_md5"), "text")


def embed_texts(
    texts: DataFrame,
    cache: DataFrame | None = None,
    encoder: Callable[[Column], Column] = hashed_vector,
    batch_encoder: Callable[[list[str]], np.ndarray] | None = None,
) -> DataFrame:
    """``(text_md5, embedding, cached)`` for the distinct texts ``(text)`` of three characters or more
    without the blanks around them. Shorter texts have no row: their vector is zero and like no other.

    Texts in the cache ``(text_md5, embedding)`` keep their vector; the others are encoded by a column expression, or in
    Arrow batches by ``batch_encoder``. Texts are read and joined with the cache once. A key that the cache has
    several times, as after two audits at once, gives one row. Append the rows that are not ``cached`` to the cache.
    """
    asked = distinct_texts(texts)
    if cache is None:
        joined = asked.withColumn("known", F.lit(None).cast("array<double>"))
    else:
        kept = cache.select("text_md5", F.col("embedding").cast("array<double>").alias("known"))
        joined = asked.join(kept, "text_md5", "left").groupBy("text_md5", "text").agg(F.min("known").alias("known"))
    cached = F.col("known").isNotNull().alias("cached")
    if batch_encoder is None:
        return joined.select("text_md5", F.coalesce("known", encoder(F.col("text")).cast("array<double>")).alias("embedding"), cached)

    def encode(batches):
        for batch in batches:
            vectors = batch.column("known").to_pylist()
            new = [i for i, v in enumerate(vectors) if v is None]
            if new:
                matrix = np.asarray(batch_encoder(batch.column("text").take(pa.array(new)).to_pylist()), dtype="float64")
                for i, vector in zip(new, matrix.tolist()):
                    vectors[i] = vector
            flags = pa.compute.is_valid(batch.column("known"))
            yield pa.RecordBatch.from_arrays([batch.column("text_md5"), pa.array(vectors, pa.list_(pa.float64())), flags], ["text_md5", "embedding", "cached"])

    return joined.select("text_md5", "text", "known").mapInArrow(encode, "text_md5 string, embedding array<double>, cached boolean")


def append_cache(embedded: DataFrame, path: str, batch: str | None = None) -> None:
    """Add the newly made vectors to a Parquet cache, in folders by the beginning of the key and by batch.

    A batch is written over what a lost or repeated attempt left of it, so appending the same vectors again changes nothing. Without a
    name it is named after its keys. Other batches are not touched, so audits can append at the same time; ``embed_texts``
    reads a key once, however many batches hold it.
    """
    new = embedded.where("NOT cached").select("text_md5", "embedding", _prefix(F.col("text_md5")).alias("prefix"))
    if batch is None:
        keys = new.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("text_md5").cast("decimal(20,0)")), F.lit(0)).alias("sum")).first()
        batch = f"{keys['n']}-{keys['sum']}"
    rows = new.withColumn("batch", F.lit(batch)).repartition("prefix")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache that ``append_cache`` writes."""
    return spark.read.schema(_CACHE).parquet(path)


def embedding_cache_stats(cache: DataFrame) -> DataFrame:
    """Entries of a cache and the bytes of its vectors, at four bytes a number."""
    return cache.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.sum(F.size("embedding").cast("bigint") * 4), F.lit(0)).alias("bytes"),
    )


def anchor_coherence(
    internal: DataFrame,
    contents: DataFrame,
    vectors: DataFrame | None = None,
    encoder: Callable[[Column], Column] = hashed_vector,
) -> DataFrame:
    """``(anchor, destination, links, similarity)``: how well anchors fit the page they lead to.

    ``contents (url, content)``. Links are first reduced to distinct anchors per destination, so
    a page that collects a third of all links is joined with its distinct anchors only. All links
    are compared. ``vectors (text_md5, embedding)`` replaces the encoder by given vectors.
    """
    uses = (
        editorial(internal)
        .select(py_strip(F.col("anchor")).alias("anchor"), "destination")
        .where("anchor <> '' AND destination <> ''")
        .groupBy("anchor", "destination")
        .agg(F.count(F.lit(1)).alias("links"))
    )
    if vectors is None:
        pages = contents.select(F.col("url").alias("destination"), unit(encoder(F.col("content"))).alias("_page"))
        anchors = uses.groupBy("anchor").agg(F.lit(1).alias("_one")).select("anchor", unit(encoder(F.col("anchor"))).alias("_anchor"))
        joined = uses.join(anchors, "anchor").join(pages, "destination")
    else:
        units = vectors.select("text_md5", unit(F.col("embedding")).alias("unit"))
        of_page = units.select(F.col("text_md5").alias("_page_md5"), F.col("unit").alias("_page"))
        of_anchor = units.select(F.col("text_md5").alias("_anchor_md5"), F.col("unit").alias("_anchor"))
        pages = (
            contents.select(F.col("url").alias("destination"), text_md5(F.col("content")).alias("_page_md5"))
            .join(of_page, "_page_md5", "left")
            .select("destination", "_page")
        )
        joined = (
            uses.join(pages, "destination")
            .withColumn("_anchor_md5", text_md5(F.col("anchor")))
            .join(of_anchor, "_anchor_md5", "left")
        )
    similarity = F.coalesce(dot(F.col("_anchor"), F.col("_page")), F.lit(0.0))
    return joined.select("anchor", "destination", "links", similarity.alias("similarity"))


def coherence_summary(coherence: DataFrame) -> DataFrame:
    """Mean similarity over all links, and how many lie above 0.7 or below 0.4."""
    links, s = F.col("links"), F.col("similarity")
    return coherence.agg(
        (F.sum(s * links) / F.sum("links")).alias("average_score"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("total_analyzed"),
        F.coalesce(F.sum(F.when(s > 0.7, links)), F.lit(0)).alias("high_coherence"),
        F.coalesce(F.sum(F.when(s < 0.4, links)), F.lit(0)).alias("low_coherence"),
    )
