"""Themes: density-based clusters of anchors, their names and words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import THEME_STOP_WORDS
from ..functions.text import py_strip, py_words
from ..functions.vectors import hashed_vector
from ..session import cut_lineage, stored
from .aggregates import anchor_diversity
from .hubs import settled
from .similarity import Candidates, Search, candidates, name_ties, neighbour_weights, ties, unit_vectors

MIN_DIVERSITY = 0.3
FIRST_EPS, SECOND_EPS = 0.2, 0.15

def _roots(hooks: DataFrame) -> DataFrame:
    """Follow ``(v, parent)`` until every parent is a root; the path halves in each round."""
    while True:
        moving = hooks.where("v <> parent").select(F.col("v").alias("parent"), F.col("parent").alias("_next"))
        jumped = hooks.join(moving, "parent", "left").select(
            "v", F.coalesce("_next", "parent").alias("parent"), F.col("_next").isNotNull().alias("moved")
        )
        jumped = cut_lineage(jumped)
        if jumped.where("moved").isEmpty():
            return jumped.select("v", "parent")
        hooks = jumped.select("v", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every end of the edges ``(a, b)``; the label is the smallest id connected.

    Each round hooks every vertex onto its smallest neighbour, follows the hooks to their roots
    and replaces the edges by edges between roots, so the number of rounds grows with the
    logarithm of the largest component. Every round is checkpointed.
    """
    left = cut_lineage(edges.where("a <> b").select("a", "b").distinct())
    labels: DataFrame | None = None
    while not left.isEmpty():
        ends = left.select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
                    F.struct(F.col("b").alias("v"), F.col("a").alias("w")),
                )
            ).alias("e")
        ).select("e.*")
        roots = _roots(ends.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("parent")))
        if labels is None:
            labels = roots.select(F.col("v").alias("id"), F.col("parent").alias("label"))
        else:
            step = roots.select(F.col("v").alias("label"), F.col("parent").alias("_root"))
            labels = labels.join(step, "label", "left").select("id", F.coalesce("_root", "label").alias("label"))
        labels = cut_lineage(labels)
        for side in ("a", "b"):
            left = left.join(roots.select(F.col("v").alias(side), F.col("parent").alias("_root")), side).drop(side)
            left = left.withColumnRenamed("_root", side)
        left = cut_lineage(left.where("a <> b").select("a", "b").distinct())
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).limit(0)
    return labels


def _cores_by_weight(places: DataFrame, found: Candidates, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """``(id, name, is_core)`` of all places, and what ties them: one pass for the weight around each, one over those with partners."""
    partners = neighbour_weights(found.joined(places.select("id", "unit", "weight"))).withColumnRenamed("weight", "_around")
    around = F.coalesce("_around", F.lit(0))
    is_core = F.col("settled") | (F.col("weight") + around >= min_samples)
    density = cut_lineage(places.join(partners, "id", "left").select("id", "name", is_core.alias("is_core"), (around > 0).alias("has_partners")))
    near = density.where("is_core OR has_partners").join(places.select("id", "unit").hint("merge"), "id").drop("has_partners")
    return density, cut_lineage(ties(found.joined(near)))


def _all_partners_cores(places: DataFrame, found: Candidates, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """The same where any two weights make ``min_samples``: whatever has a partner is a core, so that one pass tells all.

    A place that is not settled has a name of its own, so each of its partners ties it to another name.
    """
    if "unit" in found.rows.columns:  # cells: which blocks are open is found from the same rows
        found = found.stored()
    tied = cut_lineage(name_ties(found.joined(places.select("id", "unit", "name"))).withColumn("border", F.lit(False)))
    ends = tied.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("_tied", F.lit(True))
    is_core = F.col("settled") | (F.col("weight") >= min_samples) | F.coalesce("_tied", F.lit(False))
    return cut_lineage(places.join(ends, "id", "left").select("id", "name", is_core.alias("is_core"))), tied


def density_clusters(
    vectors: DataFrame, eps: float, min_samples: int, block_rows: int | None = None
) -> DataFrame:
    """``(id, weight, is_core, label)`` by DBSCAN on cosine distance; noise has a null label.

    ``vectors (id, embedding, weight)``: a point of weight n counts as n points at one place.
    Points with equal vectors are handled as one, named by the smallest id. A label is the
    smallest core id of its cluster. A border point near several clusters joins the one with the
    smallest label.

    Cores that a few points settle are known first. Those of the largest cluster found so are not compared with each other: their density counts
    no further, and they are connected already.
    """
    search = Search(1.0 - eps, inclusive=True)
    units = unit_vectors(vectors.select(F.col("id").cast("string").alias("id"), "embedding", "weight"))
    places = stored(units.groupBy("unit").agg(F.min("id").alias("id"), F.sum("weight").alias("weight")), "places")
    known = settled(places, search, min_samples)
    largest = known.groupBy("name").count().orderBy(F.desc("count"), "name").limit(1).select("name", F.lit(False).alias("_open"))
    known = known.join(F.broadcast(largest), "name", "left").withColumnRenamed("name", "_name")
    places = stored(
        places.join(known, "id", "left").select(
            "id", "unit", "weight", F.col("_name").isNotNull().alias("settled"), F.coalesce("_name", "id").alias("name"), F.coalesce("_open", F.lit(True)).alias("open")
        ),
        "places",
    )
    found = candidates(places.select("id", "unit", "open"), search, block_rows, with_units=False)
    lightest = places.agg(F.min("weight").alias("weight"), F.max(F.col("weight").isNull()).alias("unknown")).first()
    if lightest["weight"] is not None and not lightest["unknown"] and 2 * lightest["weight"] >= min_samples:
        density, tied = _all_partners_cores(places, found, min_samples)
    else:
        density, tied = _cores_by_weight(places, found.stored(), min_samples)
    components = connected_components(tied.where("NOT border").select("a", "b")).withColumnRenamed("id", "name")
    cores = density.where("is_core").select("id", "name").join(components, "name", "left")
    cores = cut_lineage(cores.select("id", "name", F.coalesce("label", "name").alias("label")))
    border = tied.where("border").select(F.col("a").alias("id"), F.col("b").alias("name")).join(cores.select("name", "label").distinct(), "name")
    border = border.groupBy("id").agg(F.min("label").alias("label"))
    labelled = density.select("id", "is_core").join(cores.select("id", "label").unionByName(border), "id", "left")

    # Back from places to points: equal vectors share label and kind. They are told apart by a hash first; Spark splits the copies of a frequent one.
    key = F.xxhash64(F.transform("unit", lambda x: x + F.lit(0.0))).alias("_key")  # 0.0 and -0.0 are equal
    named = places.select(F.col("id").alias("_place"), "unit").hint("merge").join(labelled.withColumnRenamed("id", "_place"), "_place").select(key, "unit", "is_core", "label")
    points = units.select(key, "unit", "id", "weight").join(named, ["_key", "unit"]).select("id", "weight", "is_core", "label")
    zero = vectors.select(F.col("id").cast("string").alias("id"), "weight").join(
        units.select("id"), "id", "left_anti"
    )
    return points.unionByName(
        zero.select("id", "weight", F.lit(False).alias("is_core"), F.lit(None).cast("string").alias("label"))
    )


def _needs_refinement(clusters: DataFrame) -> bool:
    """Whether there is exactly one cluster besides noise, and it holds more than half of all points."""
    row = clusters.agg(
        F.count_distinct("label").alias("clusters"),
        F.sum(F.when(F.col("label").isNull(), F.col("weight"))).alias("noise"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("weight"))).alias("held"),
        F.sum("weight").alias("total"),
    ).first()
    return row.clusters == 1 and row.noise is not None and row.held > row.total * 0.5


def cluster_themes(
    anchors: DataFrame,
    min_cluster_size: int = 2,
    encoder: Callable[[Column], Column] = hashed_vector,
    block_rows: int | None = None,
) -> DataFrame:
    """``(anchor, links, theme)`` of the anchors that belong to a theme, ``theme`` its smallest core anchor.

    ``anchors (anchor, links)`` is one row per anchor. Anchors of up to 3 characters are left out.
    There are no themes where anchors are too few, or where fewer than three in ten differ. One
    dominant cluster is searched again with a smaller radius.
    """
    usable = anchors.where(F.length(py_strip(F.col("anchor"))) > 3)
    figures = anchor_diversity(usable).first()
    empty = anchors.select("anchor", "links", F.lit("").alias("theme")).limit(0)
    if figures.anchors < min_cluster_size or figures.diversity < MIN_DIVERSITY:
        return empty
    vectors = stored(
        usable.select(F.col("anchor").alias("id"), encoder(F.col("anchor")).alias("embedding"), F.col("links").alias("weight")), "vectors"
    )
    clusters = stored(density_clusters(vectors, FIRST_EPS, min_cluster_size, block_rows), "clusters")
    if _needs_refinement(clusters):
        clusters = stored(density_clusters(vectors, SECOND_EPS, max(2, min_cluster_size - 1), block_rows), "clusters")
    themes = clusters.where("label IS NOT NULL")
    large = themes.groupBy("label").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_cluster_size).select("label")
    return themes.join(large, "label", "left_semi").select(
        F.col("id").alias("anchor"), F.col("weight").alias("links"), F.col("label").alias("theme")
    )


def _word_uses(themes: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """Uses of every word of more than 3 characters per theme."""
    words = F.filter(py_words(F.lower("anchor")), lambda w: (F.length(w) > 3) & ~w.isin(*stop_words) if stop_words else F.length(w) > 3)
    return (
        themes.select("theme", F.explode(words).alias("word"), "links")
        .groupBy("theme", "word")
        .agg(F.sum("links").alias("uses"))
    )


def _most_used(uses: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("uses"), "word"))
    return uses.withColumn("position", rank).where(F.col("position") <= n)


def name_themes(themes: DataFrame) -> DataFrame:
    """``(theme, name, anchors, links)``: themes named by their most used words.

    A theme without any word left has no row. Themes of equal name stay apart by ``theme``.
    """
    sizes = themes.groupBy("theme").agg(F.count(F.lit(1)).alias("anchors"), F.sum("links").alias("links"))
    best = _most_used(_word_uses(themes, THEME_STOP_WORDS), 3)

    def word(position: int) -> Column:
        # Ranks fall with the uses, so the frequent words are the first ones.
        return F.max(F.when((F.col("position") == position) & (F.col("uses") >= 2), F.initcap("word")))

    words = best.groupBy("theme").agg(word(1).alias("first"), word(2).alias("second"))
    name = (
        F.when(F.col("second").isNotNull(), F.concat_ws(" + ", "first", "second"))
        .when(F.col("first").isNotNull(), F.concat("first", F.lit(" ("), F.col("links").cast("string"), F.lit(" links)")))
        .otherwise(F.concat(F.lit("Theme "), F.col("theme")))
    )
    return sizes.join(words, "theme").select("theme", name.alias("name"), "anchors", "links")


def theme_words(themes: DataFrame) -> DataFrame:
    """``(theme, position, word, uses, size)``: the ten most used words with a display size."""
    best = _most_used(_word_uses(themes, ()), 10)
    most = F.max("uses").over(Window.partitionBy("theme"))
    return best.select("theme", "position", "word", "uses", (0.8 + F.col("uses") / most * 0.8).alias("size"))
