import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkaudit.operators import similarity as V
from linkaudit.operators import themes as T


def clustered(n, dim=8, centres=12, noise=0.25, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    return base[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dim))


def table(spark, vectors, weights=None):
    rows = [(f"u{i:05d}", [float(x) for x in v], int(weights[i]) if weights is not None else 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, embedding array<double>, weight long")


def cosines(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.round(unit @ unit.T, 9)


@pytest.mark.parametrize("block_rows", [1000, 40, 7])
@pytest.mark.parametrize("threshold", [0.6, 0.9, 0.99])
def test_all_pairs_in_any_block_size(spark, block_rows, threshold):
    vectors = clustered(150)
    c = cosines(vectors)
    want = {(f"u{i:05d}", f"u{j:05d}"): c[i, j] for i, j in itertools.combinations(range(150), 2) if c[i, j] > threshold}
    rows = V.similar_page_pairs(table(spark, vectors), threshold, 10**6, block_rows).collect()
    assert len(rows) == len(want)
    assert {(r.source, r.target): pytest.approx(r.similarity) for r in rows} == want


@pytest.mark.parametrize("block_rows", [1000, 20])
def test_best_pairs_with_many_copies(spark, block_rows):
    """A third of the pages are copies of one page: ranks among equal pairs follow the ids."""
    vectors = clustered(90)
    vectors[::3] = vectors[0]
    c = cosines(vectors)
    pairs = [(-c[i, j], f"u{i:05d}", f"u{j:05d}") for i, j in itertools.combinations(range(90), 2) if c[i, j] > 0.6]
    want = [(s, t) for _, s, t in sorted(pairs)[:20]]
    got = V.similar_page_pairs(table(spark, vectors), 0.6, 20, block_rows).collect()
    assert [(r.source, r.target) for r in got] == want


@pytest.mark.parametrize("copies,trees", [(1, 1), (60, 3)])
def test_wider_searches_share_a_tree(spark, monkeypatch, copies, trees):
    """A second tree is built only where the first left out copies that the wider search needs."""
    vectors = np.concatenate([clustered(60, centres=2, noise=0.01), np.repeat([[0.0] * 7 + [1.0]], copies, axis=0)])
    c = cosines(vectors)
    n = len(vectors)
    pairs = sorted((-c[i, j], f"u{i:05d}", f"u{j:05d}") for i, j in itertools.combinations(range(n), 2) if c[i, j] > 0.6)
    linked = [(s, t) for _, s, t in pairs[:25]]
    built = []
    monkeypatch.setattr(V, "pivot_tree", lambda *args, make=V.pivot_tree: built.append(1) or make(*args))
    links = spark.createDataFrame(linked, "source string, destination string")
    got = V.unlinked_similar_pairs(table(spark, vectors), links, 0.6, 5).collect()
    assert [(r.source, r.target) for r in got] == [(s, t) for _, s, t in pairs[25:30]]
    assert len(built) == trees


def test_zero_vectors_have_no_partner(spark):
    vectors = np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]])
    rows = V.similar_page_pairs(table(spark, vectors)).collect()
    assert [(r.source, r.target, r.similarity) for r in rows] == [("u00001", "u00002", 1.0)]
    with pytest.raises(ValueError):
        V.similar_page_pairs(table(spark, vectors), 0.0)


def tree_of(spark, vectors, block_rows, **options):
    units = V.unit_vectors(table(spark, vectors)).select("id", "unit")
    return V.pivot_tree(units, block_rows, **options)


def test_far_cells_are_not_compared(spark):
    """Tight groups far from each other: a vector is sent to its own cell, not to all cells."""
    centres = np.eye(8)
    vectors = np.repeat(centres, 40, axis=0) + 0.001 * np.random.default_rng(0).normal(size=(320, 8))
    tree = tree_of(spark, vectors, 10)
    cells = tree.vectors.groupBy("cell").count()
    n = cells.count()
    assert n >= 32 and cells.agg(F.max("count")).first()[0] <= 10
    targets = V.in_cells(tree, V.Search(0.9)).rows.groupBy("id").agg(F.sum(F.size("targets")).alias("n"))
    assert targets.agg(F.avg("n")).first()[0] < n / 2


def test_pairs_within_cells_tell_where_the_search_begins(spark, monkeypatch):
    vectors = clustered(150, centres=2, noise=0.01)
    c = cosines(vectors)
    want = sorted((-c[i, j], f"u{i:05d}", f"u{j:05d}") for i, j in itertools.combinations(range(150), 2))[:5]
    levels = []
    monkeypatch.setattr(V, "in_cells", lambda tree, search, make=V.in_cells: levels.append(search.threshold) or make(tree, search))
    got = V.similar_page_pairs(table(spark, vectors), 0.6, 5, 20).collect()
    assert [(r.source, r.target) for r in got] == [(a, b) for _, a, b in want]
    assert len(levels) == 1 and 0.98 < levels[0] < -want[-1][0]


@pytest.mark.parametrize("fan,block_rows", [(2, 20), (4, 5), (64, 3)])
def test_trees_of_any_depth_find_all_pairs(spark, monkeypatch, fan, block_rows):
    """Several levels, leaves at unlike depths, and lists of neighbours in several parts."""
    monkeypatch.setattr("linkaudit.operators.cells.NEIGHBOURS", 5)
    vectors = np.concatenate([clustered(120, noise=0.3), clustered(60, centres=1, noise=0.01, seed=3)])
    tree = tree_of(spark, vectors, block_rows, fan=fan)
    assert len(tree.levels) > 1 or fan == 64
    c = cosines(vectors)
    want = {(f"u{i:05d}", f"u{j:05d}") for i, j in itertools.combinations(range(180), 2) if c[i, j] > 0.8}
    rows = V.in_cells(tree, V.Search(0.8)).compared(V._pairs_of(10**6), "source string, target string, similarity double").collect()
    assert len(rows) == len(want) and {(r.source, r.target) for r in rows} == want


def counts_of_words(n, size=6, seed=0):
    """Groups of ``size`` texts that share most of their words, as counts in 64 buckets."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n // size):
        words = rng.integers(0, 64, rng.integers(1, 9))
        for _ in range(size):
            own = np.where(rng.random(len(words)) < 0.1, rng.integers(0, 64, len(words)), words)
            rows.append(np.bincount(own, minlength=64))
    return np.unique(np.array(rows, dtype=float), axis=0)


@pytest.mark.parametrize("block_rows", [2048, 64, 12])
@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.5])
def test_lists_of_buckets_find_each_pair_once(spark, block_rows, threshold):
    vectors = counts_of_words(240)
    vectors = vectors[:, np.random.default_rng(1).permutation(64)]
    c = cosines(vectors)
    want = {(f"u{i:05d}", f"u{j:05d}") for i, j in itertools.combinations(range(len(vectors)), 2) if c[i, j] >= threshold}
    units = V.unit_vectors(table(spark, vectors)).select("id", "unit")
    found = V.candidates(units, V.Search(threshold, inclusive=True), block_rows)
    assert found.met is not None
    rows = found.compared(V._pairs_of(10**6), "source string, target string, similarity double").collect()
    assert sorted((r.source, r.target) for r in rows) == sorted(want)


def test_work_per_vector_does_not_grow_with_the_table(spark):
    """Four times the groups of like texts: each vector is sent no more often, and no list is longer."""
    sent = []
    for n in (1500, 6000):
        units = V.unit_vectors(table(spark, counts_of_words(n, seed=n))).select("id", "unit")
        rows = V.candidates(units, V.Search(0.8, inclusive=True)).sent()
        sent.append(rows.count() / units.count())
    assert sent[1] < 1.5 * sent[0]


def dbscan(vectors, weights, eps, min_samples):
    n = len(vectors)
    near = cosines(vectors) >= round(1 - eps, 9)
    core = [weights[near[i]].sum() >= min_samples for i in range(n)]
    label = [None] * n
    for i in range(n):
        if core[i] and label[i] is None:
            stack = [i]
            label[i] = i
            while stack:
                p = stack.pop()
                for q in np.flatnonzero(near[p]):
                    if core[q] and label[q] is None:
                        label[q] = i
                        stack.append(q)
    for i in range(n):
        if not core[i]:
            label[i] = min((label[q] for q in np.flatnonzero(near[i]) if core[q]), default=None)
    return core, label


@pytest.mark.parametrize("block_rows", [1000, 25])
@pytest.mark.parametrize("eps,min_samples", [(0.05, 4), (0.2, 6), (0.02, 2)])
def test_density_clusters(spark, block_rows, eps, min_samples):
    vectors = clustered(120, noise=0.35, seed=5)
    vectors[::4] = vectors[0]
    weights = np.random.default_rng(2).integers(1, 3, 120)
    core, label = dbscan(vectors, weights, eps, min_samples)
    rows = T.density_clusters(table(spark, vectors, weights).repartition(3), eps, min_samples, block_rows).collect()
    got = {r.id: (r.is_core, r.label) for r in rows}
    assert got == {f"u{i:05d}": (core[i], None if label[i] is None else f"u{label[i]:05d}") for i in range(120)}


@pytest.mark.parametrize("width,block_rows", [(64, 25), (80, 25), (64, None)])  # 80 numbers meet in cells, not in lists
def test_one_pass_where_any_two_make_a_core(spark, monkeypatch, width, block_rows):
    """Weights of one and two points to a core: the weights around each need not be counted, nor what meets be stored."""
    rng = np.random.default_rng(8)
    vectors = np.zeros((150, width))
    for i in range(150):
        vectors[i, [i % 30, 30 + i % 7, *rng.integers(40, width, 2)]] = 3, 2, 1, 1
    vectors[::9] = vectors[0]
    weights = rng.integers(1, 3, 150)
    core, label = dbscan(vectors, weights, 0.1, 2)
    assert 0 < sum(core) < 150 and len(set(label)) > 10
    monkeypatch.setattr(T, "neighbour_weights", None)
    monkeypatch.setattr("linkaudit.operators.hubs.HUBS", 4)
    rows = T.density_clusters(table(spark, vectors, weights), 0.1, 2, block_rows).collect()
    assert {r.id: (r.is_core, r.label) for r in rows} == {f"u{i:05d}": (core[i], None if label[i] is None else f"u{label[i]:05d}") for i in range(150)}


def test_only_links_between_similar_pages_are_compared(spark, monkeypatch):
    vectors = table(spark, np.eye(20)[np.arange(40) % 20], np.ones(40, dtype=int)).select("id", "embedding")
    pairs = [(f"u{i + 20:05d}", f"u{i:05d}") for i in range(0, 20, 2)]  # every second pair, the other way round
    other = [(f"u{i:05d}", f"u{j:05d}") for i in range(20) for j in range(20) if i != j]
    links = spark.createDataFrame(pairs * 2 + other, "source string, destination string")
    looked_at = []
    whole = V.linked_similar_filter
    monkeypatch.setattr(V, "linked_similar_filter", lambda p, found: (looked_at.append(found.count()), whole(p, found))[1])
    got = sorted((r.source, r.target) for r in V.unlinked_similar_pairs(vectors, links).collect())
    assert got == [(f"u{i:05d}", f"u{i + 20:05d}") for i in range(1, 20, 2)]
    assert looked_at and max(looked_at) == 2 * len(pairs)


def test_stored_vectors_are_not_broadcast(spark, tmp_path):
    """Their files are far smaller than what a broadcast would hold."""
    units = [(f"u{i}", np.eye(64)[i % 5].tolist()) for i in range(500)]
    spark.createDataFrame(units, "id string, unit array<double>").write.parquet(str(tmp_path / "units"))
    units = spark.read.parquet(str(tmp_path / "units"))
    rows = units.select("id", F.lit(0).alias("block"), F.array(F.lit(0)).alias("targets"))
    plan = V.Candidates(rows, V.Search(0.5)).joined(units).rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_one_large_cluster_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Nearly all vectors are partners of each other: hubs settle them, and only the few others meet all."""
    rng = np.random.default_rng(4)
    vectors = np.zeros((400, 64))
    vectors[:, :2] = 4, 2
    vectors[np.arange(400), rng.integers(2, 30, 400)] = 1 + rng.random(400) / 8
    vectors[390:] = np.eye(64)[40:50] + np.eye(64)[41:51] / 4
    vectors[0] = -vectors[0]
    weights = np.ones(400, dtype=int)
    pairs = []
    count = T.neighbour_weights

    def counted(found):
        groups = found.sent().groupBy("short", "bin", "low", "high").agg(F.count_if(~F.col("right")).alias("l"), F.count_if("right").alias("r"), F.first(F.col("low") == F.col("high")).alias("same"))
        pairs.append(groups.agg(F.sum(F.when(F.col("same"), F.col("l") * F.col("l")).otherwise(F.col("l") * F.col("r")))).first()[0] or 0)
        return count(found)

    monkeypatch.setattr(T, "neighbour_weights", counted)
    core, label = dbscan(vectors, weights, 0.2, 3)
    assert sum(core) > 380
    rows = T.density_clusters(table(spark, vectors, weights), 0.2, 3, 25).collect()
    assert {r.id: (r.is_core, r.label) for r in rows} == {f"u{i:05d}": (core[i], None if label[i] is None else f"u{label[i]:05d}") for i in range(400)}
    assert pairs[0] < 400 * 400 / 4


@pytest.mark.parametrize("hubs", [1, 5])
@pytest.mark.parametrize("eps,min_samples", [(0.2, 6)])
def test_few_hubs_settle_only_what_is_certain(spark, monkeypatch, hubs, eps, min_samples):
    monkeypatch.setattr("linkaudit.operators.hubs.HUBS", hubs)
    monkeypatch.setattr(V, "TILE", 16)
    vectors = clustered(120, noise=0.35, seed=6)
    vectors[::4] = vectors[0]
    weights = np.random.default_rng(2).integers(1, 3, 120)
    core, label = dbscan(vectors, weights, eps, min_samples)
    rows = T.density_clusters(table(spark, vectors, weights), eps, min_samples, 25).collect()
    assert {r.id: (r.is_core, r.label) for r in rows} == {f"u{i:05d}": (core[i], None if label[i] is None else f"u{label[i]:05d}") for i in range(120)}


@pytest.mark.parametrize("shape", ["chain", "star", "both"])
def test_connected_components(spark, shape):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    star = [(f"s{i:03d}", "s500") for i in range(60)]
    edges = {"chain": chain, "star": star, "both": chain + star}[shape]
    got = {r.id: r.label for r in T.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    want = {}
    if shape != "star":
        want.update({f"n{i:03d}": "n000" for i in range(61)})
    if shape != "chain":
        want.update({x: "s000" for x in [f"s{i:03d}" for i in range(60)] + ["s500"]})
    assert got == want


def test_no_edges(spark):
    assert T.connected_components(spark.createDataFrame([], "a string, b string")).isEmpty()


def test_themes_and_names(spark):
    anchors = spark.createDataFrame(
        [("table chêne massif", 2), ("table chêne", 1), ("table massif chêne", 1), ("lampe noire", 1), ("dans avec", 3), ("abc", 9)],
        "anchor string, links long",
    )
    themes = T.cluster_themes(anchors, min_cluster_size=3)
    assert {(r.anchor, r.theme) for r in themes.collect()} == {
        ("table chêne massif", "table chêne"), ("table chêne", "table chêne"), ("table massif chêne", "table chêne"), ("dans avec", "dans avec"),
    }
    names = {r.theme: (r.name, r.anchors, r.links) for r in T.name_themes(themes).collect()}
    assert names == {"table chêne": ("Chêne + Table", 3, 4)}
    words = T.theme_words(themes).where("theme = 'table chêne'").orderBy("position").collect()
    assert [(r.word, r.uses, round(r["size"], 3)) for r in words] == [("chêne", 4, 1.6), ("table", 4, 1.6), ("massif", 3, 1.4)]


def test_monotonous_anchors_have_no_themes(spark):
    anchors = spark.createDataFrame([("même ancre", 90), ("autre ancre", 10)], "anchor string, links long")
    assert T.cluster_themes(anchors).isEmpty()


def test_dominant_cluster_is_searched_again(spark):
    def encode(column):
        degrees = column.cast("double")
        return F.array(F.cos(F.radians(degrees)), F.sin(F.radians(degrees)))

    # Neighbours 34 degrees apart are within 0.2, but not within 0.15.
    anchors = spark.createDataFrame([(a, 1) for a in ("1000", "1001", "1034", "1035", "1180")], "anchor string, links long")
    got = {r.anchor: r.theme for r in T.cluster_themes(anchors, encoder=encode).collect()}
    assert got == {"1000": "1000", "1001": "1000", "1034": "1034", "1035": "1034"}


def test_embedding_cache(spark, tmp_path):
    texts = spark.createDataFrame([("un texte",), ("un texte",), ("autre",), ("ab",)], "text string")
    first = V.embed_texts(texts)
    assert first.count() == 2
    V.append_cache(first, str(tmp_path / "cache"))
    V.append_cache(first, str(tmp_path / "cache"))
    cache = V.read_cache(spark, str(tmp_path / "cache"))
    more = texts.unionByName(spark.createDataFrame([("nouveau",)], "text string"))
    again = V.embed_texts(more, cache)
    assert {r.cached for r in again.where("text_md5 <> md5('nouveau')").collect()} == {True}
    assert again.where("NOT cached").count() == 1
    assert V.embedding_cache_stats(cache).first().entries == 2

    def lengths(batch):
        return [[float(len(t)), 1.0] for t in batch]

    own = {r.text_md5: list(r.embedding) for r in V.embed_texts(texts, batch_encoder=lengths).collect()}
    assert sorted(own.values()) == [[5.0, 1.0], [8.0, 1.0]]


def test_a_cache_that_holds_keys_several_times_gives_each_text_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    texts = spark.createDataFrame([(f"texte {i}",) for i in range(40)], "text string")
    half = V.embed_texts(texts.limit(20))
    for batch in ("one", "one", "two"):
        V.append_cache(half, path, batch)
    cache = V.read_cache(spark, path)
    assert cache.count() == 40
    def encode(batch):
        return [[float(len(t)), 1.0] for t in batch]

    rows = V.embed_texts(texts, cache, batch_encoder=encode).collect()
    assert len(rows) == len({r.text_md5 for r in rows}) == 40 and sum(r.cached for r in rows) == 20
    assert {tuple(r.embedding) for r in rows if not r.cached} <= {(7.0, 1.0), (8.0, 1.0)}
    plain = spark.createDataFrame([(r.text_md5, [0.5]) for r in rows for _ in range(2)], "text_md5 string, embedding array<float>")
    assert [r.embedding for r in V.embed_texts(texts, plain).collect()] == [[0.5]] * 40
    plan = V.embed_texts(texts, cache)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_coherence_with_given_vectors(spark, links_of):
    from linkaudit.operators import classify as C

    links = C.classify_links(links_of([("s", "u", "bois clair"), ("t", "u", "bois clair"), ("s", "v", "autre texte"), ("s", "w", "bois clair")]))
    contents = spark.createDataFrame([("u", "page bois"), ("v", "page vide")], "url string, content string")
    given = spark.createDataFrame(
        [("bois clair", [1.0, 0.0]), ("page bois", [1.0, 1.0])], "t string, embedding array<double>"
    ).select(F.md5("t").alias("text_md5"), "embedding")
    got = V.anchor_coherence(links, contents, given)
    assert {(r.destination, r.links, round(r.similarity, 6)) for r in got.collect()} == {("u", 2, 0.707107), ("v", 1, 0.0)}
    summary = V.coherence_summary(got).first()
    assert (summary.total_analyzed, summary.high_coherence, summary.low_coherence) == (3, 2, 1)
    assert summary.average_score == pytest.approx(2 * 0.70710678 / 3)
