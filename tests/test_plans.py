"""Work that is shared, work that does not multiply, and audits of folders."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkaudit.catalog.fixtures import fixture
from linkaudit.config import AuditConfig
from linkaudit.operators import classify as C
from linkaudit.operators import pages as P
from linkaudit.operators import recommend as M
from linkaudit.operators import similarity as V
from linkaudit.operators.classify import classify_links
from linkaudit.plans import audit, folder
from linkaudit.session import checkpoint_dir
from linkaudit.sources.csv import canonical_links


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_guided_audit_parses_pages_once(spark, sf, monkeypatch):
    parsed = []
    parse = P.extract_page_links
    monkeypatch.setattr(P, "extract_page_links", lambda pages: parsed.append(1) or parse(pages))
    links = canonical_links(fixture(spark, sf, "fx_links"))
    cfg = AuditConfig().with_options(enable_semantic_analysis=False)
    tables = audit.guided_audit(links, fixture(spark, sf, "fx_link_pages"), "www.shop.example", cfg=cfg)
    assert len(parsed) == 1
    assert not any("MapInPandas" in plan_of(t) or "MapInArrow" in plan_of(t) for t in tables.values())
    assert tables["editorial_yield"].count() == 1


def test_repeated_links_are_not_part_of_the_comparison(spark, links_of):
    offered = spark.createDataFrame([("p", "u", f"text number {i}") for i in range(200)], "page_url string, href string, text string")
    links = links_of([("p", "u", f"number {i % 250}") for i in range(2000)])
    kept = P.match_editorial_links(links, offered)
    assert kept.count() == 8 * 200
    assert plan_of(kept).count("MapIn") == 0 and "NestedLoop" not in plan_of(kept)


def test_replication_does_not_grow_with_clustered_vectors(spark):
    rng = np.random.default_rng(0)

    def blocks_per_vector(groups, copies):
        centers = rng.normal(size=(groups, 32))
        rows = [(f"{c}-{i}", (centers[c] + rng.normal(size=32) * 0.02).tolist()) for c in range(groups) for i in range(copies)]
        units = V.unit_vectors(spark.createDataFrame(rows, "id string, embedding array<double>"))
        sent = V.in_cells(V.pivot_tree(units.cache(), block_rows=32), V.Search(0.95)).sent()
        return sent.count() / units.count()

    # four times the groups and blocks, but hardly more blocks in reach of a vector
    few, many = blocks_per_vector(24, 32), blocks_per_vector(96, 32)
    assert many < 1.5 * few < 1.5 * 4
    # groups of four blocks each: a vector reaches at most twice as many
    assert blocks_per_vector(24, 128) < 2 * 4


def test_falling_thresholds_give_the_same_best_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8))
    x[60:90] = x[:30] + rng.normal(size=(30, 8)) * 0.05
    table = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    every = sorted(((-round(float(u[i] @ u[j]), 9), f"{i:03d}", f"{j:03d}") for i in range(120) for j in range(i + 1, 120)))
    for limit in (5, 25, 200):
        got = [(r.source, r.target) for r in V.similar_page_pairs(table, 0.6, limit).orderBy(F.desc("similarity"), "source", "target").collect()]
        assert got == [(a, b) for s, a, b in every if s < -0.6][:limit]


def test_opportunities_leave_linked_pairs_out_before_the_cut(spark, links_of):
    table = spark.createDataFrame([(f"p{i}", [1.0, i / 1000]) for i in range(12)], "id string, embedding array<double>")
    best = V.similar_page_pairs(table, 0.6, 10).collect()
    links = links_of([(r.target, r.source, "x") for r in best])
    out = V.unlinked_similar_pairs(table, links, 0.6, 10).collect()
    assert len(out) == 10 and not {(r.source, r.target) for r in out} & {(r.source, r.target) for r in best}
    everything = links_of([(f"p{i}", f"p{j}", "x") for i in range(12) for j in range(12)])
    assert V.unlinked_similar_pairs(table, everything, 0.6, 10).count() == 0


def test_a_folder_with_few_exports_gives_few_inputs(spark, tmp_path):
    (tmp_path / "links.csv").write_text("Source;Destination\na;b\n")
    (tmp_path / "Nombre_Mots.csv").write_text("Adresse;Nombre de mots\nhttps://s.fr/a;12\n")
    (tmp_path / "clusters.csv").write_text("URL,Other\nhttps://s.fr/a,1\n")
    (tmp_path / "links_h1.csv").write_text("Address\tH1-1\nhttps://s.fr/a\tTitre\n")
    inputs = folder.load_page_inputs(spark, str(tmp_path), str(tmp_path / "links.csv"))
    assert inputs.word_counts.first().word_count == "12" and inputs.titles is None and inputs.internal_pages is None
    assert tuple(inputs.clusters.first()) == ("https://s.fr/a", "all_pages")
    assert inputs.attributes.first().h1 == "Titre" and inputs.h1s.first().h1 == "Titre"
    tables = folder.audit_of_folder(spark, str(tmp_path), "links.csv", AuditConfig().with_options(enable_semantic_analysis=False))
    assert tables["word_count_stats"].first().total_pages == 1


def test_sessions_need_a_checkpoint_folder():
    class Context:
        master = "spark://x"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_recommendations_classify_links_in_one_pass(spark, links_of):
    rows = [("https://s.fr/a", "https://s.fr/b", a) for a in ("ok", "bois bois bois bois", "un guide", "www.s.fr")] * 6 + [("https://s.fr/c", "https://s.fr/a", "guide du bois")]
    links = links_of(rows)
    expected = sorted(tuple(r) for r in M.recommendations(classify_links(links), AuditConfig()).collect())
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = M.recommendations(classify_links(links.mapInArrow(counted, links.schema)), AuditConfig())
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert seen.value == len(rows)


def test_anchors_are_judged_once_for_a_whole_audit(spark, links_of, monkeypatch):
    """The table of flagged anchors and the findings on them come from one pass."""
    judged = []
    flags = C.quality_flags
    for module in (C, M):
        monkeypatch.setattr(module, "quality_flags", lambda anchor: judged.append(1) or flags(anchor), raising=False)
    links = links_of([("https://s.fr/a", "https://s.fr/b", a) for a in ("guide guide guide bois", "abc", "un guide", "")])
    tables = audit.link_tables(audit.classified_links(links))
    assert len(judged) == 1
    kinds = [r.kind for r in tables["recommendations"].where("kind LIKE '%anchor'").orderBy("kind").collect()]
    assert kinds == ["stuffed anchor", "weak anchor"] and tables["flagged_anchors"].count() == 2


@pytest.mark.parametrize("anchor, stuffed", [("bois bois bois x", True), ("bois Bois BOIS bois", True), ("bois bois vert vert", False), ("bois bois vert vert vert", True), ("aaa aaa aaa aaa aaa", False), (None, None)])
def test_stuffed_anchors(spark, anchor, stuffed):
    row = spark.createDataFrame([(anchor,)], "anchor string").select(C.quality_flags(F.col("anchor"))["keyword_stuffed"].alias("k"))
    assert row.first().k is stuffed


def test_exports_of_compressed_part_files_are_found(spark, tmp_path):
    rows = spark.createDataFrame([("https://s.fr/a", "120"), ("https://s.fr/b", "7")], "Address string, `Word Count` string")
    rows.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "folder" / "word_count.csv"))
    (tmp_path / "folder" / "word_count_old.csv.gz").write_bytes(b"")  # a file of its own is no export
    counts = folder.load_page_inputs(spark, str(tmp_path / "folder")).word_counts
    assert sorted(map(tuple, counts.select("url", "word_count").collect())) == [("https://s.fr/a", "120"), ("https://s.fr/b", "7")]


def test_steps_that_are_stored_leave_no_shuffle_files(spark, tmp_path):
    from linkaudit.plans.audit import shared
    from linkaudit.session import cut_lineage, stored

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)

    def files() -> set[str]:
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
        return {x for x in found if x.startswith("shuffle_")}

    for store in (stored, cut_lineage, lambda df: shared(df, "step", str(tmp_path))):
        old = files()
        assert len(store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).collect()) == 7
        end = time.time() + 20
        while [x for x in files() - old if x.endswith(".data")] and time.time() < end:  # the files go in the background
            time.sleep(0.2)
        assert not [x for x in files() - old if x.endswith(".data")]
    assert spark.conf.get(setting) == before
