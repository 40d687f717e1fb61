"""Every registered query against its SQL, and the shape of the plans."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare
from linkaudit.catalog.queries import QUERIES as CATALOG

#: The training-data queries have tests of their own.
QUERIES, ORACLE = {n: q for n, q in queries().items() if n in CATALOG}, oracle_sql()

#: Queries that run actions while they are built: their plan begins behind a checkpoint.
ITERATIVE = {
    "expand_sitemap_index", "sitemap_pages", "similar_page_pairs", "density_clusters", "cluster_themes", "name_themes",
    "theme_words", "write_recommendations", "write_editorial_links", "audit_tables", "read_links_csv_export", "read_links_csv_mixed",
    "audit_of_folder", "simple_audit", "guided_audit", "link_opportunities", "semantic_tables", "cluster_themes_dominant",
    "embed_texts_cached", "read_sitemap_files",
}
#: Queries whose work needs Python on the executors.
WITH_PYTHON = {
    "extract_page_links", "nav_zone", "content_zone_links", "content_links_of_link_pages", "match_editorial_links",
    "similar_page_pairs", "extract_page_links_own_parser", "apply_label_overrides", "apply_label_overrides_same_page", "correction_counts",
}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    assert name in ORACLE
    difference = compare(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df())
    assert not difference, difference


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ITERATIVE])
def test_plan_has_no_nested_loops_and_python_only_where_needed(spark, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    uses_python = any(node in plan for node in ("MapInPandas", "MapInArrow", "EvalPython", "FlatMapGroups"))
    assert uses_python == (name in WITH_PYTHON)


@pytest.mark.parametrize("name", ["top_linking_pages", "most_linked_pages", "top_anchors", "anchor_keywords", "network_nodes"])
def test_top_lists_do_not_sort_everything(spark, sf, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["sample_pages"])
def test_ranks_are_cut_before_the_shuffle(spark, sf, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, sf))


def test_scans_read_only_what_they_need(spark, sf):
    plan = QUERIES["outlink_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_orderkey" not in schema


def test_results_do_not_depend_on_the_number_of_partitions(spark, sf):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return {
                name: sorted(map(repr, QUERIES[name](spark, sf).collect()))
                for name in ("anchor_keywords", "network_edge_list", "cluster_themes", "apply_label_overrides", "sample_pages")
            }
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert rows("1") == rows("50")


def test_entry(spark):
    result = entry(spark)
    assert result.columns == ["kind", "priority", "url", "problem", "recommendation", "details"]
    assert result.count() > 0
