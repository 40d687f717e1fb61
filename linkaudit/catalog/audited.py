"""Whole audits under a check: rows and a digest of every table, the same in Spark and SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: The columns of the tables of an audit.
COLUMNS = {
    name: tuple(columns.split())
    for name, columns in {
        "funnel": "total_links internal_links external_links mechanical_links editorial_links errors editorial_ratio",
        "stats": "total_pages total_internal_links editorial_links mechanical_links avg_editorial_per_page editorial_ratio",
        "score": "total_internal_links editorial_links editorial_ratio too_short too_long good keyword_stuffed url_anchor score rating",
        "rules": "rule links",
        "top_linking_pages": "source links",
        "most_linked_pages": "destination links",
        "top_anchors": "anchor links",
        "over_repeated_anchors": "anchor links",
        "orphan_pages": "url",
        "flagged_anchors": "anchor destination too_short keyword_stuffed url_anchor",
        "destination_categories": "category links share_percent",
        "anchor_keywords": "kind keyword uses score",
        "network_nodes": "id inbound outbound label",
        "network_edges": "source target anchor",
        "recommendations": "kind priority url problem recommendation details",
        "priority_advice": "position advice figure",
        "word_count_stats": "total_pages avg_words median_words min_words max_words thin_pages quality_pages rich_pages",
        "thin_pages": "url word_count",
        "title_h1_summary": "pages_with_both identical similar different missing_h1 missing_title",
        "title_h1_different": "url title h1",
        "conversion_pages": "url title category",
        "conversion_summary": "category pages conversion_pages share_percent",
        "similar_pairs_summary": "pairs avg_similarity max_similarity",
        "similar_pairs": "source target similarity",
        "similarity_scores": "similarity",
        "missing_links": "source_page target_page similarity_score recommendation priority",
        "cluster_summary": "total_clusters meaningful_clusters clustered_pages avg_cluster_size",
        "largest_clusters": "cluster_id pages",
        "pillar_pages": "cluster pages_count recommendation priority",
        "theme_names": "theme name anchors links",
        "theme_words": "theme position word uses size",
        "coherence_summary": "average_score total_analyzed high_coherence low_coherence",
        "link_opportunities": "source target similarity",
        "editorial_links": "source destination anchor",
        "editorial_yield": "editorial_links internal_editorial_links crawled_links yield_percent",
        "domain_counts": "host links",
    }.items()
}
#: Columns of fractions, which count with six digits.
FRACTIONS = frozenset(
    "avg_editorial_per_page editorial_ratio score share_percent figure avg_words similarity avg_similarity max_similarity similarity_score"
    " avg_cluster_size size average_score yield_percent".split()
)


def _text(column: str) -> Column:
    value = F.round(F.col(column).cast("double"), 6).cast("decimal(30,6)") if column in FRACTIONS else F.col(column)
    return F.coalesce(value.cast("string"), F.lit("∅"))


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, columns, n_rows, digest)`` of each table; neither rows nor columns have an order."""
    out = []
    for name, table in tables.items():
        columns = sorted(c for c in table.columns if c in COLUMNS[name])
        row = F.md5(F.concat_ws("\x1f", *map(_text, columns)))
        digest = F.coalesce(F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")), F.lit(0))
        listed = F.lit(",".join(columns)).alias("columns")
        out.append(table.agg(F.count(F.lit(1)).alias("n_rows"), digest.alias("digest")).select(F.lit(name).alias("name"), listed, "n_rows", "digest"))
    return reduce(DataFrame.unionByName, out)


def digest_sql(name: str, sql: str) -> str:
    """The row of ``digests`` for the table that ``sql`` gives."""

    def text(column: str) -> str:
        value = f"round({column}::DOUBLE, 6)::DECIMAL(30, 6)" if column in FRACTIONS else f'"{column}"'
        return f"coalesce({value}::VARCHAR, '∅')"

    columns = sorted(COLUMNS[name])
    row = f"md5(concat_ws(chr(31), {', '.join(map(text, columns))}))"
    return (
        f"SELECT '{name}' AS name, '{','.join(columns)}' AS columns, count(*) AS n_rows, "
        f"coalesce(sum(('0x' || {row}[1:8])::BIGINT), 0)::BIGINT AS digest FROM ({sql})"
    )
