"""The pipeline's stages on empty tables and on nulls, empty and very long texts, repeated rows and clashing column names."""

import pytest

import corpus_pipeline

from test_operators import CLASHING, empty, messy

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_an_empty_table(spark, sf, name):
    out = STAGES[name](spark, empty(spark), sf)
    assert out.count() == 0 and out.columns[:5] == empty(spark).columns


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_messy_rows(spark, sf, name):
    docs = messy(spark)
    out = STAGES[name](spark, docs, sf)
    rows = out.collect()
    assert out.columns[: 5 + len(CLASHING)] == docs.columns and 1 <= len(rows)
    known = {tuple(r) for r in docs.collect()}
    assert all(tuple(r)[: len(docs.columns)] in known for r in rows)
    if name == "sharding":
        assert len(rows) == 9
        for s in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_stages_are_five_and_in_order():
    assert list(STAGES) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
