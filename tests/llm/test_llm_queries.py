"""Registered queries of the subpackage against SQL or plain versions, and the pipeline stage by stage."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from check import TABLES, compare
from linkaudit.llm import mixing, quality, simhash
from linkaudit.llm.common import table
from linkaudit.llm.oracle import ORACLE
from linkaudit.llm.queries import QUERIES

from test_operators import plain_components, plain_fingerprint, plain_overlap, plain_spans


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def test_every_number_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    difference = compare(QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df())
    assert not difference, difference


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op3_hash_tree_sharding", "op6_temperature_mixing", "op10_secret_scan"])
def test_native_queries_run_no_python_and_no_nested_loops(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


def test_quality_of_held_out_rows(spark, sf, duck):
    out = QUERIES["op1_quality_classifier"](spark, sf).toPandas().set_index("doc_id")
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in out.held_out.items())
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    held = [(out.predicted[d], q) for d, q in labels.items() if out.held_out[d]]
    assert np.mean([p == q for p, q in held]) >= 0.95


def test_token_ids(spark, sf, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = QUERIES["op2_bit_plane_token_ids"](spark, sf).toPandas().set_index("doc_id")
    start = 0
    for d in sorted(documents):
        ids = np.array([*tokenizer.encode(documents[d] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert tuple(out.loc[d, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_shards(spark, sf, documents):
    out = QUERIES["op3_hash_tree_sharding"](spark, sf).toPandas()
    assert len(out) == len(documents) and set(out["shard"]) == set(range(16))
    for _, rows in out.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    assert ((out.grown_shard == out["shard"]) | (out.grown_shard == 16)).all() and (out.grown_shard == 16).any()
    for r in out.itertuples():
        data = (documents[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def plain_groups(documents):
    prints = {d: plain_fingerprint(t) for d, t in documents.items()}
    distinct = sorted(set(prints.values()))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 4]
    group = plain_components(links)
    least = {}
    for d, f in sorted(prints.items()):
        least.setdefault(group.get(f, f), d)
    return prints, {d: least[group.get(f, f)] for d, f in prints.items()}


def test_simhash(spark, sf, documents):
    prints, component = plain_groups(documents)
    out = QUERIES["op5_simhash_near_duplicates"](spark, sf).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in out} == {d: (prints[d], component[d]) for d in documents}


def test_secrets(spark, sf, documents):
    import hashlib

    for r in QUERIES["op10_secret_scan"](spark, sf).collect():
        assert r.base_sha256 == hashlib.sha256(plain_spans(documents[r.doc_id]).encode()).hexdigest()


def test_pipeline_stages_equal_plain_versions(spark, sf, duck, tmp_path):
    """Each stage is compared on its own input; what it decides takes effect in the next."""
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs, columns = table(spark, sf, "documents"), ["doc_id", "text", "lang", "source", "n_chars"]
    model = quality.train(docs, table(spark, sf, "labels"), max_rows=20_000)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        before, docs = docs.toPandas(), spark.read.parquet(str(tmp_path / name))
        after, texts = docs.toPandas(), dict(zip(before.doc_id, before.text))
        if k < 4:
            assert docs.columns == columns
            assert all(texts[r.doc_id] == r.text for r in after.itertuples())
        if name == "quality":
            scores = model.score(np.array([quality.text_features((t or "").encode()) for t in before.text]))
            assert sorted(after.doc_id) == sorted(before.doc_id[scores >= 0.5]) and len(after) < len(before)
        elif name == "near_duplicates":
            assert sorted(after.doc_id) == sorted(set(plain_groups(texts)[1].values()))
        elif name == "decontamination":
            clean = [d for d, t in texts.items() for n, hit, *_ in [plain_overlap_fast(t, items)] if not (hit and 20 * hit >= n)]
            assert sorted(after.doc_id) == sorted(clean)
        elif name == "mixing":
            expected = mixing.schedule(spark.createDataFrame(before), entropy_share=0.95, max_repeats=4.0).toPandas()
            duck.register("stage_docs", before)
            rows = duck.execute(ORACLE["op6_temperature_mixing"].replace("FROM documents", "FROM stage_docs")).df()
            assert Counter(after.doc_id) == Counter(rows.doc_id) == Counter(expected.doc_id)
        else:
            assert docs.columns == [*columns, "shard", "slot"]
            assert Counter(after.doc_id) == Counter(before.doc_id)
            assert all(sorted(g.slot) == list(range(len(g))) for _, g in after.groupby("shard"))
    assert corpus_pipeline.run(spark, sf).count() == len(after)


def plain_overlap_fast(text, items):
    """The plain overlap for the items that share a 13-word window's first word run with the text; same result, less time."""
    low = (text or "").lower()
    near = [(n, t) for n, t in items if any(w in low for w in {" ".join(t.lower().split()[i : i + 2]) for i in range(0, len(t.split()), 6)})]
    return plain_overlap(text, near, 13)


def test_entry_lists_all_queries_and_works_without_the_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {*QUERIES, "pipeline"} <= names and set(__spark_entry__.oracle_sql()) <= names
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith(("linkaudit.llm", "corpus_pipeline")) else find(n, *a))
    assert not any(n.startswith("op") or n == "pipeline" for n in __spark_entry__.queries())


def test_classes_of_fingerprints_stay_apart(spark):
    out = simhash.simhash_classes(spark.createDataFrame([(0,), (1,), (255,), (2**40,)], "fp long")).collect()
    assert {r.fp: r.class_fp for r in out} == {0: 0, 1: 0, 2**40: 0, 255: 255}
