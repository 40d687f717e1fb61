"""The operators against plain versions on small tables, and the cases their docstrings define."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from linkaudit.llm import chat, decontaminate, mixing, planes, polytope, quality, secrets, sharding, simhash, warc
from linkaudit.llm.common import free_name, running_total
from linkaudit.llm.components import components
from linkaudit.llm.files import new_file, open_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
#: Names that the operators use inside; as further columns they must not matter.
CLASHING = "id H fp Component bucket draw Key a b Overlap tokens epoch Name unit page_id up node rules label x __Bucket __total_epoch SLOT_".split()


def messy(spark):
    """Nulls, empty, repeated and very long rows, and columns with clashing names."""
    rows = [
        (1, "Some plain words about nothing at all, said once.", "en", "a", 1), (1, "Some plain words about nothing at all, said once.", "en", "a", 1),
        (2, "", "en", "a", 0), (3, None, None, None, None), (None, "a text without an id", "en", "b", 3), (None, None, "en", "b", 3),
        (4, LONG, "de", "b", 9), (5, "  \t\n ", "en", "a", 2), (6, "Some plain words about nothing at all, said once.", "en", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("other") for c in CLASHING})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain_components(pairs):
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        group[b] = a
    return {x: top(x) for x in list(group)}


# --- helpers ---------------------------------------------------------------------------


@pytest.mark.parametrize("pairs", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(3, 9), (9, 4), (7, 8), (8, 8), (None, 1)]])
def test_components_equal_a_plain_version(spark, pairs):
    found = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert found == {k: v for k, v in plain_components([p for p in pairs if None not in p and p[0] != p[1]]).items()}


def test_running_total_over_buckets(spark):
    rows = [(g, i / 100, i % 7) for g in ("a", None, "b") for i in range(100)]
    out = running_total(spark.createDataFrame(rows, "g string, d double, v long"), ["g"], "d", ["v"], "v", "before", rows_per_bucket=20).collect()
    for g in ("a", None, "b"):
        total = 0
        for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["d"]):
            assert r["before"] == total
            total += r["v"]


def test_free_names_ignore_case(spark):
    assert free_name(spark.createDataFrame([], "X int, _x int"), "x") == "__x"


# --- quality ---------------------------------------------------------------------------


def test_features_and_model_of_interacting_features():
    assert quality.text_features(b"") == [0.0] * len(quality.FEATURES)
    assert all(np.isfinite(quality.text_features(t)).all() for t in (b" ", b"\n", b"\xff\x00", LONG.encode()))
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality.fit(x[:3000], y[:3000], n_pairs=2)
    assert (0, 1) in {tuple(sorted(p[:2])) for p in model.pairs}
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_classifier_learns_only_from_labels_outside_the_held_out_rows(spark):
    good, bad = "Words follow words, as they should.", "BUY!! NOW!! $$$ ### !!"
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(200)], "doc_id long, text string")
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    labels = [(i, (i % 2) if i not in held else 1 - i % 2) for i in range(200)] + [(None, 1), (3, None), (5, 7)]
    out = quality.score_documents(docs, quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
    assert [r.doc_id for r in out if r.held_out] == held
    assert all(r.predicted == r.doc_id % 2 == (r.score >= 0.5) for r in out)


def test_rows_of_one_id_are_learned_from_once(spark, monkeypatch):
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    hot = free[0]
    rows = [(i, f"text number {i}") for i in range(40)] + [(hot, f"other text {k}") for k in range(300)] + [(hot, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)))
    for some in (rows, rows[::-1]):
        quality.train(spark.createDataFrame(some, "doc_id long, text string").repartition(7), labels)
        quality.train(spark.createDataFrame(some, "doc_id long, text string"), labels, max_rows=5)
    assert [len(x) for x, _ in seen] == [len(free), 5] * 2
    assert all(np.array_equal(a, b) for one, other in zip(seen[:2], seen[2:]) for a, b in zip(one, other))


def test_classifier_on_messy_empty_and_unlabelled_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(messy(spark), none)
    out = quality.score_documents(messy(spark), model).collect()
    assert len(out) == 9 and all(r.score == 0.5 and r.predicted == 1 for r in out)
    assert quality.score_documents(empty(spark), model).count() == 0
    assert quality.keep_good(messy(spark), model).columns == messy(spark).columns
    one_class = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int")
    assert quality.train(messy(spark), one_class).score(np.zeros((1, len(quality.FEATURES))))[0] < 0.5


# --- token files -----------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files_round_trip(spark, tmp_path, kind):
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, [5, 50_000, 2**32][i % 3], size=int(rng.integers(0, 700))).astype("<u4")) for i in range(30)] + [(None, np.zeros(0, "<u4"))]
    name, stream = new_file(str(tmp_path), "x", ".bpid")
    writer = planes.PlaneWriter(stream, block=256, kind=kind)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    every = np.concatenate([ids for _, ids in docs])
    with open_file(str(tmp_path), name) as source:
        reader = planes.PlaneReader(source)
        for (doc_id, ids), (read_id, pieces) in zip(docs, reader.documents(), strict=True):
            assert doc_id == read_id and np.array_equal(ids, np.concatenate([*pieces, np.zeros(0, "<u4")]))
        assert np.array_equal(reader.ids(300, 1111), every[300:1111]) and len(reader.ids(5, 5)) == 0


def test_words_encode_as_whole_texts_do():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = planes.Encoder(path, by_word=True, kept=50)
    pieces = ["a", "B", "é", "é", " ", "\n", ".", "!", "'s", "'", "|", "1", "½", "̇", "İ", "<|endoftext|>", " ", "日", "I", "\x1c", "-"]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(pieces, size=rng.integers(0, 14))) for _ in range(3000)] + ["", LONG, "It's, \"fine\". ABC-def!!"]
    whole = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [b for at in range(0, len(texts), 100) for b in encoder.encode([t.encode() for t in texts[at : at + 100]])] == whole


def test_token_files_of_messy_and_empty_tables(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = messy(spark)
    out = planes.written_and_read(docs, path, 2, by_word=True).orderBy("start").collect()
    expected = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect())
    assert [r.doc_id or 0 for r in out] == [e[1] for e in expected] and out[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:]))
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes())
    assert sorted(r.ids_crc32 for r in out) == sorted(crc(e[2]) for e in expected)
    assert planes.written_and_read(empty(spark), path, 2).count() == 0


# --- sharding --------------------------------------------------------------------------


def test_shards_of_messy_and_empty_tables(spark):
    out = sharding.report(messy(spark)).collect()
    assert len(out) == 9 and {r.law for r in out} == {"key"}
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 16) for r in out)
    texts = {r.doc_id: r.text or "" for r in messy(spark).collect() if r.doc_id}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in out if r.doc_id)
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.report(empty(spark)).count() == 0
    assert set(sharding.sharded(messy(spark)).columns) == {*messy(spark).columns, "shard", "slot"}


def test_rows_move_only_where_weights_change(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.tree_of(16)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree]
    out = sharding.assigned(sharding.assigned(ids, tree, into="old"), heavier, into="new").collect()
    rack = {x.shard: (x.region, x.rack) for x in tree}
    for r in out:
        if r.old != r.new:
            # into the region, the rack within it, or the shard within that; never between other shards of a level
            assert rack[r.new][0] == rack[5][0]
            assert rack[r.old][0] != rack[5][0] or rack[r.new][1] == rack[5][1]
            assert rack[r.old] != rack[5] or r.new == 5
    share = sum(r.new == 5 for r in out) / len(out)
    assert abs(share - 3 / 18) < 0.03
    with pytest.raises(ValueError):
        sharding.assigned(ids, [*tree, tree[0]])


@pytest.mark.parametrize("shards", [1, 6, 12, 20])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    docs = spark.range(2000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    out = sharding.report(docs, shards=shards).collect()
    assert {r.shard for r in out} == set(range(shards))
    assert all(r.grown_shard in (r.shard, shards) for r in out)
    assert any(r.grown_shard == shards for r in out)
    assert {r.doc_id: r.shard for r in sharding.sharded(docs, shards=shards).collect()} == {r.doc_id: r.shard for r in out}
    grown = sharding.report(docs, shards=shards + 1, first=shards if shards < 16 else 16).collect()
    assert {r.doc_id: r.shard for r in grown} == {r.doc_id: r.grown_shard for r in out}


def test_written_shards_hold_their_rows(spark, tmp_path):
    docs = sharding.sharded(spark.range(300).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text"))
    sharding.write_shards(docs, str(tmp_path / "out"), files_per_shard=2)
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).select("doc_id", "shard", "slot")) == rows_of(docs.select("doc_id", "shard", "slot"))


# --- archives --------------------------------------------------------------------------


@pytest.mark.parametrize("name,kind,value,shown", [("URL", "string", "http://x/1", "http://x/1"), ("Url", "long", 7, "7"), ("url", "string", None, "urn:page:1"), ("other", "long", 7, "urn:page:1")])
def test_addresses_of_pages_by_any_name_and_type(spark, name, kind, value, shown):
    pages = spark.createDataFrame([(1, value, "<html>" + "x" * 200)], f"page_id long, {name} {kind}, html string")
    index = warc.write_bundles(pages).collect()
    with open_file(index[0]["folder"], index[0]["file"]) as source:
        data = warc.BundleReader(source).record(index[0]["frame"], index[0]["offset"], index[0]["length"])
    assert warc.parse(data)["fields"]["WARC-Target-URI"] == shown


def plain_shard(doc_id, tree):
    """The descent over the tree, one level after the other."""

    def draw(path, weight):
        digest = hashlib.md5(f"shard:{path}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
        return -np.log((int(digest[:13], 16) + 0.5) / 2.0**52) / weight

    leaves, path = tree, ""
    for level in (lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: str(x.shard)):
        names = sorted({level(x) for x in leaves})
        weight = {n: sum(x.weight for x in leaves if level(x) == n) for n in names}
        chosen = min(names, key=lambda n: (draw(f"{path}/{n}", weight[n]), n))
        leaves, path = [x for x in leaves if level(x) == chosen], chosen
    return leaves[0].shard


def test_shards_equal_a_plain_descent(spark):
    ids = [*range(400), None, -1, 10**15]
    out = sharding.report(spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")).collect()
    for r in out:
        assert r["shard"] == plain_shard(r.doc_id, sharding.tree_of(16)) and r.grown_shard == plain_shard(r.doc_id, sharding.tree_of(17))
    uneven = [sharding.Leaf("a", "x", 0, 3.0), sharding.Leaf("a", "y", 1), sharding.Leaf("b", "x", 5, 0.5), sharding.Leaf("b", "x", 7, 2.0)]
    rows = sharding.assigned(spark.createDataFrame([(i,) for i in ids], "doc_id long"), uneven).collect()
    assert all(r["shard"] == plain_shard(r.doc_id, uneven) for r in rows) and {r["shard"] for r in rows} == {0, 1, 5, 7}


def test_bundles_are_read_by_frame_and_as_a_stream(tmp_path):
    import zstandard

    name, stream = new_file(str(tmp_path), "x", ".warc.zst")
    writer = warc.BundleWriter(stream, frame_bytes=2000, level=3)
    records = [warc.record(i, f"http://x/{i}\r\nY: 1", b"p" * (i * 37), "d", i - 1 if i % 3 == 2 else None, "1970-01-01T00:00:00Z") for i in range(40)]
    places = [writer.add(r) for r in records]
    writer.close()
    assert places[-1][0] > 5
    with open_file(str(tmp_path), name) as source:
        reader = warc.BundleReader(source)
        assert [reader.record(*p, len(r)) for p, r in zip(places, records)] == records
    raw = (tmp_path / name).read_bytes()
    magic, size = struct.unpack("<II", raw[-9 - 8 * len(writer.frames) - 8 :][:8])
    assert magic == 0x184D2A5E and size == 9 + 8 * len(writer.frames)
    plain = b"".join(zstandard.ZstdDecompressor().decompress(raw[a : a + n]) for a, n, _ in reader.places)
    assert plain == b"".join(records)
    assert "Y" not in warc.parse(records[1])["fields"]


def test_archives_of_messy_and_empty_tables(spark):
    body = "<p>" + "x" * 120
    rows = [(5, "u", body), (3, None, body), (3, "v", body), (None, "w", body), (8, "a\r\nb", "short"), (9, "u", "short"), (10, "u", None), (11, "u", ""), (12, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "first", "payload", "long")})
    out = warc.written_and_read(pages).collect()
    assert len(out) == len(rows)
    texts = {p: h or "" for p, _, h in rows}
    for r in out:
        payload = texts[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in out)
    assert kinds[:4] == [(0, "revisit", 3), (3, "response", None), (3, "response", None), (5, "revisit", 3)]
    assert all(k[1] == "response" for k in kinds[4:])
    assert warc.written_and_read(pages.limit(0)).count() == 0


# --- fingerprints ----------------------------------------------------------------------


def plain_fingerprint(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO three four", "Ää b c d e f", LONG, "a b c d " * 40, "x\x00y \x0b z w v u"])
def test_fingerprint_equals_a_plain_version(spark, text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("max_bits", [1, 3, 4, 7])
def test_links_equal_all_pairs(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    near = {0, 2**64 - 1}
    for center in rng.integers(0, 2**63, size=12):
        for _ in range(25):
            flips = rng.choice(64, size=rng.integers(0, max_bits + 3), replace=False)
            near.add(int(center) ^ sum(1 << int(k) for k in flips))
    signed = [f - 2**64 if f >= 2**63 else f for f in near]
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= max_bits}
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), max_bits).collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_what_is_exploded_for_links_is_not_broadcast(spark, tmp_path):
    """A row becomes 70 for the join; from a small file Spark would send them all to every executor."""
    spark.range(2000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fp"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fp")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_duplicates_of_messy_and_empty_tables(spark):
    out = simhash.near_duplicates(messy(spark)).collect()
    of = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    assert len(out) == 9 and {of[d, "0" * 16] for d in (2, 3, 5, None)} == {2}
    assert {r.component_id for r in out if r.doc_id in (1, 6)} == {1}
    kept = simhash.keep_one_per_group(messy(spark)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 4]
    assert simhash.keep_one_per_group(messy(spark)).columns == messy(spark).columns
    assert simhash.near_duplicates(empty(spark)).count() == simhash.keep_one_per_group(empty(spark)).count() == 0


# --- mixing ----------------------------------------------------------------------------


def test_weights_meet_the_aim_and_budgets(spark):
    rows = [(i, "big" if i % 4 else f"s{i % 5}", "x" * (4 * (i % 9))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.schedule(docs, blocks=8, entropy_share=0.9, max_repeats=2.0).toPandas()
    share = out.groupby("source").tokens.sum() / out.tokens.sum()
    natural = {s: 0 for _, s, _ in rows}
    for _, s, t in rows:
        natural[s] += len(t) // 4 + 1
    repeats = out.groupby("source").tokens.sum() / np.array([natural[s] for s in sorted(natural)])
    entropy = -(share * np.log(share)).sum() / np.log(len(share))
    assert repeats.max() < 2.01 and (abs(entropy - 0.9) < 0.01 or repeats.max() > 1.98)
    assert abs(out.tokens.sum() / sum(natural.values()) - 1) < 0.01
    whole = out[out.epoch == 0].groupby("source").doc_id.nunique()
    assert all(whole[s] == sum(r[1] == s for r in rows) for s in share.index if repeats[s] > 1)
    by_block = out.groupby(["block", "source"]).tokens.sum().unstack()
    assert (abs(by_block.div(by_block.sum(axis=1), axis=0) - share) < 0.03).all().all()
    # the same documents as rows
    kept = mixing.mixed(docs, entropy_share=0.9, max_repeats=2.0).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in kept} == out.groupby("doc_id").size().to_dict()


def test_cut_is_found_in_any_slice(spark):
    rows = spark.range(2000).selectExpr("id", "IF(id % 3 = 0, 'a', 'b') AS source", "id % 5 + 1 AS tokens")
    plans = [mixing.mixing_plan(rows, budget=3000, entropy_share=None, max_repeats=None, rows_per_slice=n).collect() for n in (10, 300, 5000)]
    assert sorted(plans[0]) == sorted(plans[1]) == sorted(plans[2])


def test_mixing_of_messy_and_empty_tables(spark):
    out = mixing.schedule(messy(spark), entropy_share=None, max_repeats=None).collect()
    assert len(out) == 9 and {r.source for r in out} == {"a", "b", "c", None}
    assert mixing.mixed(messy(spark)).columns == messy(spark).columns
    assert mixing.schedule(empty(spark)).count() == mixing.mixed(empty(spark)).count() == 0


# --- vectors ---------------------------------------------------------------------------


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(5, 64))
    assert np.allclose(polytope.hadamard(polytope.hadamard(x)), 64 * x)
    assert np.allclose(np.linalg.norm(polytope.rotated(x[:, :50], 1, 0), axis=1), np.linalg.norm(x[:, :50], axis=1))


def test_recall_at_the_threshold_and_no_false_link(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.88, 0.92, size=(400, 1))
    every = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * other])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r.n_links for r in polytope.near_duplicates(table, tables=8, parts=2).collect()}
    units = every / np.linalg.norm(every, axis=1, keepdims=True)
    degree = (units @ units.T >= 0.9).sum(axis=1) - 1
    assert all(out[i] <= degree[i] for i in range(800))
    assert sum(out.values()) >= 0.98 * degree.sum()


@pytest.mark.parametrize(("n", "parts"), [(500, 2), (16_385, 3), (2_097_153, 4)])
def test_recall_at_the_threshold_is_the_same_for_any_number_of_vectors(n, parts):
    found, tables = polytope.scheme(n, 64, threshold=0.9, tables=12, probes=4)
    assert found == parts
    x, y = polytope.pairs_at(0.9, 2000, 64, seed=5)
    met = np.zeros(2000, dtype=bool)
    for t in range(tables):
        met |= polytope.meet(x, y, t, parts, 4)
    assert met.mean() >= 0.998


def test_links_of_a_small_table_are_found_with_the_keys_of_a_large_one(spark):
    x, y = polytope.pairs_at(0.901, 300, 64, seed=6)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = polytope.near_duplicates(table, parts=4).collect()
    assert sum(r.n_links for r in out) >= 2 * 299
    # without hashes that find enough, every pair is compared
    assert polytope.scheme(50, 64, -0.95, 12, 4) == (0, 1)
    out = polytope.near_duplicates(table.limit(50), threshold=-0.95).collect()
    assert {r.n_links for r in out} == {49} and {r.component_id for r in out} == {min(r.vec_id for r in out)}


def test_vectors_of_messy_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1e300, 1e300]), (10, [1e-300, 1e-300]), (11, [1.0, 0.0, 0.0]), (None, [-0.0, -1.0]), (12, [0.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("unit", "name", "class", "n", "keys")})
    out = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in polytope.near_duplicates(table).collect()))
    assert out == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
                          (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False), (11, 0, 11, True), (0, 1, 12, False), (12, 1, 12, True)])
    assert polytope.near_duplicates(table.limit(0)).count() == 0


# --- decontamination -------------------------------------------------------------------


def plain_overlap(text, items, window):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w[i : i + size]:
                    hit.update(range(at, at + size))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_overlap_equals_a_plain_version(spark, block_bytes):
    rng = np.random.default_rng(5)
    vocabulary = ["der", "Die", "das", "über", "x1", "cat", "mat"]
    say = lambda n: " ".join(rng.choice(vocabulary, size=n))
    items = [(i, say(int(rng.integers(0, 9)))) for i in range(12)] + [(10, say(7)), (10, say(7)), (None, "der"), (99, None), (50, "solo"), (51, "two words")]
    texts = [say(int(rng.integers(0, 60))) for _ in range(30)] + [f"{say(5)}, {t}! {say(4)}" for _, t in items if t] + ["", None, "SOLO", "two words two words", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.report(docs, benchmark, window=5, block_bytes=block_bytes).collect()
    known = [(n, t) for n, t in items if n is not None and t is not None]
    for r in out:
        expected = plain_overlap(texts[r.doc_id], known, 5)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == expected, texts[r.doc_id]
        assert r.contaminated == (expected[1] > 0 and 20 * expected[1] >= expected[0])


def test_long_items_are_cut_into_blocks_of_bounded_size(spark, monkeypatch):
    words = [f"w{i}" for i in range(600)]
    blocks, made = [], decontaminate.Index.__init__
    monkeypatch.setattr(decontaminate.Index, "__init__", lambda self, items, window: blocks.append(sum(len(t) for _, t in items)) or made(self, items, window))
    benchmark = spark.createDataFrame([(1, " -- ".join(words)), (2, "w1 other words")], "item_id long, text string")
    texts = [" ".join(words), " ".join(words[297:302]), " ".join(words[100:104]), "other w1 other words", " ".join(words[::-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontaminate.report(docs, benchmark, window=5, block_bytes=1200).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items) for r in out] == [(600, 1), (5, 1), (0, 0), (3, 1), (0, 0)]
    assert len(blocks) > 1 and max(blocks) < 2400
    for window in (1, 2, 5):
        parts = [p.split() for p in decontaminate.pieces(texts[0].encode(), window, 50)]
        cut = [tuple(p[i : i + window]) for p in parts for i in range(len(p) - window + 1)]
        whole = texts[0].encode().split()
        assert cut == [tuple(whole[i : i + window]) for i in range(len(whole) - window + 1)]


def test_decontamination_of_messy_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "plain words about nothing")], "item_id long, text string")
    kept = decontaminate.keep_clean(messy(spark), items)
    assert kept.columns == messy(spark).columns and kept.count() == 6
    assert decontaminate.report(messy(spark), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(empty(spark), items).count() == 0


# --- chats -----------------------------------------------------------------------------


@pytest.mark.parametrize("role, text", [("user", "</s>[INST] ok [/INST]"), ("a\nb\\", "\\<|im_end|>\n<|im_start|>x"), ("", ""), ("<s>", "<\\s> \\\\ <<SYS>> <</SYS>>\\")])
def test_template_is_reversible_and_holds_no_marks(role, text):
    formatted, loss = chat.format_turns([(role, text), ("assistant", text), ("assistant", "")])
    assert chat.read_turns(formatted) == [(role, text), ("assistant", text), ("assistant", "")]
    assert formatted.count(chat.START) == formatted.count(chat.END) == 3
    assert not any(c in formatted for c in chat.CONTROL if c not in (chat.START, chat.END))
    assert [chat.unescaped(formatted[a:b]) for a, b in loss] == [text, ""]


def test_best_branches_of_trees(spark):
    nodes = [("c", 1, None, 1.0), ("c", 2, 1, 5.0), ("c", 3, 1, 0.0), ("c", 4, 3, 20.0), ("c", 5, 2, 1.0), ("c", 6, 77, 9.0), ("d", 1, 2, 1.0), ("d", 2, 1, 1.0), ("d", 3, 2, 1.0),
             (None, 1, None, 0.0), (None, 2, 1, 0.0)] + [("e", i, i - 1, 0.0) for i in range(1, 40)]
    table = spark.createDataFrame(nodes, "conv string, node long, parent long, score double")
    said = table.withColumns({"role": F.when(F.col("node") % 2 == 1, "user").otherwise("assistant"), "text": F.concat(F.lit("t"), "node")})
    out = {(r.conv, r.rank): [t for _, t in chat.read_turns(r.formatted.text)] for r in chat.format_trees(said, branches=2).collect()}
    assert out["c", 1] == ["t6"] and out["c", 2] == ["t1", "t3", "t4"]
    assert out[None, 1] == ["t1", "t2"] and out["e", 1] == [f"t{i}" for i in range(1, 40)]
    assert not any(conv == "d" for conv, _ in out)  # a circle has no root


def test_chats_of_messy_and_empty_tables(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", LONG), (1, 1, "assistant", LONG), (None, 0, "user", "a"), (None, None, "user", "b"), (2, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("conv", "node", "score", "up")})
    out = {r.conv_id: r for r in chat.report(table).collect()}
    assert out[1].n_turns == 4 and out[1].loss_chars == 2 * len(LONG)
    assert out[1].turns_sha256 == hashlib.sha256(f"user\n\n\nx\nassistant\n{LONG}\nassistant\n{LONG}\n".encode()).hexdigest()
    assert out[None].turns_sha256 == hashlib.sha256(b"user\nb\nuser\na\n").hexdigest() and out[None].loss_chars == 0
    assert out[2].n_turns == 1 and chat.report(table.limit(0)).count() == 0


# --- secrets ---------------------------------------------------------------------------


def plain_spans(text):
    kinds = [
        (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("[0-9a-f]{24,}") is None and q("ab") is None and q("a|bcd") is None and q("(abc)?") is None
    assert q("AKIA[A-Z0-9]{16,}") == {frozenset({"aki", "kia"})}
    assert q("abc.*def") == {frozenset({"abc", "def"})} and q("(abc|xyz)+") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert q("x[12]yz") == {frozenset({"x1y", "1yz"}), frozenset({"x2y", "2yz"})}


def test_spans_equal_a_plain_version(spark):
    texts = [
        "secret=token:abcdef1 token: abc password=xyzxyz", "API_KEY = 'abcdef' é\U0001f600 apikey:1234567", "AKIAAKIA" + "A" * 16 + " AKIAB", "ak AKIA" + "9" * 15,
        "deadbeef" * 3 + "x" + "0" * 23 + "\n" + "f" * 50, "token" * 20 + '":  "' + "a" * 40, "ghp_" + "a" * 36, "no secrets at all", "", None, LONG + " password: hunter22 " + LONG,
        "token=" + "ab" * 30_000, "-----BEGIN RSA PRIVATE KEY-----\ntoken=abcdefg",
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])], "doc_id long, text string")
    out = secrets.report(docs.withColumns({c: F.lit(1) for c in ("id", "h", "rules", "place")})).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        expected = plain_spans(texts[1 if r.doc_id is None else r.doc_id])
        assert r.base_sha256 == hashlib.sha256(expected.encode()).hexdigest()
        kinds = [s.split(":")[0] for s in expected.split(",")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert set(filter(None, expected.split(","))) <= set(r.spans.split(","))
    assert any("github:0:40" in r.spans for r in out) and any("pem:0:31" in r.spans for r in out)
    assert secrets.report(docs.limit(0)).count() == 0


def test_of_rows_alike_in_id_and_text_the_same_one_stays(spark):
    rows = [(1, "a b c d e", s) for s in "xyzw"] + [(2, "a b c d e", "v"), (3, None, "n"), (3, "", "e"), (3, None, "m")]
    kept = set()
    for seed in range(4):
        docs = spark.createDataFrame(rows[seed:] + rows[:seed], "doc_id long, text string, source string").repartition(1 + seed)
        kept.add(tuple(rows_of(simhash.keep_one_per_group(docs))))
    (only,) = kept
    assert len(only) == 2 and {r[0] for r in only} == {1, 3}
