"""Repeated passages, whitening and filter interactions against plain versions, and the cases their docstrings define."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkaudit.llm import filter_audit, substrings, whitening
from linkaudit.llm.common import table
from linkaudit.llm.queries import QUERIES

from test_operators import CLASHING, LONG, empty, messy, rows_of

# --- repeated passages -----------------------------------------------------------------


def plain_removal(rows, window=13):
    """``(id, n_words, n_removed, kept)`` per row; a null id is larger than any other."""
    order = [(i is None, i) for i, _ in rows]
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for k, w in sorted(zip(order, words)):
        for at in range(len(w) - window + 1):
            first.setdefault(tuple(w[at : at + window]), k)
    out = []
    for k, (i, _), w in zip(order, rows, words):
        gone = bytearray(len(w))
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < k:
                gone[at : at + window] = b"\1" * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def removal(df, **options):
    return rows_of(substrings.report(df, **options).drop("longest"))


def test_passages_of_all_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    out = QUERIES["op11_substring_dedup"](spark, sf)
    assert rows_of(out.drop("longest")) == plain_removal([tuple(r) for r in docs])
    assert {r.longest for r in out.collect()} > {0, 13, 26}


def random_documents(seed):
    """Passages with edges at all places, words that repeat, and copies of whole documents."""
    rng = random.Random(seed)
    letters = "a b c d e f g h".split()
    passages = [[rng.choice(letters) + str(rng.randrange(5)) for _ in range(rng.randrange(10, 70))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randrange(1, 60)] + [f"own{i}x{rng.randrange(99)}" for _ in range(rng.randrange(3))]
        words += ["on", "and"] * rng.choice([0, 0, 20])
        rows.append((rng.choice([i, i, i, rng.randrange(120), None]), rng.choice([" ", "\n\t", "  "]).join(words)))
    return rows + [(500 + k, rows[k][1]) for k in range(0, 120, 7)] + [rows[3], rows[3]]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("window", [13, 5, 2])
def test_passages_of_random_documents(spark, seed, window):
    rows = random_documents(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removal(df, window=window) == plain_removal(rows, window)


def test_tasks_may_compare_any_number_of_rows(spark):
    rows = random_documents(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    assert removal(df, rows_at_once=50) == plain_removal(rows) == removal(df.coalesce(1))


def test_words_are_hashed_alike_in_texts_of_any_length(monkeypatch):
    texts = [b"", b" a  bb\tccc ", b"a", b"\n\n", LONG.encode(), b"\x00 \xff\xfe a"]
    whole, bounds = substrings.word_hashes(texts)
    assert np.diff(bounds).tolist() == [len(t.split()) for t in texts]
    one = {w: substrings.word_hashes([w])[0][0] for t in texts for w in t.split()}
    assert [one[w] for t in texts for w in t.split()] == whole.tolist() and len(set(one.values())) == len(one)
    monkeypatch.setattr(substrings, "_PIECE", 1000)
    pieces, again = substrings.word_hashes(texts)
    assert np.array_equal(whole, pieces) and np.array_equal(bounds, again)


def test_longest_windows_double_as_long_as_they_are_repeated(spark):
    rng = random.Random(5)
    shared = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    rows = [(k, " ".join([f"x{k}", *shared[:n], f"y{k}"])) for k, n in enumerate([700, 700, 230, 60, 12])]
    out = {r.doc_id: r.longest for r in substrings.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[4] == 0
    for k, n in enumerate([700, 700, 230, 60]):
        assert out[k] <= n < 2 * out[k] + 4 * 13 and out[k] in {13 << j for j in range(8)}


def plain_longest(rows, window=13):
    """The longest window of ``window`` words, or twice, four times as many, that a text and another one have."""
    texts = {t: t.split() for _, t in rows}
    out, length = dict.fromkeys(texts, 0), window
    while any(len(w) >= length for w in texts.values()):
        having = {}
        for t, w in texts.items():
            for at in range(len(w) - length + 1):
                having.setdefault(tuple(w[at : at + length]), set()).add(t)
        for some in having.values():
            out.update(dict.fromkeys(some if len(some) > 1 else (), length))
        length *= 2
    return out


@pytest.mark.parametrize("window, rows_at_once", [(13, 1 << 19), (13, 40), (5, 300), (2, 1 << 19)])
def test_longer_windows_are_compared_at_every_start(spark, window, rows_at_once):
    rng = random.Random(11)
    passages = [[f"p{k}x{i}" for i in range(n)] for k, n in enumerate([26, 27, 52, 53, 104, 31, 25, 51, 10, 11, 40])]
    rows = [
        (9 * k + j, " ".join([*(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(40))), *p[j % 2 :], f"e{k}x{j}", *passages[j][: 9 * j]]))
        for k, p in enumerate(passages)
        for j in range(9)
    ]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(random_documents(4))]
    exact = plain_longest(rows, window)
    found = substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window, rows_at_once=rows_at_once)
    texts = {}
    for i, t in sorted(rows):
        texts.setdefault(t, i)
    out = {r.id: r for r in found.collect()}
    for t, i in texts.items():
        first = exact[t] == window and not out[i].spans  # the smallest id of a window loses nothing
        assert out[i].longest == (0 if first else exact[t]), (i, t)


def test_passages_in_messy_and_empty_tables(spark):
    df = messy(spark)
    assert removal(df) == plain_removal([(r.doc_id, r.text) for r in df.collect()])
    out = substrings.without_repeats(df)
    assert out.columns == df.columns and out.count() == 9
    same = " ".join(f"t{i}" for i in range(30))
    rows = [(1, same), (2, "a " + same + " b"), (3, same), (None, "  " + same), (4, "few  words"), (5, None), (6, "")]
    some = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in [*CLASHING, "LO", "hi", "Kept", "__LO", "spans"]})
    texts = {r.doc_id: r.text for r in substrings.without_repeats(some).collect()}
    assert texts == {1: same, 2: "a b", 3: "", None: "", 4: "few  words", 5: None, 6: ""}
    assert substrings.report(empty(spark)).count() == 0 == substrings.without_repeats(empty(spark)).count()
    with pytest.raises(TypeError):
        substrings.report(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_one_passage_in_a_third_of_the_documents(spark):
    rng = random.Random(7)
    shared = " ".join(f"p{i}" for i in range(20))
    rows = [(k, (shared + " " if k % 3 == 0 else "") + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for k in range(600)]
    assert removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)) == plain_removal(rows)


# --- whitening -------------------------------------------------------------------------


def checked_whitening(out, vectors, wanted=4):
    """Compares with an eigendecomposition in numpy; columns may have either sign."""
    x = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in vectors.items()}
    d = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(d), d.sum(axis=0)
    values, basis = np.linalg.eigh((d - s / n).T @ (d - s / n) / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(wanted, int((values > values[0] * 1e-12).sum()))
    assert len(out) == k * len(x)
    signs = {}
    for r in sorted(out, key=lambda r: -abs(r.whitened)):
        c = r.component - 1
        y = (x[r.vec_id] - s / n) @ basis[:, c] / math.sqrt(values[c])
        sign = signs.setdefault(c, np.sign(y * r.whitened))
        assert abs(sign * r.whitened - y) < 1e-7 * max(1, abs(y))
        assert r.n == n and r.deviation == int(((n * x[r.vec_id].astype(object) - s) ** 2).sum())
        assert abs(r.explained / (values[c] / values.sum()) - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_of_all_embeddings(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    checked_whitening(QUERIES["op12_embedding_whitening"](spark, sf).collect(), {r.vec_id: r.embedding for r in rows})


@pytest.mark.parametrize("dim", [1, 2, 5, 12])
def test_whitening_of_small_tables(spark, dim):
    rng = np.random.default_rng(dim)
    vectors = {i: (rng.normal(size=dim) * np.arange(1, dim + 1)).tolist() for i in range(60)}
    rows = [*vectors.items(), *list(vectors.items())[:7], (97, None), (98, [None] * dim), (99, [float("nan")] * dim), (100, [float("inf")] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in [*CLASHING, "Y", "at", "N"]})
    out = whitening.report(df).collect()
    assert len(out) == 67 * min(4, dim)
    checked_whitening({(r.vec_id, r.component): r for r in out}.values(), vectors)


def test_whitening_of_equal_single_short_and_huge_vectors(spark):
    def run(rows):
        return whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    assert run([]) == run([(1, [0.5, 1.0])]) == run([(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == run([(1, []), (2, None)]) == []
    filled = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 2.0, 0.0]), (None, [0.0, 1.0, 3.0]), (2, [1.0, 2.0, 0.0])]
    short = [(1, [1.0]), (2, [1.0, 2.0]), (None, [0.0, 1.0, 3.0]), (2, [1.0, 2.0, 0.0])]
    assert sorted(map(repr, run(short))) == sorted(map(repr, run(filled))) and len(run(short)) == 8
    huge = run([(1, [1e12, 0.0]), (2, [0.0, 1e12]), (3, [1e12, 1e12])])
    assert {r.deviation for r in huge} == {None} and all(math.isfinite(r.whitened) for r in huge)


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0.5], [3, 2, 1, 0, 0, 0], [9] * 6, [7, 4, 4, 4, 4, 0.1], [1, 0, 0, 0, 0, 0]])
def test_bidiagonalisation_finds_repeated_and_missing_values(values):
    rng = np.random.default_rng(3)
    dim = 40
    spectrum = np.concatenate([values, np.zeros(dim - 6) if 0 in values else np.linspace(0.4, 0.01, dim - 6)])
    basis = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    gram = (basis * spectrum**2) @ basis.T
    found, vectors, steps = whitening.bidiagonalised(lambda q: gram @ q, dim, 4)
    assert np.allclose(found, sorted(spectrum)[::-1][:4], rtol=1e-9, atol=1e-7) and steps <= dim
    real = found > 1e-6
    assert np.allclose(gram @ vectors[real].T, vectors[real].T * found[real] ** 2, atol=1e-9)
    assert np.allclose(vectors[real] @ vectors[real].T, np.eye(real.sum()), atol=1e-10)


# --- filter interactions ---------------------------------------------------------------


def plain_audit(docs, labels):
    """Every document walks through every order."""
    import re

    good, toxic = ({d for d, *marks in labels if marks[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    for i, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        least = first.get(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": least is not None and (i is None or least < i),
        }
        for order in permutations("ABCDE"):
            gone = next((k for k, f in enumerate(order) if fails[f]), 5)
            for k, f in enumerate(order):
                row = out.setdefault((part or "", "".join(order), k + 1), [0] * 6)
                row[0] += k < gone
                row[1] += k == gone
                row[2] += k > gone and fails[f]
                row[3] += fails[f] and sum(fails.values()) == 1
                row[4] += k == gone and i in good
                row[5] += k == gone and i in toxic
    by_filter = {}
    for (part, order, step), row in out.items():
        key = part, order[step - 1]
        by_filter[key] = by_filter.get(key, 0) + row[1]
    return sorted((*k, *row, by_filter[k[0], k[1][k[2] - 1]]) for k, row in out.items())


def test_filters_walked_through_one_by_one(spark, sf):
    docs = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in table(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(QUERIES["op13_filter_interactions"](spark, sf)) == sorted(plain_audit(docs, labels), key=repr)


def test_filters_on_messy_hot_and_empty_tables(spark):
    marks = [(1, 1, 0), (1, 0, 1), (4, 1, None), (None, 1, 1), (3, None, None), (77, 1, 1), (2, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in CLASHING})
    df = messy(spark).withColumns({c: F.lit("x") for c in ["Mask", "DIGEST", "part", "good"]})
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert rows_of(filter_audit.report(df, labels)) == sorted(plain_audit(rows, marks), key=repr)
    assert filter_audit.report(empty(spark), labels).count() == 0
    hot = [(i % 5 if i % 3 else 2, "same text" if i % 3 else f"text {i}", "big" if i % 4 else None) for i in range(300)]
    hot += [(i, "SHOUT # " * 150, "big") for i in range(20)]
    found = filter_audit.report(spark.createDataFrame(hot, "doc_id long, text string, source string").repartition(7), labels)
    assert rows_of(found) == sorted(plain_audit(hot, marks), key=repr)


def test_removal_steps_of_any_number_of_filters():
    for letters in ("A", "AB", "ABC"):
        orders, _, step = filter_audit.removal_steps(letters)
        for mask in range(1 << len(letters)):
            for o, order in enumerate(orders):
                expected = next((k for k, f in enumerate(order) if mask >> letters.index(f) & 1), len(letters))
                assert step[mask, o] == expected
    
