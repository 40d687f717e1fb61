"""SimHash near-duplicates, with candidates filtered on a ring of segments.

A fingerprint is cut into ``max_bits + 1`` segments on a ring. If two fingerprints differ in at most
``max_bits`` bits, there is a segment from which every run of ``k`` segments differs in at most
``k * max_bits / (max_bits + 1)`` bits, i.e. in at most ``k - 1``: the first is equal, the first two
differ in one bit at most, and so on. Candidates are joined on the first two segments of such a run
(the second with no bit or one bit turned), the longer runs are tested next, and only what
passes all of them gets the full comparison.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkaudit.llm.common import free_name, stored
from linkaudit.llm.components import components

BITS = 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of one text in UTF-8; 0 for a text without words. Memory is bounded by the text."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=starts[1:])
    first, end = starts[: len(words) - shingle + 1], starts[shingle:] - 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(first), _BLOCK):
        spans = zip(first[at : at + _BLOCK].tolist(), end[at : at + _BLOCK].tolist())
        h = np.array([digest(line[a:b], 42) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(first)).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """Fingerprints of a text column as signed 64-bit integers; a null text has no words."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t.as_py() or b"", shingle) for t in texts]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return simhash(text.cast("binary"))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments; widths differ by one at most."""
    m = max_bits + 1
    edges = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(fingerprints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` bits (1 to 14)."""
    ring = _segments(max_bits)
    m = len(ring)
    fp = F.col("fp")

    def key(i: int) -> Column:
        (s0, w0), (s1, w1) = ring[i], ring[(i + 1) % m]
        run = F.shiftleft(_part(fp, s0, w0), w1).bitwiseOR(_part(fp, s1, w1))
        return F.shiftleft(run, 4).bitwiseOR(F.lit(i).cast("long"))

    keys = fingerprints.select("fp", F.array(*[key(i) for i in range(m)]).alias("keys"))
    index = keys.select(fp.alias("b"), F.explode("keys").alias("b_key"))
    turned = [(i, bit) for i in range(m) for bit in [0, *(1 << (k + 4) for k in range(ring[(i + 1) % m][1]))]]
    choices = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(bit).cast("long").alias("bit")) for i, bit in turned])
    probe = keys.select("fp", "keys", F.explode(choices).alias("turn")).select(
        fp.alias("a"), F.element_at("keys", F.col("turn.i")).bitwiseXOR(F.col("turn.bit")).alias("a_key")
    )
    differing = F.col("a").bitwiseXOR(F.col("b"))
    bits = [F.bit_count(_part(differing, s, w)) for s, w in ring]
    chains = F.lit(True)
    for i in range(m):  # the runs of three and more segments that begin at the segment of the key
        run, within = bits[i] + bits[(i + 1) % m], F.lit(True)
        for length in range(3, m):
            run = run + bits[(i + length - 1) % m]
            within &= run <= length - 1
        chains &= (F.col("a_key").bitwiseAND(F.lit(15)) != i) | within
    on = (F.col("a_key") == F.col("b_key")) & (F.col("a") < F.col("b")) & chains & (F.bit_count(differing) <= max_bits)
    # Spark sizes both sides as if nothing were exploded, so by itself it may broadcast them
    return probe.hint("merge").join(index.hint("merge"), on).select("a", "b").distinct()


def simhash_classes(fingerprints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(fp, class_fp)`` for each distinct ``fp``: equal fingerprints are one row, linked ones share ``class_fp``."""
    distinct = stored(fingerprints.select("fp").distinct(), "fingerprints")
    found = components(links(distinct, max_bits))
    return distinct.join(found.select(F.col("id").alias("fp"), "component"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("class_fp")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    of the documents that links of at most ``max_bits`` bits reach.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows give
    repeated results. A null id counts as larger than any other and is a component's id only if it
    has no other. An empty table gives an empty result; further columns are ignored, and their
    names do not matter.
    """
    taken = docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    taken = stored(taken, "simhash")
    per_fp = taken.groupBy("fp").agg(F.min("id").alias("first"))
    classes = simhash_classes(taken, max_bits).join(per_fp, "fp")
    least = classes.groupBy("class_fp").agg(F.min("first").alias("component_id"))
    named = stored(classes.join(least, "class_fp").select("fp", "component_id"), "classes")
    out = taken.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """The documents without near-copies: of each component, one row with its smallest id stays.

    If several rows have that id, the one with the smallest hash of its text stays, and of rows with that text the one
    with the smallest hash of all columns, once; null and empty texts are one text here. All
    columns are kept as they are. A component whose ids are all null keeps one row as well.
    """
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    taken = docs.select(F.col(id_col).alias("id"), h.alias("h"), every.alias("every"), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    taken = stored(taken, "simhash")
    # the smallest id of a fingerprint, nulls last, its text, and one of the rows alike in both
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "every")).alias("first")
    classes = simhash_classes(taken, max_bits).join(taken.groupBy("fp").agg(first), "fp")
    kept = stored(classes.groupBy("class_fp").agg(F.min("first").alias("first")).select("first.id", "first.h", "first.every"), "kept")
    id_hash, text_hash, row_hash, kept_id = (free_name(docs, n) for n in ("__id_hash", "__text_hash", "__row_hash", "__kept_id"))
    keys = kept.select(F.col("id").alias(kept_id), F.xxhash64("id").alias(id_hash), F.col("h").alias(text_hash), F.col("every").alias(row_hash))
    tagged = docs.withColumns({id_hash: F.xxhash64(F.col(id_col)), text_hash: h, row_hash: every})
    same = (tagged[id_hash] == keys[id_hash]) & (tagged[text_hash] == keys[text_hash]) & tagged[id_col].eqNullSafe(keys[kept_id])
    same &= tagged[row_hash] == keys[row_hash]
    return tagged.join(keys, same, "left_semi").dropDuplicates([id_hash, text_hash]).drop(id_hash, text_hash, row_hash)
