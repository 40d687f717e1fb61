"""Benchmark decontamination as a prefix-filtered set join with exact containment.

Each window of ``window`` consecutive item words (an item of fewer words is one window) is a set of
short shingles, all of which a document must hold to contain the window. A join that asks for all of a
set needs its rarest member only, so shingles are ordered by their count in the whole corpus, and each
window is looked up by the rarest one. A match gives the window's place in the document: the
positional bound (it may not begin before the document) and the length bound (nor end after it) come
next, then the words are compared one by one.

The index of the benchmark goes to every task. It is cut into blocks of less than twice
``block_bytes`` of text; each block has its own pass, so the index never grows with the benchmark or with one of its items:
longer items are cut into pieces with all of their windows. Only a window that is longer by itself stays whole.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkaudit.llm.common import free_name, running_total, stored

SHINGLE = 3
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_PAIRS = 1 << 16
OVERLAP = "struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<string>>"


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: A-Z in lower case, then runs of 0-9, a-z and everything beyond ASCII."""
    return text.translate(_TABLE).split()


def pieces(text: bytes, window: int, limit: int) -> Iterator[bytes]:
    """The text, or if it has more than ``limit`` bytes its words in pieces that share ``window`` - 1 words, each of at least ``window``."""
    if len(text) <= limit:
        yield text
        return
    flat = re.sub(rb" +", b" ", text.translate(_TABLE))
    start, end, n, last = 0, 0, 0, deque(maxlen=max(0, window - 1))
    for word in re.finditer(rb"[^ ]+", flat):
        if n >= window and word.end() - start > limit:
            yield flat[start:end]
            start, n = (last[0] if last else word.start()), len(last)
        last.append(word.start())
        end, n = word.end(), n + 1
    yield flat[start:end]


def _pieces_column(text: Column, window: int, limit: int) -> Column:
    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([list(pieces(t.as_py(), window, limit)) for t in texts], type=pa.list_(pa.binary()))

    return cut(text)


class Index:
    """Windows of one block of items, as arrays. ``rarest`` chooses the shingle each window is found by."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        rows, lengths, owners = [], [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                rows.append(ids[at : at + size] + [0] * (window - size))
                lengths.append(size)
                owners.append(place[name])
        table = np.array(rows, dtype=np.int64).reshape(-1, window)
        self.windows, first, inverse = np.unique(table, axis=0, return_index=True, return_inverse=True)
        self.lengths = np.array(lengths, dtype=np.int64)[first]
        owned = np.unique(np.column_stack([inverse.ravel(), owners]).reshape(-1, 2), axis=0) if rows else np.zeros((0, 2), np.int64)
        self.item_of, self.items_at = owned[:, 1], np.searchsorted(owned[:, 0], np.arange(len(self.windows) + 1))
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.lengths})
        shingles = [self._shingles(self.windows, min(SHINGLE, window))] if window else []
        self.offset_keys = shingles[0] if shingles else np.zeros((0, 0), np.int64)
        # a window shorter than a shingle has one key, that of all its words
        outside = np.arange(self.offset_keys.shape[1])[None, :] > np.maximum(self.lengths[:, None] - SHINGLE, 0)
        self.offset_keys[outside] = -1
        self.keys = np.unique(self.offset_keys[self.offset_keys >= 0])

    def _shingles(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Keys of the runs of ``size`` words along the last axis; words that are missing count as zero."""
        base = len(self.vocabulary) + 1
        n = ids.shape[-1] - size + 1
        out = np.zeros((*ids.shape[:-1], max(n, 0)), dtype=np.int64)
        for k in range(SHINGLE):
            out *= base
            if k < size and n > 0:
                out += ids[..., k : k + n]
        return out

    def encode(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], dtype=np.int64)

    def keys_in(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and keys of a document's shingles whose words all occur in the items."""
        for size in self.sizes:
            if len(ids) >= size:
                whole = np.ones(len(ids) - size + 1, dtype=bool)
                for k in range(size):
                    whole &= ids[k : k + len(whole)] > 0
                at = np.nonzero(whole)[0]
                yield at, self._shingles(ids, size)[at]

    def rarest(self, counts: dict[int, int]) -> None:
        """Choose for each window its shingle with the smallest corpus count; windows with a shingle that never occurs go."""
        n = np.array([counts.get(int(k), 0) for k in self.keys], dtype=np.int64)
        shown = self.offset_keys >= 0
        rank = np.where(shown, n[np.searchsorted(self.keys, np.where(shown, self.offset_keys, self.keys[0]))] if len(n) else 0, np.iinfo(np.int64).max)
        offset = rank.argmin(axis=1) if len(self.windows) else np.zeros(0, np.int64)
        every = np.arange(len(self.windows))
        live = every[rank[every, offset] > 0]
        prefix = self.offset_keys[live, offset[live]]
        order = np.argsort(prefix, kind="stable")
        self.window_of, self.offset_of = live[order], offset[live][order]
        self.prefixes, first = np.unique(prefix[order], return_index=True)
        self.prefix_at = np.append(first, len(order))
        del self.offset_keys, self.keys

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged spans of the words of a document inside any occurrence of a window, and the names of the items."""
        ids = self.encode(words)
        n, window = len(ids), self.windows.shape[1]
        delta, seen = np.zeros(n + 1, dtype=np.int64), set()
        for at, keys in self.keys_in(ids):
            slot = np.searchsorted(self.prefixes, keys)
            slot[slot == len(self.prefixes)] = 0
            found = self.prefixes[slot] == keys if len(self.prefixes) else np.zeros(len(keys), bool)
            at, slot = at[found], slot[found]
            many = self.prefix_at[slot + 1] - self.prefix_at[slot] if len(slot) else np.zeros(0, np.int64)
            ends = np.cumsum(many)
            total = int(ends[-1]) if len(ends) else 0
            for low in range(0, total, _PAIRS):
                pair = np.arange(low, min(total, low + _PAIRS))
                match = np.searchsorted(ends, pair, side="right")
                entry = self.prefix_at[slot[match]] + pair - (ends[match] - many[match])
                w = self.window_of[entry]
                start = at[match] - self.offset_of[entry]
                fits = (start >= 0) & (start + self.lengths[w] <= n)
                w, start = w[fits], start[fits]
                place = start[:, None] + np.arange(window)
                inside = np.arange(window) < self.lengths[w][:, None]
                same = ((ids[np.minimum(place, n - 1)] == self.windows[w]) | ~inside).all(axis=1)
                w, start = w[same], start[same]
                np.add.at(delta, start, 1)
                np.add.at(delta, start + self.lengths[w], -1)
                seen.update(np.unique(w).tolist())
        hit = np.concatenate([[0], (np.cumsum(delta)[:n] > 0).astype(np.int8), [0]])
        edge = np.diff(hit)
        spans = list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))
        names = {self.names[i] for w in seen for i in self.item_of[self.items_at[w] : self.items_at[w + 1]]}
        return spans, sorted(names)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _counted(texts: DataFrame, index: Index) -> dict[int, int]:
    """Corpus counts of the shingles of a block: each task sums what it reads. At most one row per shingle comes back."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n = np.zeros(len(own.keys) + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, keys in own.keys_in(own.encode(words_of(text.as_py() or b""))):
                    slot = np.searchsorted(own.keys, keys)
                    slot[slot < len(own.keys)] = np.where(
                        own.keys[slot[slot < len(own.keys)]] == keys[slot < len(own.keys)], slot[slot < len(own.keys)], len(own.keys)
                    )
                    n += np.bincount(slot, minlength=len(n))
        some = np.nonzero(n[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(own.keys[some]), pa.array(n[:-1][some])], names=["key", "n"])

    rows = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return {r["key"]: r["n"] for r in rows}


def _found(index: Index, docs: DataFrame, text: Column, before: str | None) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def look(text: pa.Scalar, earlier: dict | None) -> dict:
        words = words_of(text.as_py() or b"")
        spans, names = shared.value.find(words)
        if earlier:
            spans = _merged(spans + [(s["start"], s["end"]) for s in earlier["spans"]])
            names = sorted({*names, *earlier["items"]})
        return {"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "items": names}

    if before is None:

        @F.arrow_udf(OVERLAP)
        def first(texts: pa.Array) -> pa.Array:
            return pa.array([look(t, None) for t in texts], type=kind)

        return first(text.cast("binary"))

    @F.arrow_udf(OVERLAP)
    def next_block(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        return pa.array([look(t, e.as_py()) for t, e in zip(texts, earlier)], type=kind)

    return next_block(text.cast("binary"), F.col(before))


def with_overlap(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 13, into: str = "overlap", block_bytes: int = 4 << 20,
) -> DataFrame:
    """Add ``into``: the number of words, the merged spans (in words) inside any occurrence of an item's
    window, and the names of these items, sorted as text.

    A null text has no words, so no spans. Items with a null id or text or without words match nothing;
    repeated items count once; an empty benchmark finds nothing. Rows and columns of ``docs`` stay.
    """
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
    items = items.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).cast("binary").alias("text")).distinct()
    items = items.select("name", F.explode(_pieces_column(F.col("text"), window, block_bytes)).alias("text"))
    items = stored(items.withColumns({"bytes": F.length("text").cast("long"), "all": F.lit(0)}), "items")
    size = items.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    block = F.lit(0)
    if blocks > 1:
        spread = F.shiftrightunsigned(F.xxhash64("name", "text"), 12) / F.lit(float(2**52))
        items = stored(running_total(items.withColumn("draw", spread), ["all"], "draw", ["name", "text"], "bytes", "before"), "blocks")
        block = F.floor(F.col("before") / block_bytes)
    texts = docs.select(F.col(text_col).cast("binary"))
    out = docs
    for k in range(blocks):
        part = items.where(block == k)
        index = Index([(r["name"], bytes(r["text"])) for r in part.collect()], window)
        index.rarest(_counted(texts, index))
        out = out.withColumn(into, _found(index, docs, F.col(text_col), into if k else None))
        if k < blocks - 1:
            out = stored(out, "overlap")
    return out


def _n_hit(overlap: str) -> Column:
    return F.aggregate(f"{overlap}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(overlap: str = "overlap", share: int = 20) -> Column:
    """At least one word is hit, and at least one in ``share`` words."""
    n = _n_hit(overlap)
    return (n > 0) & (n * share >= F.col(f"{overlap}.n_words"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``; see ``with_overlap``."""
    renamed = docs.select(F.col(id_col).alias("__id"), F.col(options.pop("text_col", "text")).alias("__text"))
    found = with_overlap(renamed, benchmark, text_col="__text", into="overlap", **options)
    return found.select(
        F.col("__id").alias(id_col),
        F.col("overlap.n_words").alias("n_words"),
        _n_hit("overlap").alias("n_hit"),
        F.size("overlap.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("overlap.items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated("overlap").alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = free_name(docs, "overlap")
    return with_overlap(docs, benchmark, into=name, **options).where(~contaminated(name)).drop(name)
