"""Exact substring dedup by level-wise doubling.

Passages are compared as windows of words, level by level. The first level has half the length of a window: of the eight or
so short windows inside each full one only the one with the smallest hash is taken, which equal windows choose alike, so about two in
nine words are looked at and nothing is lost. Windows whose chosen half occurs in another text are extended to
the full length and compared by 128 bits within a task and 96 between tasks; these decide what is removed. From there on the length doubles: every start of a
window of 2, 4, 8 and so on lengths is compared whose full windows another text has, too. A longer window is sent as 32 bits below the 64 of the
smallest full window in it, which equal windows choose alike; that gives the length of the longest passages.

Equal texts are one throughout (all but the first go as a whole). Tasks compare what they hold among themselves first and send one row for each window
on, so a passage that a third of all documents share is a row per task and not a row per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkaudit.llm.common import free_name, stored

_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_PIECE = 1 << 20
#: Odd multipliers of the polynomial hashes, and those that mix a word's bits.
_BYTE, _WORD, _OTHER = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Rows that a task compares among themselves, and bytes of compressed texts that it keeps for that.
ROWS_AT_ONCE, _KEPT = 1 << 19, 16 << 20
#: How hard zstd tries: 3.4 % less than at level 3 on the texts of ``check_s``.
_LEVEL = 6
#: The id of a document whose id is null: larger than any other.
_LAST = (1 << 63) - 1


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the byte multiplier and of its inverse, made once in a worker."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            inverse = np.uint64(pow(int(_BYTE), -1, 1 << 64))
            cls.up, cls.down = _powers(_BYTE, n), _powers(inverse, n)
        return cls.up, cls.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the place of each text's first word, with the end.

    A word's hash is a polynomial of its bytes, taken from running sums over a piece of text. Pieces end between
    words and have about ``_PIECE`` bytes, so memory is bounded by the words, not by a text.
    """
    hashes, bounds = [], [0]
    group: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if group:
            h, firsts = _hash_piece(group)
            bounds.extend((bounds[-1] + firsts[1:]).tolist())
            hashes.append(h)
            group.clear()
            held = 0

    for text in texts:
        if len(text) <= _PIECE:
            group.append(text)
            held += len(text)
            if held >= _PIECE:
                flush()
            continue
        flush()
        n, at = 0, 0
        while at < len(text):
            end = at + _PIECE
            while end < len(text) and _IN_WORD[text[end]]:
                end += 1
            h, _ = _hash_piece([text[at:end]])
            hashes.append(h)
            n, at = n + len(h), end
        bounds.append(bounds[-1] + n)
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(bounds, dtype=np.int64)


def _hash_piece(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[1:] = _IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = _Tables.of(max(2 * _PIECE, len(data) + 1))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return mixed((total[ends] - total[starts]) * down[starts]), firsts


def windows(h: np.ndarray, size: int, base: np.uint64 = _WORD) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    out = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for k in range(size):
        out *= base
        out += h[k : k + len(out)]
    return mixed(out)


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    width = 1
    while width < size and len(x):
        step = min(width, size - width)
        x = best(x[: max(0, len(x) - step)], x[step:])
        width += step
    return x


def _owner(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def chosen_halves(h: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each full window of a text: its start, its text, and the smallest hash of the half-length windows in it."""
    half = max(1, window // 2)
    least = _sliding(windows(h, half), window - half + 1, np.minimum)
    owner = _owner(bounds)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= bounds[owner + 1])
    return at, owner[at], least[at]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# --- the first level -----------------------------------------------------------------


def _halves(window: int, rows_at_once: int):
    """Rows of the first level: ``hash`` and ``lo``. ``flags`` has 1 if several texts of the task have it, and 2 in a row for each of these texts."""
    names = ["hash", "lo", "salt", "flags"]

    def combined(hashes: list[np.ndarray], owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, lo = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((lo, h))
        h, lo = h[order], lo[order]
        new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        fresh = new | np.r_[True, lo[1:] != lo[:-1]] if len(h) else new
        h, lo, new = h[fresh], lo[fresh], new[fresh]
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(h) else new
        for rows, live in ((new, False), (several, True)):
            n = int(rows.sum())
            salt = pa.array(lo[rows]) if live else pa.nulls(n, pa.int64())
            columns = [pa.array(_signed(h[rows])), pa.array(lo[rows]), salt, pa.array(several[rows].astype(np.int8) + np.int8(2 * live))]
            if n:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: set[int] = set()
        held = 0
        for batch in batches:
            los, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(los), 256):
                fresh = {lo: t for lo, t in zip(los[at : at + 256], texts[at : at + 256]) if lo not in seen}
                seen.update(fresh)
                h, bounds = word_hashes(list(fresh.values()))
                _, owner, least = chosen_halves(h, bounds, window)
                mine = np.fromiter(fresh, dtype=np.int64, count=len(fresh))[owner]
                kept = np.r_[True, (least[1:] != least[:-1]) | (mine[1:] != mine[:-1])] if len(least) else np.zeros(0, bool)
                hashes.append(least[kept])
                owners.append(mine[kept])
                held += int(kept.sum())
                if held >= rows_at_once:
                    yield from combined(hashes, owners)
                    hashes, owners, seen, held = [], [], set(), 0
        if hashes:
            yield from combined(hashes, owners)

    return run, "hash long, lo long, salt long, flags byte"


def _live_halves(texts: DataFrame, window: int, rows_at_once: int) -> DataFrame:
    """``(lo, hashes)``: the chosen halves of a text that another text has, too."""
    rows = texts.select("lo", "text").mapInArrow(*_halves(window, rows_at_once))
    same = Window.partitionBy("hash", "salt")
    shared = (F.max("flags").over(same) > 0) | (F.min("lo").over(same) != F.max("lo").over(same))
    found = rows.withColumn("shared", shared).where("shared")
    return found.groupBy("lo").agg(F.collect_set("hash").alias("hashes"))


# --- distinct texts ------------------------------------------------------------------


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a task as one row with their smallest id, compressed."""
    pack = zstandard.ZstdCompressor(level=_LEVEL).compress
    held: dict[tuple[int, int], list] = {}
    size = 0

    def rows() -> pa.RecordBatch:
        ids, blobs = zip(*held.values())
        lo, hi = zip(*held)
        columns = [pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lo", "hi", "id", "blob"])

    for batch in batches:
        for lo, hi, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            known = held.get((lo, hi))
            if known:
                known[0] = min(known[0], doc)
            else:
                held[lo, hi] = [doc, pack(text)]
                size += len(held[lo, hi][1]) + 200
            if size > _KEPT:
                yield rows()
                held.clear()
                size = 0
    if held:
        yield rows()


def _distinct(texts: DataFrame) -> DataFrame:
    """One row per text: ``lo``, ``hi``, the smallest ``id`` and the text as ``blob``; dealt by ``lo``."""
    once = texts.select("lo", "hi", "id", "text").mapInArrow(_once, "lo long, hi long, id long, blob binary")
    # the filter is what an inner join would add: with it, all uses in one plan have the same exchange
    return once.where("lo IS NOT NULL").repartition("lo").groupBy("lo", "hi").agg(F.min("id").alias("id"), F.first("blob").alias("blob"))


# --- full windows --------------------------------------------------------------------

_FULL = "h1 long, mark long, lo long, id long, kind byte"
#: Kinds of rows: a window to compare; one in a run that no other text of the task has; a run of starts that are removed; a start that shares the
#: fate of another; a run of starts that may hold longer windows.
_PROBE, _LONE, _GONE, _ALIAS, _LONGER = range(5)


def _full_windows(window: int, rows_at_once: int):
    """Compares the live windows of the texts in a task and says what is left to compare with other tasks.

    ``mark`` has 32 further bits of the window's hash above its start or, in rows that are not compared, another start.
    """
    schema = pa.schema(list(zip(["h1", "mark", "lo", "id", "kind"], [pa.int64()] * 4 + [pa.int8()])))

    def batch_of(kind, lo, doc, start, end=None, h1=None, h2=None) -> pa.RecordBatch:
        """Rows that are not compared are dealt by their text."""
        above = end.astype(np.int64) if h2 is None else _signed(h2) >> 32
        kinds = np.broadcast_to(np.int8(kind) if np.isscalar(kind) else kind, len(lo))
        columns = [pa.array(x) for x in (lo if h1 is None else _signed(h1), above << 32 | start, lo, doc, kinds)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def taken(los, ids, blobs, halves):
        """The live windows of some texts, their hashes and places, which are in runs long enough for twice the length, and the first and last of these runs."""
        unpack = zstandard.ZstdDecompressor().decompress
        texts = [unpack(b) for b in blobs]
        h, bounds = word_hashes(texts)
        at, owner, least = chosen_halves(h, bounds, window)
        mark = mixed(np.arange(len(texts), dtype=np.uint64) + np.uint64(1))
        keys = np.concatenate([np.array(x, dtype=np.int64).view(np.uint64) ^ mark[i] for i, x in enumerate(halves)])
        live = np.isin(least ^ mark[owner], keys)
        at, owner = at[live], owner[live]
        begin = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + 1]) if len(at) else at
        last = np.r_[begin[1:] - 1, len(at) - 1] if len(at) else at
        runs = last - begin >= window
        doc = np.array(ids, dtype=np.int64)[owner]
        lo = np.array(los, dtype=np.int64)[owner]
        return windows(h, window)[at], windows(h, window, _OTHER)[at], lo, doc, at - bounds[owner], np.repeat(runs, last + 1 - begin), begin[runs], last[runs]

    def compared(parts: list) -> Iterator[pa.RecordBatch]:
        h1, h2, lo, doc, start, inside = (np.concatenate([p[k] for p in parts]) for k in range(6))
        if not len(h1):
            return
        order = np.lexsort((start, lo, doc, h2, h1))
        h1, h2, lo, doc, start, inside = (x[order] for x in (h1, h2, lo, doc, start, inside))
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        lone = inside & ~np.logical_or.reduceat(lo != lo[heads][group], heads)[group]
        gone = doc > doc[heads][group]
        own = np.r_[True, new[1:] | (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1])]
        probe, alias = own & ~gone, ~own & ~gone
        yield batch_of(np.where(lone[probe], np.int8(_LONE), np.int8(_PROBE)), lo[probe], doc[probe], start[probe], None, h1[probe], h2[probe])
        if alias.any():
            first = np.maximum.accumulate(np.where(own, np.arange(len(own)), 0))[alias]
            yield batch_of(_ALIAS, lo[alias], doc[alias], start[alias], start[first])
        if gone.any():
            by_place = np.lexsort((start[gone], doc[gone], lo[gone]))
            l, d, s = (x[gone][by_place] for x in (lo, doc, start))
            begin = np.flatnonzero(np.r_[True, (l[1:] != l[:-1]) | (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)])
            last = np.r_[begin[1:] - 1, len(s) - 1]
            yield batch_of(_GONE, l[begin], d[begin], s[begin], s[last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                parts.append(taken(*(c.to_pylist() for c in some.columns)))
                held += len(parts[-1][0])
                *_, lo, doc, start, _, begin, last = parts[-1]
                if len(begin):
                    yield batch_of(_LONGER, lo[begin], doc[begin], start[begin], start[last])
                if held >= rows_at_once:
                    yield from compared(parts)
                    parts, held = [], 0
        if parts:
            yield from compared(parts)

    return run, _FULL


def _running(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Running polynomial hashes of the words: each is the one before times the multiplier and the word."""
    inverse = np.uint64(pow(int(_WORD), -1, 1 << 64))
    n = len(h)
    return np.cumsum(h * _powers(inverse, n + 1)[1:]) * _powers(_WORD, n + 1)[1:]


# --- longer windows ------------------------------------------------------------------


def _longer(window: int, rows_at_once: int):
    """Compares the windows of 2, 4, 8 and so on lengths in the runs of a task, at every start, and says what is left to compare with other tasks.

    A row has the smallest full window (``key``, with the length mixed in) of some longer windows and 32 bits of each of these, ``bits``: those that
    only text ``lo`` of the task has or, where ``lo`` is null, several. Rows without ``bits`` tell what is known: ``lo`` has a repeated window of ``longest`` words.
    """
    names = ["key", "lo", "longest", "bits"]

    def taken(los, blobs) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor().decompress
        runs = [unpack(b).split(b"\n") for b in blobs]
        h, bounds = word_hashes([r for of in runs for r in of])
        lo = np.repeat(np.array(los, dtype=np.int64), list(map(len, runs)))
        owner, full = _owner(bounds), windows(h, window)
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        total[1:] = _running(h, bounds)
        left, length = bounds[owner + 1] - np.arange(len(h)), 2 * window
        while True:
            at = np.flatnonzero(left >= length)
            if not len(at):
                break
            least = _sliding(full, length - window + 1, np.minimum)[at]
            value = mixed(total[at + length] - total[at] * np.uint64(pow(int(_WORD), length, 1 << 64)))
            yield mixed(least + np.uint64(length)), value >> np.uint64(32), lo[owner[at]], np.full(len(at), length, dtype=np.int32)
            length *= 2

    def batch_of(key, lo, longest, bits=None) -> pa.RecordBatch:
        lists = pa.nulls(len(key), pa.list_(pa.int32())) if bits is None else bits
        return pa.RecordBatch.from_arrays([pa.array(key), lo, pa.array(longest), lists], names=names)

    def lists(key, bits, longest, lo=None) -> pa.RecordBatch:
        """One row for each key and text; rows come in their order."""
        new = key[1:] != key[:-1]
        begin = np.flatnonzero(np.r_[True, new if lo is None else new | (lo[1:] != lo[:-1])])
        offsets = pa.array(np.r_[begin, len(key)].astype(np.int32))
        values = pa.ListArray.from_arrays(offsets, pa.array(bits.astype(np.uint32).view(np.int32)))
        return batch_of(_signed(key[begin]), pa.nulls(len(begin), pa.int64()) if lo is None else pa.array(lo[begin]), longest[begin], values)

    def compared(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, bits, lo, longest = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((lo, bits, key))
        key, bits, lo, longest = (x[order] for x in (key, bits, lo, longest))
        new = np.r_[True, (key[1:] != key[:-1]) | (bits[1:] != bits[:-1])]
        group = np.cumsum(new) - 1
        several = np.logical_or.reduceat(lo != lo[new][group], np.flatnonzero(new))[group]
        if several.any():
            known, at = np.unique(lo[several], return_inverse=True)
            most = np.zeros(len(known), dtype=np.int32)
            np.maximum.at(most, at, longest[several])
            yield batch_of(known, pa.array(known), most)
            yield lists(*(x[several & new] for x in (key, bits, longest)))
        once = np.flatnonzero(new & ~several)
        if len(once):
            once = once[np.lexsort((lo[once], key[once]))]
            yield lists(*(x[once] for x in (key, bits, longest, lo)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for part in taken(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    parts.append(part)
                    held += len(part[0])
                    if held >= rows_at_once:
                        yield from compared(parts)
                        parts, held = [], 0
        if parts:
            yield from compared(parts)

    return run, "key long, lo long, longest int, bits array<int>"


def _longest(runs: DataFrame, window: int, rows_at_once: int) -> DataFrame:
    """``(lo, longest)`` of the texts that have a repeated window of twice the length or more; ``runs`` has ``lo`` and the words of its runs, ``again``."""
    rows = runs.select("lo", "again").where("again IS NOT NULL").mapInArrow(*_longer(window, rows_at_once)).repartition("key")
    same = Window.partitionBy("key", "part")
    each = rows.select("key", "lo", "longest", F.explode_outer("bits").alias("part"))
    known = F.col("part").isNull() | (F.max(F.col("lo").isNull()).over(same)) | (F.min("lo").over(same) != F.max("lo").over(same))
    return each.withColumn("known", known).where("known AND lo IS NOT NULL").groupBy("lo").agg(F.max("longest").alias("longest"))


# --- the operator --------------------------------------------------------------------


def _removed(window: int, with_text: bool):
    """Applies the decisions to the texts; ``kept`` is the rest of the text, or its SHA-256 if only that is wanted.

    ``again`` has the words of the runs that hold longer windows, a line for each run, compressed.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = ["lo", "hi", "id", "n_words", "spans", "kept", "again"]

    def filled(start: np.ndarray, end: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
        return np.cumsum(np.bincount(start[which], minlength=n) - np.bincount(end[which] + 1, minlength=n)) > 0

    def one(text: bytes, places: np.ndarray) -> tuple[int, list, bytes, bytes | None]:
        words, spans, again = text.split(), [], None
        if len(places):
            kind, start, end = ((places >> k & (1 << 30) - 1) for k in (60, 30, 0))
            alias, n = kind == _ALIAS, len(words) + 1
            gone = filled(start, end, (kind == _PROBE) | (kind == _GONE), n)
            gone[start[alias]] |= gone[end[alias]]
            if (kind == _LONGER).any():
                alone = filled(start, end, kind == _LONE, n)
                alone[start[alias]] |= alone[end[alias]]
                edge = np.diff(np.r_[False, filled(start, end, kind == _LONGER, n) & ~alone].astype(np.int8))
                runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
                again = b"\n".join(b" ".join(words[x : y + window - 1]) for x, y in runs if y - x > window) or None
            at = np.flatnonzero(gone)
            depth = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1)
            edge = np.diff(np.concatenate([[0], np.cumsum(depth)[:-1] > 0, [0]]).astype(np.int8))
            spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        left, at = [], 0
        for a, b in spans:
            left += words[at:a]
            at = b
        kept = b" ".join(left + words[at:] if spans else words)
        return len(words), [{"start": a, "end": b} for a, b in spans], kept if with_text else hashlib.sha256(kept).digest(), again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=_LEVEL).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                lo, hi, doc, blobs, found = batch.slice(at, 512).columns
                places, offsets = found.values.to_numpy(zero_copy_only=False), found.offsets.to_pylist()
                found = [places[a:b] for a, b in zip(offsets, offsets[1:])]
                n, spans, kept, again = zip(*map(one, map(unpack, blobs.to_pylist()), found))
                again = [x and pack(x) for x in again]
                columns = [lo, hi, doc, pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(again, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run, "lo long, hi long, id long, n_words long, spans array<struct<start:int,end:int>>, kept binary, again binary"


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """``lo`` and ``hi`` (a text's key), ``id`` and ``text``."""
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("documents need whole numbers as ids")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    hi = F.shiftleft(F.crc32(text), 31).bitwiseOR(F.length(text).cast("long"))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    return [F.xxhash64(text).alias("lo"), hi.alias("hi"), doc.alias("id"), text.alias("text")]


def repeated(
    docs: DataFrame, window: int = 13, with_text: bool = True, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """One row per distinct text (key ``lo``, ``hi``) with its smallest ``id``: ``n_words``, the ``spans`` of words that
    windows of texts with a smaller id cover, ``kept`` (the other words, or their SHA-256) and ``longest``.

    ``longest`` is the length of the longest window that another text has, too: ``window`` times a power of two, at any start;
    0 where nothing is removed and no window of twice the length is repeated. ``rows_at_once`` windows are compared within a task before any are sent on.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    texts = docs.select(*_keys(docs, id_col, text_col))
    distinct = _distinct(texts)  # used twice in one plan, so that it is shuffled once
    live = distinct.join(_live_halves(texts, window, rows_at_once), "lo").select("lo", "id", "blob", "hashes")
    kind = F.col("kind").cast("long")
    same = Window.partitionBy("h1", F.shiftright("mark", 32), kind > _LONE)
    rows = live.mapInArrow(*_full_windows(window, rows_at_once)).repartition("h1").withColumns({
        "first": F.min("id").over(same),
        "alone": (F.min("lo").over(same) == F.max("lo").over(same)) & (kind == _LONE),
    })
    start = F.col("mark").bitwiseAND(F.lit(2**30 - 1))
    # kind, first and last start in one number, as these are most of what is sent back to the texts
    run = F.shiftleft(kind, 60).bitwiseOR(F.shiftleft(start, 30)).bitwiseOR(F.shiftright("mark", 32))
    one = F.shiftleft(start, 30).bitwiseOR(start)
    place = F.when(kind > _LONE, run).when(F.col("id") > F.col("first"), one).when(F.col("alone"), one + F.lit(_LONE << 60)).alias("place")
    found = rows.select("lo", "id", place).where("place IS NOT NULL").repartition("lo").groupBy("lo", "id")
    found = found.agg(F.collect_list("place").alias("found"))
    # joined by ``lo`` alone, by which both sides are dealt already
    found = found.select(F.col("lo").alias("at"), F.col("id").alias("of"), "found")
    on = (F.col("lo") == F.col("at")) & F.col("id").between(F.col("of"), F.col("of"))
    placed = distinct.join(found, on, "left").select("lo", "hi", "id", "blob", "found")
    result = stored(placed.mapInArrow(*_removed(window, with_text)), "passages")
    longest = _longest(result, window, rows_at_once)
    at_least = F.coalesce("longest", F.when(F.size("spans") > 0, F.lit(window)).otherwise(0)).cast("int").alias("longest")
    return result.join(longest, "lo", "left").select("lo", "hi", "id", "n_words", "spans", "kept", at_least)


def report(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """One row per document: the id, ``n_words``, ``n_removed``, ``kept_sha256`` of the words that stay, joined by a space, and ``longest``.

    A word goes if a window of ``window`` words around it also starts in a document with a smaller id; all windows are judged
    on the input. A null text has no words; texts of fewer words than a window stay as they are. A null id counts as
    larger than any other; documents with the same id, and two with null ids, remove nothing from each other. An empty table gives
    an empty result; further columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("__id"), *_keys(docs, id_col, text_col)[:3])
    found = repeated(docs, window, False, id_col, text_col, rows_at_once).withColumnRenamed("id", "first")
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    span = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.join(found, ["lo", "hi"]).select(
        F.col("__id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(span).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.lower(F.hex("kept"))).alias("kept_sha256"),
        F.when(copy, F.greatest("longest", F.lit(window))).otherwise(F.col("longest")).alias("longest"),
    )


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, their texts without repeated passages; see ``report``.

    A text that loses words is the words that stay, joined by a space; others stay as they are, null as well.
    """
    lo, hi, first, kept, spans, n = (free_name(docs, f"__{x}") for x in ("lo", "hi", "first", "kept", "spans", "n_words"))
    key = _keys(docs, id_col, text_col)
    found = repeated(docs, window, True, id_col, text_col).select(
        F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("id").alias(first), F.col("kept").alias(kept),
        F.size("spans").alias(spans), F.col("n_words").alias(n),
    )
    joined = docs.withColumns({f"{lo}_": key[0], f"{hi}_": key[1]})
    joined = joined.join(found, (F.col(f"{lo}_") == F.col(lo)) & (F.col(f"{hi}_") == F.col(hi)))
    copy = (key[2] > F.col(first)) & (F.col(n) >= window)
    text = F.when(copy, F.lit("")).when(F.col(spans) > 0, F.col(kept).cast("string")).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).select(*docs.columns)
