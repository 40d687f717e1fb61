"""Token ids in files of compressed planes.

Ids go in blocks of a fixed number of ids (the last of a file may be shorter). A block is transposed into planes, all first
bytes, all second bytes and so on, or all lowest bits, all next bits and so on; planes above the largest id of the
block are left out. Each plane is one Zstandard frame, or raw where compression does not help. A file ends with its index:

    "BPID" | plane frames ... | index (Zstandard, JSON) | length of the index (8 bytes, little endian) | "DIPB"

The index has the plane kind, the ids and token counts of the documents, and for each block its offset, its number of ids
and the sizes of its planes, so any range of ids is read without the rest.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkaudit.llm.common import shared_folder, stored
from linkaudit.llm.files import new_file, open_file
from linkaudit.llm.words import pieces, places_and_hashes

HEAD, TAIL = b"BPID", b"DIPB"
_SPLIT = b".,!|%$#&*?;:"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids (unsigned 32 bits), lowest first, up to the last that is not all zero."""
    data = np.ascontiguousarray(ids, dtype="<u4")
    top = int(data.max(initial=0)).bit_length()
    if kind == "byte":
        rows = data.view(np.uint8).reshape(-1, 4)
        return [rows[:, k].tobytes() for k in range((top + 7) // 8)]
    return [np.packbits((data >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    out = np.zeros(n, dtype="<u4")
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        if kind == "byte":
            out |= raw.astype("<u4") << np.uint32(8 * k)
        else:
            out |= np.unpackbits(raw, count=n).astype("<u4") << np.uint32(k)
    return out


class PlaneWriter:
    """Writes ids of documents to a stream, block by block; memory holds one block and the index."""

    def __init__(self, stream, block: int = 1 << 16, kind: str = "byte", level: int = 3):
        self.stream, self.block, self.kind = stream, block, kind
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.waiting, self.n_waiting, self.at, self.n_ids = [], 0, len(HEAD), 0
        self.blocks: list[list] = []
        self.docs: list[list] = []
        stream.write(HEAD)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, len(ids)])
        self.n_ids += len(ids)
        while len(ids):
            part = ids[: self.block - self.n_waiting]
            self.waiting.append(part)
            self.n_waiting += len(part)
            ids = ids[len(part) :]
            if self.n_waiting == self.block:
                self._flush()

    def _flush(self) -> None:
        ids = np.concatenate(self.waiting)
        sizes = []
        for plane in to_planes(ids, self.kind):
            packed = self.pack(plane)
            small = len(packed) < len(plane)
            self.stream.write(packed if small else plane)
            sizes.append(len(packed) if small else -len(plane))  # below zero: raw
        self.blocks.append([self.at, len(ids), sizes])
        self.at += sum(map(abs, sizes))
        self.waiting, self.n_waiting = [], 0

    def close(self) -> None:
        if self.n_waiting:
            self._flush()
        index = self.pack(json.dumps({"kind": self.kind, "blocks": self.blocks, "docs": self.docs}).encode())
        self.stream.write(index + struct.pack("<Q", len(index)) + TAIL)
        self.stream.close()


class PlaneReader:
    """Reads a file by its index."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - 12)
        length, tail = struct.unpack("<Q4s", source.read(12))
        source.seek(0)
        if tail != TAIL or source.read(4) != HEAD:
            raise ValueError("not a file of id planes")
        source.seek(size - 12 - length)
        self.unpack = zstandard.ZstdDecompressor().decompress
        index = json.loads(self.unpack(source.read(length)))
        self.kind, self.blocks, self.docs = index["kind"], index["blocks"], index["docs"]
        self.firsts = np.cumsum([0] + [n for _, n, _ in self.blocks])

    def read_block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        self.source.seek(at)
        planes = []
        for size in sizes:
            raw = self.source.read(abs(size))
            planes.append(raw if size < 0 else self.unpack(raw))
        return from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[object, list[np.ndarray]]]:
        """Each document's id and its ids as pieces of blocks, in order; one block is held at a time."""
        k, block, used = -1, np.zeros(0, dtype="<u4"), 0
        for doc_id, n in self.docs:
            pieces = []
            while n:
                if used == len(block):
                    k, used = k + 1, 0
                    block = self.read_block(k)
                pieces.append(block[used : used + n])
                used += len(pieces[-1])
                n -= len(pieces[-1])
            yield doc_id, pieces

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at places ``start`` to ``stop`` of the file; only the blocks that hold them are read."""
        a, b = np.searchsorted(self.firsts, [start, max(start, stop - 1)], side="right") - 1
        parts = [self.read_block(k)[max(0, start - self.firsts[k]) : stop - self.firsts[k]] for k in range(a, min(b, len(self.blocks) - 1) + 1)]
        return np.concatenate(parts) if parts and stop > start else np.zeros(0, dtype="<u4")


class _Known:
    """Token ids of words, found by two hashes of the word; sorted by the first."""

    def __init__(self):
        self.keys = self.checks = np.zeros(0, dtype=np.uint64)
        self.starts = self.lengths = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Words in the order of their keys, none of them known."""
        starts = len(self.pool) + np.cumsum(lengths) - lengths
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.starts, self.lengths = np.insert(self.starts, at, starts), np.insert(self.lengths, at, lengths)
        self.pool = np.concatenate([self.pool, ids])

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gathered(self.pool, self.starts[at], self.lengths[at])


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` one after the other, and their lengths."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - ends + lengths, lengths)], lengths


class Encoder:
    """A tokenizer of the tokenizers library, giving ids as little-endian 32-bit bytes.

    ``by_word`` is for tokenizers whose tokens never cross ASCII white space and that drop it: words are then encoded once and kept, in two
    generations of up to ``kept`` each; what the older one has and is used again moves to the newer. The end of a word that
    is ASCII punctuation after an ASCII letter or digit is a token run of its own
    for these tokenizers, and letters have no case, so more words are alike; a run of small ASCII letters goes to the model
    itself. All else is encoded as it stands. Words are told apart by 128 bits.
    """

    def __init__(self, path: str, by_word: bool, kept: int = 500_000, piece: int = 2 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word, self.kept, self.piece = Tokenizer.from_file(path), by_word, kept, piece
        self.recent, self.older = _Known(), _Known()
        self.parts: dict[bytes, bytes] = {}
        self.older_parts: dict[bytes, bytes] = {}

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [ids.tobytes() for ids in self._arrays(texts)]

    def _arrays(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return self._batch([t.decode() for t in texts])
        # texts one after the other, in pieces that end between words
        out: list[np.ndarray] = []
        group: list[bytes] = []
        held = 0
        for text in texts:
            if held + len(text) > self.piece and group:
                out += self._encoded(group)
                group, held = [], 0
            if len(text) > self.piece:
                out.append(np.concatenate([self._encoded([p])[0] for p in pieces(text, self.piece)]))
            else:
                group.append(text)
                held += len(text)
        return out + (self._encoded(group) if group else [])

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b" ".join([*texts, b""])
        starts, ends, keys, checks = places_and_hashes(data)
        words, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if (checks[first][inverse] != checks).any():  # two words with one key
            return self._batch([t.decode() for t in texts])
        ids, lengths = self._of_words(data, starts[first], ends[first], words, checks[first])
        at = np.cumsum(lengths) - lengths
        ids, per_word = _gathered(ids, at[inverse], lengths[inverse])
        bounds = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.concatenate([[0], np.cumsum(per_word)])[np.searchsorted(starts, bounds)]
        return np.split(ids, cuts[:-1])

    def _of_words(self, data: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, in the order of their keys, and how many each has."""
        if len(self.recent.keys) > self.kept:
            self.older, self.recent = self.recent, _Known()
        if len(self.parts) > self.kept // 2:
            self.older_parts, self.parts = self.parts, {}
        missing = np.flatnonzero(self.recent.find(keys, checks) < 0)
        if len(missing):
            again = self.older.find(keys[missing], checks[missing])
            moved = missing[again >= 0]
            ids, lengths = self.older.ids_of(again[again >= 0])
            self.recent.add(keys[moved], checks[moved], lengths, ids)
            fresh = missing[again < 0]
            found = self._new([data[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist())])
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            self.recent.add(keys[fresh], checks[fresh], lengths, np.frombuffer(b"".join(found), dtype="<u4"))
        return self.recent.ids_of(self.recent.find(keys, checks))

    def _new(self, words: list[bytes]) -> list[bytes]:
        split = [self._parts(w) for w in words]
        parts, older = self.parts, self.older_parts
        wanted = {p for both in split for p in both if p and p not in parts}
        parts.update({p: older[p] for p in wanted if p in older})
        wanted = [p for p in wanted if p not in parts]
        plain = [p for p in wanted if p.isalpha() and p.islower()]  # ASCII letters reach the model as they are
        tokenize = self.tokenizer.model.tokenize
        parts.update({p: np.array([t.id for t in tokenize(p.decode())], dtype="<u4").tobytes() for p in plain})
        others = [p for p in wanted if p not in parts]
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            parts.update({w: ids.tobytes() for w, ids in zip(some, self._batch([w.decode() for w in some]))})
        return [parts[a] + parts[b] if b else parts[a] for a, b in split]

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, bytes]:
        core = word.rstrip(_SPLIT)
        if not core[-1:].isalnum():
            return word, b""
        return (core.lower() if core.isalpha() else core), word[len(core) :]


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, by_word: bool) -> Encoder:
    """The encoder of this worker; it and its words are kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


def write_ids(
    docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    by_word: bool = False, block: int = 1 << 16, kind: str = "byte", level: int = 3, texts_at_once: int = 1024,
) -> DataFrame:
    """Write the ids of all documents, in ascending order of their id, and return the table of files in their order:
    ``folder``, ``file``, ``start`` (ids in the files before) and ``n_ids``.

    Documents are dealt by ranges of the id (null ids first, equal ids by a hash of the text), so a file holds a range.
    A null text has the end id only.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "ids")
    id_type = docs.schema[id_col].dataType.simpleString()
    order = ["__id", "__hash"]
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    rows = rows.withColumn("__hash", F.xxhash64("__text")).repartitionByRange(*order).sortWithinPartitions(*order).select("__id", "__text")
    end = np.array([end_id], dtype="<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        encoder = _encoder(tokenizer_path, by_word)
        for batch in batches:
            for at in range(0, batch.num_rows, texts_at_once):
                if writer is None:
                    name, stream = new_file(folder, f"ids-{part:06d}", ".bpid")
                    writer = PlaneWriter(stream, block, kind, level)
                some = batch.slice(at, texts_at_once)
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist())):
                    writer.add(doc_id, np.concatenate([np.frombuffer(ids, dtype="<u4"), end]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_ids": [writer.n_ids]})

    if id_type not in ("bigint", "int", "smallint", "tinyint", "string"):
        raise TypeError(f"ids of type {id_type} have no place in the index")
    files = stored(rows.mapInArrow(write, "part long, file string, n_ids long"), "files")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")
    return stored(files.select(F.lit(folder).alias("folder"), "file", start, "n_ids"), "files")


def read_ids(files: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of the ids as little-endian 32-bit numbers."""
    arrow_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[id_type]
    schema = pa.schema([("doc_id", arrow_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["folder"], row["file"]) as source:
                    out, start = [], row["start"]
                    for doc_id, pieces in PlaneReader(source).documents():
                        crc, n = 0, 0
                        for piece in pieces:
                            crc, n = zlib.crc32(piece.tobytes(), crc), n + len(piece)
                        out.append((doc_id, start, n, crc))
                        start += n
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document, read back from the files: its id, ``start``, ``n_tokens`` and ``ids_crc32``.

    Null and empty texts have the end id only; repeated rows are written each; an empty table writes no file and gives
    an empty result; further columns are ignored.
    """
    files = write_ids(docs, tokenizer_path, end_id, id_col=id_col, **options)
    return read_ids(files, docs.schema[id_col].dataType.simpleString()).withColumnRenamed("doc_id", id_col)
