"""Token files of directly addressable codes: ids split into chunk levels with continuation bitmaps and rank directories."""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seacast.llm.blocks import slices
from seacast.llm.common import prefix_sums
from seacast.llm.tokens import Encoder
from seacast.session import scratch_path, stored

#: File layout, little-endian: MAGIC; number of ids, documents and levels; ids of each level; document ids (8 bytes each, then
#: one byte each that is 1 where the id is null); starts of the documents and the end; then for each level its chunks (one
#: byte an id) and, but for the last level, a bitmap (bit set: the id goes on in the next level) and a rank directory (set
#: bits before each block of 512).
MAGIC, BLOCK, CHUNK = b"DAC1", 512, 8
#: Ids of a file (a longer document has a file of its own), and bytes of text encoded at once.
FILE_IDS, SLICE = 1 << 20, 12 << 20


def encode(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """One file: ``starts`` has where each document begins among ``ids``, and their number at the end."""
    body, sizes, rest = io.BytesIO(), [], ids.astype(np.uint64)
    while True:
        sizes.append(len(rest))
        body.write((rest & np.uint64(255)).astype(np.uint8).tobytes())
        more = rest > 255
        if not more.any():
            break
        body.write(np.packbits(more, bitorder="little").tobytes())
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64)
        body.write((np.cumsum(counts) - counts).astype(np.uint64).tobytes())
        rest = rest[more] >> np.uint64(CHUNK)
    head = MAGIC + struct.pack(f"<3Q{len(sizes)}Q", len(ids), len(doc_ids), len(sizes), *sizes)
    names = np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes() + bytes(d is None for d in doc_ids)
    return head + names + starts.astype(np.uint64).tobytes() + body.getvalue()


class TokenFile:
    """Random access to the ids of a file through anything with ``seek`` and ``read``."""

    def __init__(self, source):
        self.source = source
        n, docs, levels = struct.unpack("<3Q", self.at(4, 24))
        sizes = struct.unpack(f"<{levels}Q", self.at(28, 8 * levels))
        self.n_ids, self.n_docs, place = n, docs, 28 + 8 * levels
        self.names, place = place, place + 9 * docs
        self.starts_at, place = place, place + 8 * (docs + 1)
        self.levels = []
        for k, size in enumerate(sizes):
            bits, ranks = (0, 0) if k == levels - 1 else ((size + 7) // 8, 8 * -(-size // BLOCK))
            self.levels.append((place, place + size, place + size + bits))
            place += size + bits + ranks

    def at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        raw = self.at(self.names, 9 * self.n_docs)
        ids = np.frombuffer(raw, np.int64, self.n_docs).tolist()
        return [None if null else i for i, null in zip(ids, raw[8 * self.n_docs :])], np.frombuffer(self.at(self.starts_at, 8 * (self.n_docs + 1)), np.uint64).astype(np.int64)

    def rank(self, level: int, place: int) -> int:
        """Set bits before ``place``: the block's entry in the directory and the bits of one block."""
        if not place:
            return 0
        block = (place - 1) // BLOCK
        before = struct.unpack("<Q", self.at(self.levels[level][2] + 8 * block, 8))[0]
        bits = np.unpackbits(np.frombuffer(self.at(self.levels[level][1] + block * BLOCK // 8, BLOCK // 8), np.uint8), bitorder="little")
        return before + int(bits[: place - block * BLOCK].sum())

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop - 1; reads only their chunks, bitmaps and two directory entries a level."""
        out, where = np.zeros(stop - start, np.uint64), np.arange(stop - start)
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if stop <= start:
                break
            out[where] |= np.frombuffer(self.at(chunks + start, stop - start), np.uint8).astype(np.uint64) << np.uint64(CHUNK * level)
            if level + 1 == len(self.levels):
                break
            raw = np.frombuffer(self.at(bitmap + start // 8, (stop + 7) // 8 - start // 8), np.uint8)
            more = np.unpackbits(raw, bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            where, start = where[more], self.rank(level, start)
            stop = start + len(where)
        return out.astype(np.uint32)


def write_file(folder: str, name: str, data: bytes) -> None:
    """Writes under another name and moves, so that a file is there whole or not at all; a second attempt writes the same."""
    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    attempt = f"{root}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as out:
        out.write(data)
    fs.move(attempt, f"{root}/{name}")


class Writer:
    """A sorted partition to its files; one row for each file."""

    def __init__(self, folder: str, encoder: Encoder, end_id: int):
        self.folder, self.encoder, self.end_id = folder, encoder, end_id

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, list, np.ndarray]] = []
        size = 0
        for table in slices(batches, SLICE):
            ids, offsets = self.encoder(table["text"].combine_chunks(), self.end_id)
            names = table["doc_id"].to_pylist()
            at = 0
            while at < len(names):
                stop = int(np.searchsorted(offsets, offsets[at] + FILE_IDS - size, side="right")) - 1
                stop = stop if held else max(stop, at + 1)
                if stop > at:
                    held.append((ids[offsets[at] : offsets[stop]], names[at:stop], np.diff(offsets[at : stop + 1])))
                    size += offsets[stop] - offsets[at]
                if stop < len(names):
                    yield self.flush(held, part, number)
                    held, size, number = [], 0, number + 1
                at = stop
        if held:
            yield self.flush(held, part, number)

    def flush(self, held, part: int, number: int) -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        starts = np.concatenate([[0], np.cumsum(np.concatenate([h[2] for h in held]))])
        name = f"part-{part:06d}-{number:05d}.dac"
        write_file(self.folder, name, encode(ids, [d for h in held for d in h[1]], starts))
        return pa.RecordBatch.from_pylist([{"file": name, "part": part, "number": number, "n_docs": len(starts) - 1, "n_ids": len(ids)}])


def write_tokens(docs: DataFrame, tokenizer: str, spaces: bool, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """(folder, manifest): token files of all documents in ascending doc_id order.

    Documents are dealt by ranges of doc_id and sorted (null ids last, rows of one id by a hash of the
    text); a task encodes its range and writes files of about ``FILE_IDS`` ids. A null text has only
    ``end_id``. The manifest (file, part, number, n_docs, n_ids) names the files that count; files of a
    lost attempt have the same names and content. Only doc_id and text are read.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    made = ranged.mapInArrow(Writer(folder, Encoder(tokenizer, spaces), end_id), "file string, part bigint, number bigint, n_docs bigint, n_ids bigint")
    return folder, stored(made, "manifest")


def read_documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, base in zip(batch.column("content"), batch.column("base").to_pylist()):
            file = TokenFile(io.BytesIO(content.as_buffer()))
            names, starts = file.documents()
            ids = file.ids(0, file.n_ids).astype("<u4").tobytes()
            view = memoryview(ids)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the manifest."""
    spark = manifest.sparkSession
    bases = prefix_sums(manifest.withColumn("_all", F.lit(0)), ["_all"], ["part", "number"], "n_ids", "base").select("file", "base")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.dac").load(folder) if not manifest.isEmpty() else None
    if files is None:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.join(bases, "file").select("content", "base").mapInArrow(read_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
