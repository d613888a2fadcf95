"""WARC archives and their fixity audit: Merkle trees over ordered record ranges of two replicas."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from seacast.llm.common import prefix_sums
from seacast.session import scratch_path, stored

#: Bytes of a file after which the next begins, bytes copied at once, children of a tree node.
FILE_BYTES, CHUNK, FANOUT = 16 << 20, 1 << 20, 64
INDEX = "page_id bigint, file string, seq bigint, offset bigint, length bigint, n_bytes bigint, record_sha256 string"


def record(page_id: int | None, url: str | None, html: str | None, date: str) -> tuple[bytes, int]:
    """One gzip member with a WARC resource record, and the payload's bytes."""
    payload = (html or "").encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {target} {hashlib.sha256(payload).hexdigest()}")
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", compresslevel=6, mtime=0), len(payload)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


class Writer:
    """A partition of pages to files; one index row for each record. Files carry the attempt in their names, and only the
    index of the attempt that counts names them."""

    def __init__(self, folder: str, date: str):
        self.folder, self.date = folder, date

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        task, out, number, at, seq = TaskContext.get(), None, 0, 0, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    if out is None:
                        name = f"part-{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.warc.gz"
                        out, at, seq = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    member, size = record(page_id, url, html, self.date)
                    out.write(member)
                    rows.append((page_id, name, seq, at, len(member), size, hashlib.sha256(member).hexdigest()))
                    at, seq = at + len(member), seq + 1
                    if at >= FILE_BYTES:
                        out.close()
                        out, number = None, number + 1
                if rows:
                    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], INDEX.replace(" bigint", "").replace(" string", "").split(", "))
        finally:
            if out is not None:
                out.close()


def write_archive(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """The index of a new archive: one row per record with file, place, length and the digest of its stored bytes.

    Null html is an empty payload, a null url ``urn:none``; repeated pages are records of their own.
    Pages are written where they are read, without a shuffle; a file holds about ``FILE_BYTES``.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return stored(rows.mapInArrow(Writer(folder, date), INDEX), "warc-index")


class Copier:
    """Copies files in bounded chunks; ``flips`` lists places whose byte arrives inverted, as a failing disk would do."""

    def __init__(self, source: str, target: str):
        self.source, self.target = source, target

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), (to, there) = (FileSystem.from_uri(f) for f in (self.source, self.target))
        to.create_dir(there, recursive=True)
        for batch in batches:
            for name, flips in zip(batch.column("file").to_pylist(), batch.column("flips").to_pylist()):
                attempt, at = f"{there}/_{name}.{uuid.uuid4().hex}", 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as src, to.open_output_stream(attempt, compression=None) as out:
                    while chunk := src.read(CHUNK):
                        data = bytearray(chunk)
                        for place in flips:
                            if at <= place < at + len(data):
                                data[place - at] ^= 0xFF
                        out.write(bytes(data))
                        at += len(data)
                to.move(attempt, f"{there}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at])], ["file", "size"])


def replicate(index: DataFrame, source: str, target: str, flips: DataFrame | None = None) -> DataFrame:
    """(file, size) of a copy of the archive; ``flips`` (file, place) plants damage for drills and tests."""
    files = index.select("file").distinct()
    if flips is None:
        files = files.withColumn("flips", F.array().cast("array<bigint>"))
    else:
        files = files.join(flips.groupBy("file").agg(F.collect_list("place").alias("flips")), "file", "left")
        files = files.withColumn("flips", F.coalesce("flips", F.array().cast("array<bigint>")))
    return stored(files.mapInArrow(Copier(source, target), "file string, size bigint"), "warc-copy")


class Leaves:
    """The digest of each record's bytes as a replica holds them now; null where they are missing."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(self.folder)
        name, source = None, None
        for batch in batches:
            digests = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if source:
                        source.close()
                    there = fs.get_file_info(f"{root}/{file}").type == FileType.File
                    name, source = file, fs.open_input_file(f"{root}/{file}") if there else None
                data = source.read_at(max(0, min(length, source.size() - offset)), offset) if source and offset < source.size() else b""
                digests.append(hashlib.sha256(data).hexdigest() if len(data) == length else None)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(digests, pa.string())], ["node", "digest"])


def tree(index: DataFrame, folder: str | None) -> list[DataFrame]:
    """The levels of a replica's tree, records first: (node, digest); of the digests taken at writing without a folder. A
    node covers ``FANOUT`` neighbours of the level below, so level n covers ordered ranges of ``FANOUT ** n`` records; the
    last level is the root."""
    if folder is None:
        levels = [index.select("node", F.col("record_sha256").alias("digest"))]
    else:
        levels = [stored(index.select("node", "file", "offset", "length").mapInArrow(Leaves(folder), "node bigint, digest string"), "leaves")]
    count = index.count()
    while count > 1:
        below = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("node"))
        children = F.array_sort(F.collect_list(F.struct("node", F.coalesce("digest", F.lit("missing")).alias("digest"))))  # at most FANOUT
        digest = F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), "\n"), 256)
        levels.append(stored(below.agg(digest.alias("digest")), "tree"))
        count = -(-count // FANOUT)
    return levels


def mismatches(left: list[DataFrame], right: list[DataFrame], written: list[DataFrame]) -> DataFrame:
    """Records (node, left, right) with a digest other than the written one: from the roots down, below differing nodes only."""
    parents = None
    for levels in zip(reversed(left), reversed(right), reversed(written)):
        if parents is not None:
            above = F.floor(F.col("node") / FANOUT)
            levels = [x.withColumn("_up", above).join(parents, "_up", "left_semi").drop("_up") for x in levels]
        a, b, c = (x.select("node", F.col("digest").alias(n)) for x, n in zip(levels, ("left", "right", "written")))
        both = a.join(b, "node", "full").join(c, "node", "full")
        found = stored(both.where(~F.col("left").eqNullSafe(F.col("written")) | ~F.col("right").eqNullSafe(F.col("written"))), "differ")
        parents = found.select(F.col("node").alias("_up"))
    return found.withColumn("found", F.lit(True)).drop("written")


def audit(index: DataFrame, left: str, right: str) -> DataFrame:
    """``index`` with intact, left_damaged and right_damaged: the damage that the two trees locate.

    A record is intact when both replicas hold the bytes whose digest was taken at writing, which tells
    which of them is damaged (a missing or short record is), also where both are. An empty archive gives no rows.
    """
    one = prefix_sums(index.withColumns({"_all": F.lit(0), "_one": F.lit(1)}), ["_all"], ["file", "seq"], "_one", "node").drop("_all", "_one")
    numbered = stored(one.repartitionByRange("node").sortWithinPartitions("node"), "numbered")
    found = mismatches(tree(numbered, left), tree(numbered, right), tree(numbered, None))
    joined = numbered.join(found, "node", "left")
    differ = F.col("found").isNotNull()
    wrong = {c: differ & ~F.col(c).eqNullSafe(F.col("record_sha256")) for c in ("left", "right")}
    joined = joined.select("*", (~differ).alias("intact"), wrong["left"].alias("left_damaged"), wrong["right"].alias("right_damaged"))
    return joined.drop("left", "right", "found", "node")


class Reader:
    """Payloads of records, from the replica that each row names."""

    def __call__(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, folder, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "folder", "file", "offset", "length"))):
                fs, root = FileSystem.from_uri(folder)
                with fs.open_input_file(f"{root}/{file}") as source:
                    headers, payload = parse(source.read_at(length, offset))
                out.append((page_id, file, offset, headers["WARC-Target-URI"], payload))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()))], ["page_id", "file", "offset", "url", "payload"])


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, file, offset, url, payload) of the records of an index with a ``folder`` column."""
    return index.select("page_id", "folder", "file", "offset", "length").mapInArrow(Reader(), "page_id bigint, file string, offset bigint, url string, payload binary")


def audited_archive(spark: SparkSession, pages: DataFrame, damage=None) -> tuple[DataFrame, str, str]:
    """(audit, folder, replica folder) of a new archive of the pages and its copy, whose records that meet ``damage`` get
    one inverted byte in their middle."""
    folder, copy = scratch_path(spark, "warc"), scratch_path(spark, "warc-replica")
    index = write_archive(pages, folder)
    flips = None if damage is None else index.where(damage).select("file", (F.col("offset") + F.floor(F.col("length") / 2)).alias("place"))
    replicate(index, folder, copy, flips)
    return audit(index, folder, copy), folder, copy
