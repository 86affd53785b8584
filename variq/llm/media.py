"""Media columns: payloads in archives of the shared folder, read through a custom Spark data source.

`store` writes rows to archives of a target size: members one after the other, and beside it an index of (offset,
length, crc, id, unpadded bytes). A member is the payload as a losslessly compressed 8-bit grey image (PNG). `commit`
writes the list of the archives that accepted tasks made, so files of failed attempts are never read. The data source
`variq_media` plans byte ranges over the listed archives of a directory, streams the members that start in a range as
Arrow batches, and reads each member on its own: a failed read or a wrong checksum is tried again at that offset, then
reported in `error` without harm to the others.

A task holds about a megabyte of members at a time (or one longer member) on each side; JVM heap apart, its memory
doesn't depend on the number of archives, members or planned ranges.

Edge cases: null and empty texts store one block of zero bytes; equal texts give equal media; null ids and repeated
rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from variq.llm import _text
from variq.llm._store import shared_dir

BLOCK = 64
#: The table of a directory's archives. A directory without it is listed instead.
COMMITTED = "_committed"
MEMBERS = "doc_id long, n_bytes long, member_offset long, media binary, error string"
_ENTRY = np.dtype([("offset", "<i8"), ("length", "<i8"), ("crc", "<u4"), ("null", "u1"), ("doc_id", "<i8"), ("n_bytes", "<i8")])
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b"\0")


def encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG of BLOCK samples a row."""
    height = len(payload) // BLOCK
    lines = np.zeros((height, BLOCK + 1), np.uint8)  # filter 0 leads each line
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, BLOCK)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", BLOCK, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + part(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such an image; any checksum that fails raises."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, width, height = 8, [], 0, 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", data)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that isn't written here")
    return lines[:, 1:].tobytes()


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Archive:
    """One archive that is being written: members go straight to the open file, only the index is held."""

    def __init__(self, where: fs.FileSystem, name: str):
        self.where, self.name, self.at, self.index = where, name, 0, []
        self.out = where.open_output_stream(f"{name}.arc.tmp")

    def add(self, doc_id: int | None, raw: bytes) -> None:
        media = encode(pad(raw))
        self.out.write(media)
        self.index.append((self.at, len(media), zlib.crc32(media), doc_id is None, doc_id or 0, len(raw)))
        self.at += len(media)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        with self.where.open_output_stream(f"{self.name}.idx.tmp") as out:
            out.write(np.array(self.index, _ENTRY).tobytes())
        for kind in ("idx", "arc"):
            self.where.move(f"{self.name}.{kind}.tmp", f"{self.name}.{kind}")
        return f"{self.name}.arc", len(self.index), self.at


def store(docs: DataFrame, directory: str, *, doc_id: str = "doc_id", text: str = "text", archive: int = 64 << 20) -> DataFrame:
    """Writes archives of about `archive` bytes; (archive, members, bytes) of each. Lazy: see `commit`.

    Names have the task's attempt in them, so a retried or doubled task never touches another's files; which of them
    count is what the attempt that Spark accepts returns.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        where, root = _place(directory)
        where.create_dir(root)
        context = TaskContext.get()
        name, turn, now = f"{root}/{context.partitionId():07d}.{context.taskAttemptId()}", 0, None
        for batch in _text.chunks(batches, "text", 1 << 20):
            for i, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if now is None:
                    now = _Archive(where, f"{name}-{turn:05d}")
                now.add(i, raw.as_buffer().to_pybytes() if raw.is_valid else b"")
                if now.at >= archive:
                    yield _listed(*now.close())
                    now, turn = None, turn + 1
        if now is not None:
            yield _listed(*now.close())

    return rows.mapInArrow(run, _LIST)


_LIST = "archive string, members long, bytes long"


def _listed(name: str, members: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([members], pa.int64()), pa.array([size], pa.int64())], ["archive", "members", "bytes"])


def commit(stored: DataFrame, directory: str) -> None:
    """Runs `store` and writes the list of archives that count, a table in the directory; readers go by it."""
    stored.write.parquet(f"{directory}/{COMMITTED}")


class Range(InputPartition):
    """Bytes [start, end) of an archive: the members that start there."""

    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.directory = options["path"]
        self.bytes = int(options.get("bytes", 16 << 20))
        self.batch = int(options.get("batch", 1 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self):
        where, root = _place(self.directory)
        parts = [x.path for x in where.get_file_info(fs.FileSelector(f"{root}/{COMMITTED}", allow_not_found=True)) if x.path.endswith(".parquet")]
        if parts:
            listed = [pq.read_table(x, columns=["archive", "bytes"], filesystem=where) for x in parts]
            found = sorted((a, n) for t in listed for a, n in zip(*(t.column(c).to_pylist() for c in ("archive", "bytes")), strict=True))
        else:
            found = sorted((x.path, x.size) for x in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.path.endswith(".arc"))
        out = [Range(path, at, min(size, at + self.bytes)) for path, size in found for at in range(0, size, self.bytes)]
        return out or [Range("", 0, 0)]

    def member(self, where: fs.FileSystem, archive: str, held: list, entry: np.void) -> tuple[bytes | None, str | None]:
        """One member, read again from its offset after a failure; held: the open file."""
        error = None
        for turn in range(self.tries):
            try:
                if not held:
                    held.append(where.open_input_file(archive))
                media = held[0].read_at(int(entry["length"]), int(entry["offset"]))
                if len(media) != entry["length"] or zlib.crc32(media) != entry["crc"]:
                    raise OSError("short or damaged member")
                return media, None
            except OSError as e:
                error = str(e)
                for f in held:
                    f.close()
                held.clear()
                time.sleep(0.05 * turn)
        return None, error

    def read(self, partition: Range):
        if not partition.archive:
            return
        where, _ = _place(self.directory)
        with where.open_input_stream(partition.archive.removesuffix("arc") + "idx") as f:
            index = np.frombuffer(f.read(), _ENTRY)
        index = index[(index["offset"] >= partition.start) & (index["offset"] < partition.end)]
        held, rows, size = [], [], 0
        for entry in index:
            media, error = self.member(where, partition.archive, held, entry)
            rows.append((None if entry["null"] else int(entry["doc_id"]), int(entry["n_bytes"]), int(entry["offset"]), media, error))
            size += int(entry["length"])
            if size >= self.batch:
                yield self.rows(rows)
                rows, size = [], 0
        if rows:
            yield self.rows(rows)
        for f in held:
            f.close()
        _text.give_back()

    @staticmethod
    def rows(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "member_offset", "media", "error"])


class MediaSource(DataSource):
    """Options: path (a directory of archives), bytes (of a planned range), batch (of media in an Arrow batch), tries."""

    @classmethod
    def name(cls) -> str:
        return "variq_media"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def read(spark: SparkSession, directory: str, **options) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("variq_media").options(**options).load(directory)


def features(members: DataFrame) -> DataFrame:
    """Digests and features of each member's samples, from what was read back.

    feature: mean, spread, entropy (bits) and the share of zero samples. A member that couldn't be read has nulls.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def one(doc_id, n, media, error):
        if media is None:
            return doc_id, n, None, None, None, None, None, None, error
        try:
            payload = decode(media)
        except (ValueError, zlib.error, struct.error) as e:
            return doc_id, n, None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, str(e)
        count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        p = count / count.sum()
        mean = float((p * np.arange(256)).sum())
        spread = float(np.sqrt((p * (np.arange(256) - mean) ** 2).sum()))
        entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
        feature = f"mean={mean:.4f};spread={spread:.4f};entropy={abs(entropy):.4f};zeros={p[0]:.6f}"
        return doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, None

    def run(batches):
        for batch in _text.chunks(batches, "media", 1 << 20):
            rows = [one(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "error")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in fields.split(", ")])

    return members.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, fields)


def media_column(docs: DataFrame, directory: str | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as a medium in the shared folder, then reads all of them back with their features."""
    import uuid

    spark = docs.sparkSession
    directory = directory or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    commit(store(docs, directory, doc_id=doc_id, text=text), directory)
    return features(read(spark, directory))
