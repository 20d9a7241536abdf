"""Media columns: payloads stored as images in archives, and a data source that reads them back.

The writer puts one PNG per row into zip archives, one archive per task. The source plans partitions
as byte ranges over the archives' directories (the list of members at the end of each archive), of
which the driver reads only the end record. A task walks its range of directory entries, reads each
member at its own offset, and streams Arrow batches; a member that fails is read again by itself.
"""

from __future__ import annotations

import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..shared import new_folder
from .common import documents
from .tokenfiles import opened

WIDTH = 576
PNG = b"\x89PNG\r\n\x1a\n"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
MEMBERS = "archive string, offset bigint, name string, media binary, error string"


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """With bytes 255 behind it, up to a positive multiple of the unit."""
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b"\xff")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """A grey image of 8-bit samples that holds the padded data, one row after the other; `length` is its text note."""
    rows = np.frombuffer(padded(data, width), np.uint8).reshape(-1, width)
    lines = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1)  # 0: no filter
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    note = b"length\0" + str(len(data)).encode()
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", note) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int]:
    """Samples of such an image and the noted length; ValueError if a chunk is damaged."""
    if image[:8] != PNG:
        raise ValueError("no PNG signature")
    at, head, note, data = 8, b"", b"", []
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk at {at}")
        at += 12 + size
        if kind == b"IHDR":
            head = body
        elif kind == b"tEXt" and body.startswith(b"length\0"):
            note = body[7:]
        elif kind == b"IDAT":
            data.append(body)
    width, height, depth, colour = struct.unpack_from(">IIBB", head)
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not an unfiltered grey image of 8 bits")
    return lines[:, 1:].tobytes(), int(note)


@dataclass
class Written(WriterCommitMessage):
    archive: str


class ArchiveWriter(DataSourceArrowWriter):
    """One zip archive per task; an archive counts once the manifest of the committed write names it."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = opened(self.folder)
        system.create_dir(at, recursive=True)
        name = f"{uuid.uuid4().hex}.zip"
        with system.open_output_stream(f"{at}/{name}") as out, zipfile.ZipFile(_Unseekable(out), "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
            for batch in iterator:
                for member, media in zip(batch.column("name").to_pylist(), batch.column("media").to_pylist(), strict=True):
                    archive.writestr(zipfile.ZipInfo(member or ""), media or b"")
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.folder)
        with system.open_output_stream(f"{at}/_manifest.json") as out:
            out.write(json.dumps([m.archive for m in messages if m]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, at = opened(self.folder)
        for message in messages:
            if message and system.get_file_info(f"{at}/{message.archive}").type == pafs.FileType.File:
                system.delete_file(f"{at}/{message.archive}")


class _Unseekable(io.RawIOBase):
    """An output stream as zipfile wants it; it then writes sizes behind each member, and 64-bit ones."""

    def __init__(self, out: pa.NativeFile):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


@dataclass
class DirectoryRange(InputPartition):
    """Entries that begin in bytes [begin, end) of an archive's directory, which starts at `start` of the file."""

    archive: str
    start: int
    begin: int
    end: int
    size: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[pa.NativeFile, int, int], bytes] | None = None):
        self.folder = options["path"]
        self.range = int(options.get("directoryBytes", 64 << 10))
        self.batch = int(options.get("batchBytes", 4 << 20))
        self.attempts = int(options.get("attempts", 4))
        self.wait = float(options.get("waitSeconds", 0.2))
        self.keep_failed = options.get("keepFailed", "false") == "true"
        self.fetch = fetch or (lambda file, size, offset: file.read_at(size, offset))

    def partitions(self) -> list[DirectoryRange]:
        system, at = opened(self.folder)
        with system.open_input_stream(f"{at}/_manifest.json") as file:
            names = json.loads(file.read())
        ranges = []
        for name in names:
            with system.open_input_file(f"{at}/{name}") as file:
                start, size = directory_of(file)
            ranges += [DirectoryRange(name, start, b, min(b + self.range, size), size) for b in range(0, size, self.range)]
        return ranges

    def read(self, partition: DirectoryRange | None) -> Iterator[pa.RecordBatch]:
        """Rows of one range; without any archive member Spark asks for the range None."""
        if partition is None:
            return
        system, at = opened(self.folder)
        rows, held = [], 0
        with system.open_input_file(f"{at}/{partition.archive}") as file:
            directory = self.again(lambda: self.fetch(file, partition.size, partition.start))
            for name, offset in entries(directory, partition.begin, partition.end):
                media, error = None, None
                try:
                    media = self.again(lambda offset=offset: member(file, offset, self.fetch))
                except (OSError, ValueError) as failure:
                    if not self.keep_failed:
                        raise
                    error = str(failure)
                rows.append((partition.archive, offset, name, media, error))
                held += len(media or b"")
                if held >= self.batch:
                    yield _members(rows)
                    rows, held = [], 0
        if rows:
            yield _members(rows)

    def again(self, read: Callable[[], bytes]) -> bytes:
        """The result of a read that is tried a few times, with growing pauses."""
        for attempt in range(self.attempts):
            try:
                return read()
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise ValueError("attempts is at least 1")


def _members(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = ["archive", "offset", "name", "media", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def directory_of(file: pa.NativeFile) -> tuple[int, int]:
    """Offset and bytes of an archive's directory, from its end record (64-bit ones too)."""
    length = file.size()
    tail = file.read_at(min(length, 65_557 + 76), max(0, length - 65_557 - 76))
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of directory")
    size, start = struct.unpack_from("<II", tail, at + 12)
    if 0xFFFFFFFF in (size, start) and tail[at - 20 : at - 16] == LOCATOR64:
        (place,) = struct.unpack_from("<Q", tail, at - 12)
        size, start = struct.unpack_from("<QQ", file.read_at(56, place), 40)
    return start, size


def entries(directory: bytes, begin: int, end: int) -> Iterator[tuple[str, int]]:
    """(name, offset of the member) of the entries that begin in [begin, end)."""
    at = 0
    while at < min(end, len(directory)):
        if directory[at : at + 4] != ENTRY:
            raise ValueError(f"damaged directory at {at}")
        size, real = struct.unpack_from("<II", directory, at + 20)
        name, extra, note = struct.unpack_from("<HHH", directory, at + 28)
        (offset,) = struct.unpack_from("<I", directory, at + 42)
        if at >= begin:
            more = directory[at + 46 + name : at + 46 + name + extra]
            if offset == 0xFFFFFFFF:
                offset = _offset64(more, (size == 0xFFFFFFFF) + (real == 0xFFFFFFFF))
            yield directory[at + 46 : at + 46 + name].decode("utf-8"), offset
        at += 46 + name + extra + note


def _offset64(extra: bytes, skip: int) -> int:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return struct.unpack_from("<Q", extra, at + 4 + 8 * skip)[0]
        at += 4 + size
    raise ValueError("no 64-bit offset")


def member(file: pa.NativeFile, offset: int, fetch: Callable[[pa.NativeFile, int, int], bytes]) -> bytes:
    """Bytes of the stored PNG member at an offset; ValueError if it is cut short or damaged.

    A streamed member has its size behind it, so the image's own chunks tell where it ends.
    """
    head = fetch(file, 30, offset)
    if head[:4] != LOCAL or struct.unpack_from("<H", head, 8)[0] != 0:
        raise ValueError(f"no stored member at {offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    start = at = offset + 30 + name + extra
    if fetch(file, 8, at) != PNG:
        raise ValueError(f"no image at {offset}")
    at += 8
    while True:
        chunk = fetch(file, 8, at)
        if len(chunk) < 8:
            raise ValueError(f"cut short at {offset}")
        at += 12 + struct.unpack(">I", chunk[:4])[0]
        if chunk[4:] == b"IEND":
            break
    media = fetch(file, at - start, start)
    if len(media) != at - start:
        raise ValueError(f"cut short at {offset}")
    from_png(media)
    return media


class ArchiveSource(DataSource):
    """Format "media_archive": rows (archive, offset, name, media, error) of a folder of archives.

    Options: path; directoryBytes per partition; batchBytes; attempts and waitSeconds of each member;
    keepFailed: members that never read well become rows with null media and the error, else they fail.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_archives(media: DataFrame, folder: str) -> None:
    """media: columns archive, offset, error (unused), name and media."""
    media.sparkSession.dataSource.register(ArchiveSource)
    media.write.format("media_archive").mode("append").option("path", folder).save()


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(path=folder, **options).load()


def features(payload: bytes) -> str:
    """Shares of 16 ranges of sample values, mean and deviation of the samples, and mean step between neighbours."""
    samples = np.frombuffer(payload, np.uint8)
    shares = np.bincount(samples >> 4, minlength=16) / len(samples)
    step = np.abs(np.diff(samples.astype(np.int16))).mean()
    return ",".join(f"{x:.6f}" for x in (*shares, samples.mean(), samples.std(), step))


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every whole text as an image in archives of the shared folder, and describe what is read back.

    A null or empty text is one row of samples 255. Rows that repeat are members of their own; a
    missing id stays missing. An empty table gives archives without members, and no rows.
    """
    import hashlib

    folder = new_folder(df.sparkSession, "media")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["" if i is None else str(i) for i in batch.column("doc_id").to_pylist()]
            for start in range(0, len(names), 256):
                part = batch.slice(start, 256)
                images = [to_png(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
                n, own = len(images), names[start : start + 256]
                yield _members(list(zip([None] * n, [None] * n, own, images, [None] * n, strict=True)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for name, image in zip(batch.column("name").to_pylist(), batch.column("media").to_pylist(), strict=True):
                data, length = from_png(image)
                digests = (sha(data).hexdigest(), zlib.crc32(data[-32:]), len(image), sha(image).hexdigest(), features(data))
                rows.append((int(name) if name else None, length, len(data), *digests))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * 8
            names = [c.split()[0] for c in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    write_archives(documents(df, key, text).mapInArrow(store, MEMBERS), folder)
    return read_archives(df.sparkSession, folder).select("name", "media").mapInArrow(describe, FEATURES)
