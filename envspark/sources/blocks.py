"""Files and archives of any size, read in blocks by Python data sources: no file, archive or member stands in one row.

* ``file_digests``   SHA-256 of whole files (S6), a block in memory at a time.
* ``zip_directory``  the members of zip archives, from their directories.
* ``zip_chunks``     the text of members as chunks that end at line ends, with the number of each chunk's first line (S5).

Files are opened on the executors through ``pyarrow.fs`` by their URI, so archives can be searched without being copied
(local and shared disks, HDFS, S3, GCS). ``opens`` tells whether a URI can be opened so; others have to go through Spark's own
binary reader, whose rows hold whole files (see ``files.expand_archives``).
"""

from __future__ import annotations

import hashlib
import json
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at once, bytes of files that one task takes, and bytes of text in a chunk (a longer line is a chunk of its own).
BLOCK, TASK_BYTES, CHUNK = 4 << 20, 256 << 20, 4 << 20

DIGESTS = "file string, length bigint, checksum_sha256 string"
DIRECTORY = "archive string, member string, number int, length bigint, error string"
CHUNKS = ("archive string, member string, number int, first_line bigint, head_line bigint, head binary, content binary, "
          "error string")
_CHUNK_TYPES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("number", pa.int32()), ("first_line", pa.int64()),
                          ("head_line", pa.int64()), ("head", pa.binary()), ("content", pa.binary()), ("error", pa.string())])
#: Broken, too short to seek in, broken stream, unknown method, encrypted, cut off.
UNREADABLE = (zipfile.BadZipFile, pa.ArrowInvalid, zlib.error, NotImplementedError, RuntimeError, EOFError)


def opens(uri: str) -> bool:
    """Whether executors can open a file of this URI in blocks."""
    try:
        pafs.FileSystem.from_uri(uri)
        return True
    except (pa.ArrowInvalid, ValueError, OSError, NotImplementedError):
        return False


def open_file(uri: str) -> pa.NativeFile:
    """A file to search in."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def open_stream(uri: str) -> pa.NativeFile:
    """A file to read from its start, unpacked by its suffix (.gz and the like)."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path, compression="detect")


def packed(items: Iterable[tuple], size_at: int, most: int) -> list[list[tuple]]:
    """Items in runs of at most ``most`` bytes by the size at ``size_at``; a larger one is a run of its own."""
    out, room = [], 0
    for item in items:
        if not out or item[size_at] > room:
            out.append([])
            room = most
        out[-1].append(item)
        room -= item[size_at]
    return out


class _Items(InputPartition):
    def __init__(self, items: list):
        self.items = items


class PartsReader(DataSourceReader):
    """One task for each list of ``items``."""

    def __init__(self, options: dict):
        self.parts, self.chunk = json.loads(options["parts"]), int(options.get("chunk", CHUNK))

    def partitions(self) -> list[InputPartition]:
        return [_Items(p) for p in self.parts] or [_Items([])]


class _DigestReader(PartsReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for uri, length in partition.items:
            digest = hashlib.sha256()
            with open_file(uri) as f:
                while block := f.read(BLOCK):
                    digest.update(block)
            yield uri, length, digest.hexdigest()


class _DirectoryReader(PartsReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for uri, _ in partition.items:
            try:
                with open_file(uri) as f, zipfile.ZipFile(f) as archive:
                    for k, info in enumerate(archive.infolist()):
                        if not info.is_dir():
                            yield uri, info.filename, k, info.file_size, "encrypted member" if info.flag_bits & 1 else None
            except UNREADABLE as error:
                yield uri, None, None, 0, f"not a readable zip archive: {error}"


def line_chunks(stream, size: int) -> Iterator[tuple[int, bytes]]:
    """(number of the first line, bytes) of a stream in pieces of about ``size`` that end at line ends, without the last one."""
    held, first = [], 0
    while block := stream.read(size):
        cut = block.rfind(b"\n")
        if cut < 0:
            held.append(block)
            continue
        piece = b"".join([*held, block[:cut]])
        yield first, piece
        first += piece.count(b"\n") + 1
        held = [block[cut + 1:]]
    rest = b"".join(held)
    if rest:
        yield first, rest


def member_chunks(archive: zipfile.ZipFile, uri: str, number: int, size: int) -> Iterator[tuple]:
    """CHUNKS of one member: blank chunks before the first line with text are left out; that line is the head."""
    info = archive.infolist()[number]
    head = None
    try:
        with archive.open(info) as stream:
            for first, content in line_chunks(stream, size):
                if head is None:
                    for k, line in enumerate(content.split(b"\n")):
                        if line.strip(b"\xef\xbb\xbf \t\r"):
                            head = (first + k, line.removeprefix(b"\xef\xbb\xbf").removesuffix(b"\r"))
                            break
                    else:
                        continue
                yield uri, info.filename, number, first, *head, content, None
    except UNREADABLE as error:
        yield uri, info.filename, number, None, None, None, None, f"unreadable member: {error}"


def as_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """One batch a chunk, so a worker holds one chunk."""
    for row in rows:
        yield pa.RecordBatch.from_pylist([dict(zip(_CHUNK_TYPES.names, row))], schema=_CHUNK_TYPES)


class _ChunkReader(PartsReader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for uri, numbers in _by_archive(partition.items):
            with open_file(uri) as f, zipfile.ZipFile(f) as archive:
                for number in numbers:
                    yield from as_batches(member_chunks(archive, uri, number, self.chunk))


def _by_archive(items: list) -> Iterator[tuple[str, list[int]]]:
    last, numbers = None, []
    for uri, number, _ in items:
        if uri != last and numbers:
            yield last, numbers
            numbers = []
        last = uri
        numbers.append(number)
    if numbers:
        yield last, numbers


def source_of(source: str, columns: str, reads: type) -> type:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return reads(dict(self.options))

    return Source


def read_parts(spark: SparkSession, source: str, columns: str, reads: type, parts: list, **options) -> DataFrame:
    spark.dataSource.register(source_of(source, columns, reads))
    return spark.read.format(source).options(parts=json.dumps(parts), **options).load()


def file_digests(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(file, length, checksum_sha256) of (URI, length) pairs."""
    return read_parts(spark, "file_digests", DIGESTS, _DigestReader, packed(files, 1, TASK_BYTES))


def zip_directory(spark: SparkSession, archives: list[tuple[str, int]]) -> DataFrame:
    """DIRECTORY of (URI, length) pairs: a row a member, or one with an error and no member for a broken archive."""
    parts = [archives[k:k + 64] for k in range(0, len(archives), 64)]  # directories are small whatever the archives hold
    return read_parts(spark, "zip_directory", DIRECTORY, _DirectoryReader, parts)


def zip_chunks(spark: SparkSession, members: list[tuple[str, int, int]], chunk: int = CHUNK) -> DataFrame:
    """CHUNKS of (archive URI, number of the member, length) triples; a large member is a task of its own. Tasks take a core's
    share of the text, from a chunk to TASK_BYTES, so all cores have some."""
    share = sum(length for _, _, length in members) // spark.sparkContext.defaultParallelism
    return read_parts(spark, "zip_chunks", CHUNKS, _ChunkReader, packed(members, 2, min(TASK_BYTES, max(CHUNK, share))), chunk=str(chunk))
