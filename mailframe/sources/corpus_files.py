"""A folder of files as a data source: every file of the wanted kinds, in partitions of even bytes.

Spark's own file readers leave out empty files and names that begin with a dot or an underscore.
This one lists whatever the file system holds, packs files in the order of their paths into
partitions of about the same number of bytes, and reads them on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from mailframe import fixed

FORMAT = "corpus_files"
# The bytes of one partition, and of one batch within it; a larger file is alone in both.
PARTITION_BYTES = 64 * 2**20
BATCH_BYTES = 4 * 2**20
# Opening a file costs about as much as reading so many bytes.
FILE_COST = 64 * 2**10
SCHEMA = "path string, length long, content binary, read_error string"


def _extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def check_path(path: str, extensions: tuple[str, ...] = fixed.CORPUS_EXTENSIONS) -> fs.FileInfo:
    """What is at ``path``; raises where nothing is, or a file of another kind."""
    system, root = file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {path!r}")
    if info.type == fs.FileType.File and _extension(root) not in extensions:
        raise ValueError(f"file must be {' or '.join(extensions)}, got {info.base_name!r}")
    return info


def list_files(path: str, extensions: tuple[str, ...] = fixed.CORPUS_EXTENSIONS) -> list[tuple[str, int]]:
    """(path, bytes) of all files of these extensions below ``path``, or of ``path`` itself, in order.

    Whole folders are listed, hidden names and empty files too.
    """
    system, root = file_system(path)
    info = check_path(path, extensions)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and _extension(f.path) in extensions)


def pack(files: list[tuple[str, int]], limit: int = PARTITION_BYTES) -> list[list[tuple[str, int]]]:
    """Neighbouring files together until their bytes, and the cost of opening each, reach the limit."""
    parts: list[list[tuple[str, int]]] = []
    room = 0
    for path, size in files:
        cost = (size or 0) + FILE_COST
        if not parts or cost > room:
            parts.append([])
            room = limit
        parts[-1].append((path, size))
        room -= cost
    return parts


@dataclass
class FileList(InputPartition):
    files: list[tuple[str, int]]


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[FileList]:
        return [FileList(part) for part in pack(list_files(self.path), self.limit)] or [FileList([])]

    def read(self, partition: FileList) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows, held = [], 0
        for path, size in partition.files:
            if rows and held + (size or 0) > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
            try:
                with system.open_input_stream(path) as file:
                    content, error = file.read(), None
            except OSError as failure:
                # A file that cannot be read is a record that says so.
                content, error = None, str(failure)
            rows.append((path, size, content, error))
            held += size or 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    types = (pa.string(), pa.int64(), pa.binary(), pa.string())
    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "length", "content", "read_error"])


class CorpusFiles(DataSource):
    """``spark.read.format("corpus_files").load(folder)``; option ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CorpusReader:
        return CorpusReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusFiles)


def write_files(files: DataFrame, root: str) -> int:
    """Write rows of (name, content) as files below ``root``; names may hold folders. Returns how many.

    A task that runs again writes the same files again.
    """
    system, base = file_system(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{base}/{name}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as file:
                    file.write(content or b"")
                count += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

    written = files.select("name", F.col("content").cast("binary")).mapInArrow(write, "n long")
    return written.agg(F.sum("n")).first()[0] or 0
