"""M1: digests of byte ranges of files, as a Spark data source: ``path, chunk, n_bytes, digest``.

A file of any size is many ranges of ``chunkbytes``; a task reads one chunk at a time, so nothing holds a whole file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framekit.sources.raw_frames import files_below, packed, qualified

SCHEMA = "path string, chunk bigint, n_bytes bigint, digest string"
#: Bytes that a task reads, and what opening one more file counts as.
TASK_BYTES, OPEN_BYTES = 256 << 20, 4 << 20


@dataclass
class Chunks(InputPartition):
    """Ranges of files, each as path, first byte and length."""

    ranges: list[tuple[str, int, int]]


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.suffix, self.chunk = options["path"].split(","), options.get("suffix", ""), int(options["chunkbytes"])

    def partitions(self) -> list[InputPartition]:
        step = max(1, TASK_BYTES // self.chunk) * self.chunk
        ranges = [
            (path, at, min(step, size - at)) for path, size in sorted(files_below(self.paths, self.suffix)) for at in range(0, max(size, 1), step)
        ]
        return [Chunks(group) for group in packed(ranges, [n for _, _, n in ranges], TASK_BYTES, OPEN_BYTES)] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[tuple]:
        from pyarrow import fs

        for path, first, size in partition.ranges:
            system, root = fs.FileSystem.from_uri(path)
            with system.open_input_file(root) as file:
                for at in range(first, first + max(size, 1), self.chunk):
                    data = file.read_at(min(self.chunk, first + size - at), at)
                    yield path, at // self.chunk, len(data), hashlib.sha256(b"0:" + data).hexdigest()


class FileChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkReader:  # type: ignore[no-untyped-def]
        return ChunkReader(dict(self.options))


def digest_chunks(spark: SparkSession, paths: str | Sequence[str], suffix: str = "", chunk_bytes: int = 8 << 20) -> DataFrame:
    """SHA-256 of ``0:`` and each chunk of the files below ``paths``; an empty file is one empty chunk."""
    spark.dataSource.register(FileChunks)
    named = [paths] if isinstance(paths, str) else paths
    reader = spark.read.format("file_chunks").option("suffix", suffix).option("chunkBytes", str(chunk_bytes))
    return reader.option("path", ",".join(qualified(spark, p) for p in named)).load()
