"""A source of JSON lines that can be read as a table or followed as a stream (Z-02, S-12).

``register`` makes the format ``record_lines`` known to a session. Options: ``path`` (a folder
or a file, any file system that pyarrow knows by its scheme), ``key`` (records without it are
skipped, as are blank and broken lines) and ``block`` (bytes of a partition, about). Columns:

    key string, record string, file string, at long

``record`` is the line itself and ``at`` its first byte. As a batch, files are cut into blocks
and a line belongs to the block that it begins in. As a stream, the offset is the number of
bytes read of each file, always at the end of a line: a restart goes on in the middle of a
file, a line that is still being written waits, and files may be added or grow."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 1 << 24
SCHEMA = "key string, record string, file string, at long"


class Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file."""

    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> dict[str, int]:
    """Sizes of the files at a path by name; hidden ones are left out."""
    from pyarrow import fs

    system, plain = _open(path)
    info = system.get_file_info(plain)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(plain, recursive=True))
    return {f.path: f.size for f in found if f.is_file and not f.base_name.startswith((".", "_"))}


def _lines(path: str, part: Part) -> Iterator[tuple[int, bytes]]:
    """The lines that begin inside a part, with their first byte."""
    system, _ = _open(path)
    with system.open_input_file(part.file) as source:
        size, at, held = source.size(), part.start, b""
        if at:  # a line that began before belongs to the part before
            source.seek(at - 1)
            while at <= part.end:
                more = source.read(1 << 16)
                cut = more.find(b"\n")
                if cut >= 0 or not more:
                    at = at - 1 + cut + 1 if more else size
                    break
                at += len(more)
        source.seek(at)
        while at < part.end:
            cut = held.find(b"\n")
            if cut < 0:
                more = source.read(1 << 20)
                if more:
                    held += more
                    continue
                cut = len(held)
                if not held:
                    return
            yield at, held[:cut]
            at, held = at + cut + 1, held[cut + 1 :]


def _records(options: dict, part: Part) -> Iterator[tuple]:
    key = options.get("key", "image_path")
    for at, line in _lines(options["path"], part):
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if isinstance(record, dict) and record.get(key) is not None:
            yield str(record[key]), line.decode().strip(), part.file, at


def _cut(file: str, start: int, end: int, block: int) -> list[Part]:
    return [Part(file, k, min(k + block, end)) for k in range(start, end, block)]


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Part]:
        block = int(self.options.get("block", BLOCK))
        return [p for f, n in sorted(_files(self.options["path"]).items()) for p in _cut(f, 0, n, block)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _records(self.options, partition) if partition.end else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the last whole line of every file."""
        system, _ = _open(self.options["path"])
        out = {}
        for file, size in _files(self.options["path"]).items():
            with system.open_input_file(file) as source:
                at = size
                while at > 0:
                    first = max(0, at - (1 << 16))
                    source.seek(first)
                    cut = source.read(at - first).rfind(b"\n")
                    at = first + cut + 1 if cut >= 0 else first
                    if cut >= 0:
                        break
                if at:
                    out[file] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        block = int(self.options.get("block", BLOCK))
        return [p for f, n in sorted(end.items()) for p in _cut(f, start.get(f, 0), n, block)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return _records(self.options, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the checkpoint."""


class RecordLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordLines)


def last_of_each(records: DataFrame) -> DataFrame:
    """S-12: the last line of each key: of the file whose name sorts last, then by place."""
    best = F.row_number().over(W.partitionBy("key").orderBy(F.desc("file"), F.desc("at")))
    return records.withColumn("_r", best).where("_r = 1").drop("_r")
