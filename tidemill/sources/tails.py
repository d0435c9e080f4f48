"""The ends of large text files as a batch source: ``spark.read.format("tail").load(path)``.

Of every file under a path only the last ``bytes`` (256 KiB) are read, each in a
task of its own; a first line that was cut in half is left out.  Names and
sizes are listed on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, line bigint, value string"
TAIL_BYTES = 256 * 1024


class Tail(InputPartition):
    def __init__(self, file: str, start: int, size: int):
        self.file, self.start, self.size = file, start, size


class TailReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Tail]:
        from pyarrow import fs

        system, place = self._store()
        found = system.get_file_info(place)
        if found.type == fs.FileType.Directory:
            files = sorted((f for f in system.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File), key=lambda f: f.path)
        elif found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        else:
            files = [found]
        return [Tail(f.path, max(0, f.size - self.most), f.size) for f in files if f.size] or [Tail("", 0, 0)]

    def read(self, partition: Tail) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        system, _ = self._store()
        with system.open_input_file(partition.file) as source:
            # One byte more tells whether a line begins exactly where the tail does.
            at = max(0, partition.start - 1)
            source.seek(at)
            data = source.read(partition.size - at)
        if partition.start:
            cut = data.find(b"\n")
            data = data[cut + 1 :] if cut >= 0 else b""
        lines = data.decode(errors="replace").splitlines() if data else []
        yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines), pa.string()), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "line", "value"])


class Tails(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("bytes", TAIL_BYTES)))
