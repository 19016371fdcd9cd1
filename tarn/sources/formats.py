"""Copy functions: formats of a user's own, by functions that write and read one file."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _open(path: str, mode: str):
    """A file of a store that Arrow's file systems know; plain paths are local."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    if mode == "rb":
        return files.open_input_stream(name)
    files.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return files.open_output_stream(name)


def _list(path: str) -> list[str]:
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    found = files.get_file_info(fs.FileSelector(name)) if files.get_file_info(name).is_file is False else [files.get_file_info(name)]
    return sorted(scheme + f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def register(
    spark: SparkSession, name: str, write: Callable[[Iterable[tuple], list[str]], Iterator[bytes]], read: Callable[[object, StructType], Iterator[tuple]]
) -> None:
    """Make ``df.write.format(name)`` and ``spark.read.format(name)`` work.

    ``write(rows, columns)`` gives a file's pieces; ``read(stream, schema)`` gives the rows of
    one.  Every task writes one file; a write that fails leaves files that no reader is told
    of only until its folder is deleted, so write to a new folder.  Reading takes a schema.
    """

    class Writer(DataSourceWriter):
        def __init__(self, path: str, columns: list[str]):
            self.path, self.columns = path, columns

        def write(self, rows: Iterator) -> WriterCommitMessage:
            own = f"{self.path.rstrip('/')}/part-{uuid.uuid4().hex}.{name}"
            with _open(own, "wb") as out:
                for piece in write((tuple(r) for r in rows), self.columns):
                    out.write(piece)
            return WriterCommitMessage()

    class Reader(DataSourceReader):
        def __init__(self, path: str, schema: StructType):
            self.path, self.schema = path, schema

        def partitions(self) -> list[InputPartition]:
            return [_File(p) for p in _list(self.path)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            with _open(partition.value, "rb") as stream:
                yield from read(stream, self.schema)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(self.options["path"], schema)

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return Writer(self.options["path"], schema.fieldNames())

    spark.dataSource.register(Source)
