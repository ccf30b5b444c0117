"""Spark data source over the files of cameras: ``spark.read.format("camera_files").option("ending", ".gps").load(root)``.

Files lie as ``root/<camera>/<recording><ending>``. A row is a file: camera_id, recording_id, size, modified and content.
Comparisons of camera_id and recording_id that a query makes are pushed down to the listing, so files they rule
out are never opened. A partition is a group of files of about ``partitionBytes``; a file is read whole, one at a time.

Adapters in ``wayline.sources.registry`` can read through it; ``register`` makes the format known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

SCHEMA = "camera_id STRING, recording_id STRING, size BIGINT, modified TIMESTAMP, content BINARY"
PARTITION_BYTES = 64 << 20
#: What opening a file costs, in bytes that could have been read meanwhile.
OPEN_BYTES = 1 << 20

_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b),
}
_NAMES = ("camera_id", "recording_id")


class Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


class CameraFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.ending = options["path"], options.get("ending", "")
        self.group = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[int, object, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep the comparisons of names; the others are left to Spark."""
        for f in filters:
            test = _TESTS.get(type(f))
            if test is None or len(f.attribute) != 1 or f.attribute[0] not in _NAMES:
                yield f
            else:
                self.tests.append((_NAMES.index(f.attribute[0]), type(f), f.value))

    def _wanted(self, names: tuple[str, str]) -> bool:
        return all(_TESTS[kind](names[i], value) for i, kind, value in self.tests)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _file_system(self.root)
        out: list[Files] = []
        held, size = [], 0
        for folder in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            # a camera ruled out is not even listed
            if folder.type != fs.FileType.Directory or not all(_TESTS[k](folder.base_name, v) for i, k, v in self.tests if i == 0):
                continue
            for info in sorted(system.get_file_info(fs.FileSelector(folder.path)), key=lambda i: i.path):
                if info.type != fs.FileType.File or not info.base_name.endswith(self.ending):
                    continue
                names = (folder.base_name, info.base_name[: len(info.base_name) - len(self.ending)])
                if self._wanted(names):
                    held.append((info.path, *names, info.size, info.mtime))
                    size += info.size + OPEN_BYTES
                    if size >= self.group:
                        out.append(Files(held))
                        held, size = [], 0
        if held or not out:
            out.append(Files(held))
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.root)
        for path, camera, recording, size, modified in partition.rows:
            with system.open_input_stream(path) as source:
                yield camera, recording, size, modified, source.read()


class CameraFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "camera_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CameraFilesReader:
        return CameraFilesReader(self.options)


def write_files(files: DataFrame, root: str, ending: str) -> None:
    """Write camera_id, recording_id and content in the layout that the source reads; one row is one file."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        system, folder = _file_system(root)
        for batch in batches:
            for camera, recording, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system.create_dir(f"{folder}/{camera}", recursive=True)
                with system.open_output_stream(f"{folder}/{camera}/{recording}{ending}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    named = files.select(F.col("camera_id").cast("string"), F.col("recording_id").cast("string"), F.col("content").cast("binary"))
    named.mapInArrow(run, "n BIGINT").write.format("noop").mode("overwrite").save()


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CameraFiles)
