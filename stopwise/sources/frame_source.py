"""Metadata of TIFF and DNG files as a Spark data source: directories are read by ranges, samples never.

    spark.read.format("stopwise_frames").schema("path string, width int").load(folder)

``frames`` registers it and lists a flat folder. A partition is a group of files. Columns that aren't asked for are not made, and where only path, extension and
file_bytes are, no file is opened; filters on path and extension that Spark hands down leave files out before they are opened (where ``spark.sql.python.filterPushdown.enabled`` is on).

Files may be on any file system that pyarrow can open by URI. Edge cases: an empty folder gives no rows; files with other extensions, folders and
whatever else isn't a regular file are left out; a file that is no TIFF raises, with its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

from stopwise.deploy import ship
from stopwise.sources import dng
from stopwise.sources.tags import Ranged

NAME = "stopwise_frames"
EXTENSIONS = ("dng", "tif", "tiff")
#: Of one partition.
FILES = 256
SCHEMA = f"path string, extension string, file_bytes long, fetched_bytes long, {dng.SCHEMA}, corrections_present boolean"
UNOPENED = {"path", "extension", "file_bytes"}


def extension(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2].lower()


class Files(InputPartition):
    def __init__(self, found: list[tuple[str, int]]):
        self.found = found


class Scheme:
    """Names of a folder's files as they were asked for, and as its file system knows them."""

    def __init__(self, folder: str):
        self.fs, self.base = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.folder = folder.rstrip("/")

    def listed(self) -> list[tuple[str, int]]:
        found = self.fs.get_file_info(FileSelector(self.base, recursive=False))
        return sorted((f"{self.folder}/{f.base_name}", f.size) for f in found if f.type == FileType.File and extension(f.path) in EXTENSIONS)

    def open(self, path: str):
        return self.fs.open_input_file(f"{self.base.rstrip('/')}/{path.rpartition('/')[2]}")


class FrameReader(DataSourceReader):
    def __init__(self, folder: str, schema: T.StructType, files: int):
        self.folder, self.names, self.files = folder, schema.names, files
        self.arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])
        self.kept: list = []

    def passes(self, path: str) -> bool:
        for f in self.kept:
            value = path if f.attribute == ("path",) else extension(path)
            if isinstance(f, (EqualTo, In)):
                ok = value in (f.value if isinstance(f, In) else [f.value])
            else:
                ok = value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value)
            if not ok:
                return False
        return True

    def partitions(self) -> list[Files]:
        found = [x for x in Scheme(self.folder).listed() if self.passes(x[0])]
        return [Files(found[a : a + self.files]) for a in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        place, rows = Scheme(self.folder), []
        for path, size in partition.found:
            row = {"path": path, "extension": extension(path), "file_bytes": size}
            if not set(self.names) <= UNOPENED:
                with place.open(path) as file:
                    data = Ranged(file, size)
                    try:
                        row |= dng.info(data)
                    except Exception as e:
                        raise ValueError(f"{path}: {e}") from e
                    row["fetched_bytes"] = data.fetched
                row["corrections_present"] = row["corrections"] != "" if row["is_dng"] else None
            rows.append({n: row[n] for n in self.names})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)


class FilteringReader(FrameReader):
    """Takes filters on path and extension; Spark refuses such a reader where its pushdown to Python sources is off."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("path",), ("extension",)):
                self.kept.append(f)
            else:
                yield f


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FrameReader:
        kind = FilteringReader if self.options.get("pushdown") == "true" else FrameReader
        return kind(self.options["path"], schema, int(self.options.get("filesPerPartition", FILES)))


def frames(spark: SparkSession, folder: str, *columns: str, files: int = FILES) -> DataFrame:
    """The metadata ``columns`` (all of SCHEMA where none are named) of a flat folder's frames."""
    ship(spark)
    spark.dataSource.register(FrameSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(NAME).option("filesPerPartition", files).option("pushdown", push)
    if columns:
        kinds = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(folder)
