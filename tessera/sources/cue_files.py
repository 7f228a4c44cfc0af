"""Cue files as a data source: ``spark.read.format("cue_files").load(folder)``.

One row a file with its place among the files of its folder: those a user
provided first, then by suffix, then the newest.  Equality filters on place,
suffix and folder are taken over from Spark
(``spark.sql.python.filterPushdown.enabled``), so other files are never opened.
The driver lists names only; files are dealt into partitions by size.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tessera.sources.cues import cues_of

# The suffixes in their order, and the size up to which a file counts as empty.
SUFFIXES = ["srt", "vtt", "json3", "txt"]
EMPTY = 32
COLUMNS = ["path", "folder", "suffix", "place", "bytes", "modified", "value"]


@dataclass
class FileGroup(InputPartition):
    rows: list[tuple]


class CueFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.group_bytes = options["path"], int(options.get("groupbytes", 64 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if column in ("place", "suffix", "folder"):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def _files(self) -> list[tuple]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        found: dict[str, list] = {}
        for x in system.get_file_info(fs.FileSelector(root, recursive=True)):
            suffix = x.extension.lower()
            if x.type == fs.FileType.File and suffix in SUFFIXES and x.size > EMPTY:
                order = (not x.base_name.lower().startswith("provided"), SUFFIXES.index(suffix), -x.mtime_ns, x.path)
                found.setdefault(x.path.rpartition("/")[0], []).append((order, x.path, suffix, x.size, x.mtime_ns))
        rows = []
        for folder, files in sorted(found.items()):
            rows += [(path, folder, suffix, place, size, datetime.fromtimestamp(ns / 1e9, timezone.utc)) for place, (_, path, suffix, size, ns) in enumerate(sorted(files))]
        return [r for r in rows if all(r[COLUMNS.index(c)] in values for c, values in self.wanted.items())]

    def partitions(self) -> list[FileGroup]:
        groups, held = [], 0
        for row in self._files():
            if not groups or held + row[4] > self.group_bytes:
                groups.append(FileGroup([]))
                held = 0
            groups[-1].rows.append(row)
            held += row[4]
        return groups or [FileGroup([])]

    def read(self, partition: FileGroup):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        for row in partition.rows:
            with system.open_input_stream(row[0]) as f:
                yield (*row, f.read().decode("utf-8", errors="replace"))


class CueFiles(DataSource):
    """Options: ``path`` (a folder, absolute or a URI), ``groupBytes`` (most bytes of files in a partition, one file at least)."""

    @classmethod
    def name(cls) -> str:
        return "cue_files"

    def schema(self) -> str:
        return "path string, folder string, suffix string, place int, bytes long, modified timestamp, value string"

    def reader(self, schema) -> CueFilesReader:
        return CueFilesReader(dict(self.options))


def best_cues(spark: SparkSession, folder: str) -> DataFrame:
    """The cues of the first file of each folder under ``folder``: path, idx, start_ms, end_ms, text."""
    spark.dataSource.register(CueFiles)
    files = spark.read.format("cue_files").load(folder).where("place = 0")
    return cues_of(files.select("path", F.regexp_replace("value", "^\ufeff", "").alias("value")))
