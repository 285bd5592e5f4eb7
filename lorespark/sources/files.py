"""Notes as files, one a row, listed, read, written and moved in tasks.

Reading: folders are listed level by level, each in one task, which holds its names; files are dealt evenly to tasks and read there. Filters on
anything but the content come before the reading, and a content that nothing asks for is not read. With ``head`` only
the first ``HEAD`` bytes of each file are read, which is where frontmatter is.

Writing: a task attempt writes its files into a folder of its own; only when all tasks have succeeded and no path is named twice do other tasks move
them to their places, and the driver deletes what is left. A task that fails and is run again leaves nothing, and readers never see half a note. Paths are
relative to the target and may not leave it; one that two rows name is an error before anything is moved.
A file that is there already is replaced, or kept with ``existing=keep``.

The same as a Python data source (:class:`Notes`) lists, and moves, on the driver, as Spark's interface for these has it; it is for folders of
up to some ten thousand files.

Paths are those of any file system that pyarrow knows; folders are shared by driver and executors.
"""

from __future__ import annotations

import functools
import itertools
import os
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from lorespark.shared import drop, store

HEAD, GROUP_FILES = 2_048, 200
#: Rows of paths, and bytes of contents, that a task has in hand at once; tasks for each core.
BATCH, PIECE, ROUNDS = 5_000, 8 << 20, 4
SCHEMA = "path string, folder string, filename string, size long, modified timestamp, content string"
STAGING = "_staging"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _value(row: tuple[str, str], column: str) -> str:
    return row[0] if column == "folder" else row[1]


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class NotesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", ".md")
        self.head = options.get("head", "false").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps equality, membership and prefixes of folder and filename; Spark applies the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("folder",), ("filename",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, folder: str, filename: str) -> bool:
        for f in self.filters:
            own, value = _value((folder, filename), f.attribute[0]), f.value
            if not (own.startswith(value) if isinstance(f, StringStartsWith) else own in value if isinstance(f, In) else own == value):
                return False
        return True

    def _place(self, path: str, base: str) -> tuple[str, str, str]:
        inside = path[len(base) :].lstrip("/")
        folder, _, filename = inside.rpartition("/")
        return inside, folder, filename

    def partitions(self) -> Sequence[Files]:
        from pyarrow import fs

        system, base = _system(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            inside, folder, filename = self._place(info.path, base)
            if info.type == fs.FileType.File and filename.endswith(self.suffix) and not inside.startswith(STAGING) and self._wanted(folder, filename):
                found.append(info.path)
        found.sort()
        return [Files(tuple(found[k : k + GROUP_FILES])) for k in range(0, len(found), GROUP_FILES)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, base = _system(self.path)
        for info in system.get_file_info(list(partition.paths)):
            with system.open_input_file(info.path) as f:
                data = f.read(HEAD) if self.head else f.read()
            # A letter that the head's end cuts is left out.
            yield (*self._place(info.path, base), info.size, info.mtime, data.decode("utf-8", "ignore" if self.head else "replace"))


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]  # (staged path, path inside the target)


class NotesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: Sequence[str]):
        self.path, self.keep = options["path"].rstrip("/"), options.get("existing", "replace") == "keep"
        self.at, self.job = {c: columns.index(c) for c in ("path", "content")}, uuid.uuid4().hex

    def staged(self, rows: Iterator) -> Iterator[tuple[str, str]]:
        """Writes rows as files out of sight: (staged path, path inside the target) of each."""
        system, base = _system(self.path)
        staging = f"{base}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(staging, recursive=True)
        for k, row in enumerate(rows):
            path, content = row[self.at["path"]], row[self.at["content"]]
            if not path or path.startswith("/") or ".." in path.split("/") or path.startswith(STAGING):
                raise ValueError(f"not a path inside the folder: {path!r}")
            with system.open_output_stream(f"{staging}/{k}") as out:
                out.write((content or "").encode("utf-8", "surrogatepass"))
            yield f"{staging}/{k}", path

    def place(self, files: Iterable[tuple[str, str]]) -> None:
        """Moves staged files to their places; those that an attempt before has moved are there."""
        from pyarrow import fs

        system, base = _system(self.path)
        there = lambda path: system.get_file_info(path).type != fs.FileType.NotFound
        made = set()
        for staged, path in files:
            folder, target = f"{base}/{path}".rpartition("/")[0], f"{base}/{path}"
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            if isinstance(system, fs.LocalFileSystem):
                # Moves from folder to folder wait for each other in the whole file system; links do not.
                try:
                    os.link(staged, target)
                    os.unlink(staged)
                    continue
                except OSError:  # it is there already, or this file system has no links
                    pass
            if self.keep and there(target):
                if there(staged):
                    system.delete_file(staged)
                continue
            try:
                system.move(staged, target)
            except FileNotFoundError:
                if there(staged) or not there(target):
                    raise

    def write(self, iterator: Iterator) -> Written:
        return Written(tuple(self.staged(iterator)))

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        try:
            if len({path for _, path in files}) < len(files):
                raise ValueError("two rows have the same path")
            self.place(files)
        finally:
            self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        system, base = _system(self.path)
        own = f"{base}/{STAGING}/{self.job}"
        if system.get_file_info(own).type != fs.FileType.NotFound:  # an abort may follow a commit that failed
            system.delete_dir(own)


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lorespark_notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NotesReader:
        return NotesReader(self.options)

    def writer(self, schema, overwrite: bool) -> NotesWriter:
        return NotesWriter(self.options, schema.fieldNames())


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows in tasks of equal size."""
    return rows.repartition(max(1, min(-(-n // GROUP_FILES), ROUNDS * rows.sparkSession.sparkContext.defaultParallelism)))


def listed_files(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """``SCHEMA`` without content, of the files under a folder: one job for each level of folders."""
    path, listed = path.rstrip("/"), SCHEMA.removesuffix(", content string")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = _system(path)
        for folder in (f for batch in batches for f in batch[0].to_pylist()):
            found = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
            for k in range(0, len(found), BATCH):
                rows = [(f"{folder}/{i.base_name}".lstrip("/"), folder, i.base_name, i.size, i.mtime, i.type == fs.FileType.Directory) for i in found[k : k + BATCH]]
                rows = [r for r in rows if not r[0].startswith(STAGING) and (r[5] or r[2].endswith(suffix))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(TYPES), TYPES)], names)

    TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_())
    names = ["path", "folder", "filename", "size", "modified", "is_folder"]
    folders, n, levels = spark.range(1).select(F.lit("").alias("path")), 1, []
    while n:
        most = ROUNDS * spark.sparkContext.defaultParallelism
        levels.append(store(folders.repartition(min(n, most)).mapInArrow(entries, f"{listed}, is_folder boolean"), "listed"))
        folders = levels[-1].filter("is_folder").select("path")
        n = folders.count()
    return functools.reduce(DataFrame.unionByName, levels).filter("not is_folder").drop("is_folder")


def read_note_files(spark: SparkSession, path: str, suffix: str = ".md", head: bool = False) -> DataFrame:
    """``SCHEMA`` of the files that are under a folder now; with ``head`` only the beginning of their content."""

    @F.arrow_udf("string")
    def content(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        system, base = _system(path.rstrip("/"))
        for batch in batches:
            texts, size = [], 0
            for inside in batch.to_pylist():
                with system.open_input_file(f"{base}/{inside}") as f:
                    data = f.read(HEAD) if head else f.read()
                # A letter that the head's end cuts is left out.
                texts.append(data.decode("utf-8", "ignore" if head else "replace"))
                size += len(data)
                if size > PIECE:
                    yield pa.array(texts, pa.string())
                    texts, size = [], 0
            yield pa.array(texts, pa.string())

    found = listed_files(spark, path, suffix)
    return _dealt(found, found.count()).withColumn("content", content("path"))


def write_note_files(notes: DataFrame, path: str, existing: str = "replace") -> None:
    """A file for each row of ``notes`` (path, content) under a folder."""
    writer = NotesWriter({"path": path, "existing": existing}, ["path", "content"])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = writer.staged(row for batch in batches for k in range(0, batch.num_rows, GROUP_FILES) for row in zip(*(c.to_pylist() for c in batch.slice(k, GROUP_FILES).columns)))
        while some := list(itertools.islice(files, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], ["staged", "path"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            writer.place(zip(*(c.to_pylist() for c in batch.columns)))
        yield from ()

    try:
        # A file costs far more than its bytes, by which Spark sizes tasks.
        dealt = notes.select("path", "content").repartition(ROUNDS * notes.sparkSession.sparkContext.defaultParallelism, "path")
        staged = store(dealt.mapInArrow(stage, "staged string, path string"), "staged")
        twice = staged.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        twice.limit(1).select(F.raise_error(F.concat(F.lit("two rows have the path "), "path"))).collect()
        _dealt(staged, staged.count()).mapInArrow(place, staged.schema).write.format("noop").mode("append").save()
        drop(staged)
    finally:
        writer.abort([])
