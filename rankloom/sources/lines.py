"""JSON lines as a data source of its own: read by byte ranges, written in batches with one commit a task."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "json_line_documents"
RANGE_BYTES = 32 << 20
BATCH = 400
_ROWS = 2048


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path on it."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, stop) of a file."""

    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int):
        super().__init__(None)
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, size: int):
        self.schema, self.path, self.size = schema, path, size

    def partitions(self) -> list[Range]:
        files, root = _open(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else [f for f in files.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".jsonl") and "/_" not in f.path.removeprefix(root)]
        return [Range(f.path, a, min(a + self.size, f.size)) for f in sorted(found, key=lambda f: f.path) for a in range(0, f.size, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        rows: list[dict] = []
        for record in _records(_open(self.path)[0], partition) if partition.path else ():
            rows.append({f.name: record.get(f.name) for f in self.schema.fields})
            if len(rows) == _ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _records(files: fs.FileSystem, part: Range) -> Iterator[dict]:
    """The objects on the lines that begin in a range; blank lines and lines that are no object are skipped."""
    with files.open_input_file(part.path) as raw:
        at = max(part.start - 1, 0)  # a line begins where the byte before is a line end
        raw.seek(at)
        rest, first = b"", part.start > 0
        while at < part.stop or rest:
            block = raw.read(1 << 20)
            lines = (rest + block).split(b"\n")
            rest = lines.pop() if block else b""
            for line in lines:
                begins, at = at, at + len(line) + 1
                if first:
                    first = False
                    continue
                if begins >= part.stop:
                    return
                try:
                    record = json.loads(line) if line.strip() else None
                except ValueError:
                    continue
                if isinstance(record, dict):
                    yield record
            if not block:
                return


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceWriter):
    """Every task writes one file beside the table; the driver moves those of finished tasks in, and a manifest last."""

    def __init__(self, path: str, batch: int, overwrite: bool):
        self.path, self.batch, self.overwrite, self.job = path, batch, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> _Written:
        files, root = _open(self.path)
        files.create_dir(f"{root}/_tasks-{self.job}", recursive=True)
        name = f"{root}/_tasks-{self.job}/{uuid.uuid4().hex}.jsonl"
        n, held = 0, []
        with files.open_output_stream(name) as out:
            for row in rows:
                held.append(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
                if len(held) == self.batch:
                    out.write(("\n".join(held) + "\n").encode())
                    n, held = n + len(held), []
            if held:
                out.write(("\n".join(held) + "\n").encode())
        return _Written(name, n + len(held))

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _open(self.path)
        done = [m for m in messages if m is not None and m.rows]
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.is_file:
                    files.delete_file(f.path)
        for m in done:
            files.move(m.file, f"{root}/{self.job}-{m.file.rsplit('/', 1)[1]}")
        with files.open_output_stream(f"{root}/_manifest-{self.job}.json") as out:
            out.write(json.dumps({"rows": sum(m.rows for m in done), "files": len(done)}).encode())
        files.delete_dir(f"{root}/_tasks-{self.job}")

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = _open(self.path)
        if files.get_file_info(f"{root}/_tasks-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/_tasks-{self.job}")


class JsonLineDocuments(DataSource):
    """Options: path, range_bytes (what one task reads), batch (documents written at once)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("batch", BATCH)), overwrite)


def read_line_documents(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of all ``.jsonl`` files below a path that Arrow's file systems reach, a task for every ``range_bytes``."""
    spark.dataSource.register(JsonLineDocuments)
    return spark.read.format(NAME).schema(schema).option("path", path).option("range_bytes", range_bytes).load()


def write_line_documents(df: DataFrame, path: str, batch: int = BATCH, overwrite: bool = True) -> None:
    """One file a partition, documents in batches; nothing shows before all tasks are done, and a failed task leaves nothing."""
    df.sparkSession.dataSource.register(JsonLineDocuments)
    df.write.format(NAME).option("path", path).option("batch", batch).mode("overwrite" if overwrite else "append").save()


def for_each_batch_of_rows(df: DataFrame, visit: Callable[[list[dict]], None], size: int = 1000) -> None:
    """Call ``visit`` with rows as dictionaries, ``size`` at most at a time, in the tasks that hold them; no task holds more."""

    def run(rows: Iterator[Row]) -> None:
        held = []
        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) == size:
                visit(held)
                held = []
        if held:
            visit(held)

    df.foreachPartition(run)
