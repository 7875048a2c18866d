"""Lines written all or not at all: a data source whose tasks stage files that one commit makes visible.

A path holds `data/`, where every attempt of a task writes a file of its own name, and
`commits/`, one small listing a write. Readers open only what a listing names, so what a
failed, killed or speculative attempt left is never seen. A write carries a batch name;
a name that is committed already adds nothing, so a run may be repeated after a loss.
Writes to one path come one after the other, which a batch job or a stream does.

A listing is one file name a task. Lines are JSON objects made and parsed by Spark
(`write_committed`, `read_committed`): Python moves whole Arrow batches of text only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

FORMAT = "committed_lines"
SCHEMA = pa.schema([("value", pa.string())])
READ_BYTES = 1 << 22


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, whatever its scheme, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _commits(path: str) -> list[str]:
    """Names of the listings of a path, oldest first."""
    system, root = _place(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json"))


def _listed(path: str, commits: list[str]) -> list[InputPartition]:
    system, root = _place(path)
    out = []
    for name in commits:
        with system.open_input_stream(f"{root}/commits/{name}") as file:
            out += [InputPartition(f) for f in json.loads(file.read())["files"]]
    return out


def _read(path: str, name: str) -> Iterator[pa.RecordBatch]:
    """The lines of one file, some megabytes at a time."""
    system, root = _place(path)
    with system.open_input_stream(f"{root}/data/{name}") as file:
        rest = b""
        while block := file.read(READ_BYTES):
            head, end, tail = (rest + block).rpartition(b"\n")
            rest = tail
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(head.decode().split("\n"), pa.string())], schema=SCHEMA)


@dataclass
class Staged(WriterCommitMessage):
    """What a task staged: its file, or none where it had no rows."""

    file: str | None


class _Writer:
    """Task side: `stage`. Driver side: `publish` or `withdraw`."""

    def __init__(self, path: str):
        self.path, self.write_id = path, uuid.uuid4().hex

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        system, root = _place(self.path)
        system.create_dir(f"{root}/data", recursive=True)
        name, out = f"{self.write_id}-{uuid.uuid4().hex}.jsonl", None
        try:
            for batch in batches:
                if batch.num_rows:
                    out = out or system.open_output_stream(f"{root}/data/{name}")
                    out.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
        finally:
            if out is not None:
                out.close()
        return Staged(name if out is not None else None)

    def _staged(self, system: fs.FileSystem, root: str) -> list[fs.FileInfo]:
        found = system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True))
        return [f for f in found if f.base_name.startswith(self.write_id)]

    def publish(self, batch: str, messages: list[Staged | None]) -> None:
        """The listing appears by one rename; attempts that it does not name are deleted."""
        system, root = _place(self.path)
        before = _commits(self.path)
        if any(name.split("-", 1)[1] == f"{batch}.json" for name in before):
            return self.withdraw()
        files = [m.file for m in messages if m is not None and m.file is not None]
        system.create_dir(f"{root}/commits", recursive=True)
        hidden = f"{root}/commits/{self.write_id}.staged"
        with system.open_output_stream(hidden) as out:
            out.write(json.dumps({"batch": batch, "files": files}).encode())
        system.move(hidden, f"{root}/commits/{len(before):012d}-{batch}.json")
        for f in self._staged(system, root):
            if f.base_name not in files:
                system.delete_file(f.path)

    def withdraw(self) -> None:
        system, root = _place(self.path)
        for f in self._staged(system, root):
            system.delete_file(f.path)


class _BatchWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.files, self.batch = _Writer(path), batch

    def write(self, iterator):
        return self.files.stage(iterator)

    def commit(self, messages):
        self.files.publish(self.batch, messages)

    def abort(self, messages):
        self.files.withdraw()


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, batch: str):
        self.files, self.batch = _Writer(path), batch

    def write(self, iterator):
        return self.files.stage(iterator)

    def commit(self, messages, batchId):
        self.files.publish(f"{self.batch}-{batchId}", messages)

    def abort(self, messages, batchId):
        self.files.withdraw()


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return _listed(self.path, _commits(self.path))

    def read(self, partition):
        if partition is not None and partition.value is not None:
            yield from _read(self.path, partition.value)


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of commits: a micro-batch is whole commits."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self):
        return {"commits": 0}

    def latestOffset(self):
        return {"commits": len(_commits(self.path))}

    def partitions(self, start, end):
        return _listed(self.path, _commits(self.path)[start["commits"] : end["commits"]])

    def read(self, partition):
        yield from _read(self.path, partition.value)


class CommittedLines(DataSource):
    """Options: path, and batch, the name of the write (in a stream, its prefix)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def _batch(self) -> str:
        return self.options.get("batch") or uuid.uuid4().hex

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("committed lines are only appended to; a new set goes to a new path")
        return _BatchWriter(self.options["path"], self._batch())

    def streamWriter(self, schema, overwrite):
        return _StreamWriter(self.options["path"], self._batch())


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_committed(df: DataFrame, path: str, batch: str) -> None:
    """Append df as JSON lines under a batch name: all rows or, if the write fails or the name is committed, none."""
    df.sparkSession.dataSource.register(CommittedLines)
    _lines(df).write.format(FORMAT).option("batch", batch).mode("append").save(path)


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all commits of a path; a path without any gives no rows."""
    spark.dataSource.register(CommittedLines)
    return spark.read.format(FORMAT).load(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def stream_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same rows as a stream of commits."""
    spark.dataSource.register(CommittedLines)
    return spark.readStream.format(FORMAT).load(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def write_stream_committed(df: DataFrame, path: str, batch: str, checkpoint: str):
    """A stream writer (not started) that appends each micro-batch once, whatever is replayed."""
    df.sparkSession.dataSource.register(CommittedLines)
    return _lines(df).writeStream.format(FORMAT).option("batch", batch).option("path", path).option("checkpointLocation", checkpoint)
