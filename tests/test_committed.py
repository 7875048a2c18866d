"""Committed lines: failed, repeated and streamed writes, and a task that is retried."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.plans.q_sinks import _failing_once
from corvane.sources import committed

ROOT = Path(__file__).resolve().parent.parent
SCHEMA = "k long, s string"


def made(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('é\n"'), "id")).alias("s"))


def kept(spark, path):
    return sorted((r["k"], r["s"]) for r in committed.read_committed(spark, path, SCHEMA).fillna("-").collect())


def wanted(spark, n):
    return sorted((r["k"], r["s"]) for r in made(spark, n).fillna("-").collect())


def files(path):
    return sorted(p.name for p in (Path(path) / "data").glob("*")), sorted(p.name for p in (Path(path) / "commits").glob("*"))


def test_rows_come_back_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert kept(spark, path) == []
    committed.write_committed(made(spark, 5000), path, "a")
    committed.write_committed(made(spark, 5000), path, "a")
    assert kept(spark, path) == wanted(spark, 5000)
    committed.write_committed(made(spark, 0), path, "none")
    committed.write_committed(made(spark, 7), path, "b")
    assert kept(spark, path) == sorted(wanted(spark, 5000) + wanted(spark, 7))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.write_committed(made(spark, 10), path, "a")
    before = files(path)
    with pytest.raises(PySparkException):
        committed.write_committed(_failing_once(made(spark, 90000, 3)), path, "b")
    assert files(path) == before
    assert kept(spark, path) == wanted(spark, 10)


def test_files_that_no_commit_names_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.write_committed(made(spark, 10), path, "a")
    (Path(path) / "data" / "lost-attempt.jsonl").write_text('{"k":99}\n{"k"')
    (Path(path) / "commits" / "half.staged").write_text('{"fil')
    assert kept(spark, path) == wanted(spark, 10)


def test_overwriting_is_refused(spark, tmp_path):
    committed.write_committed(made(spark, 1), str(tmp_path / "t"), "a")
    with pytest.raises(PySparkException):
        committed._lines(made(spark, 1)).write.format(committed.FORMAT).mode("overwrite").save(str(tmp_path / "t"))


def test_long_lines_and_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(committed, "READ_BYTES", 7)
    (tmp_path / "data").mkdir()
    lines = ["", "é" * 50, "x", "", "last"]
    (tmp_path / "data" / "f").write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")
    assert [v for b in committed._read(str(tmp_path), "f") for v in b.column(0).to_pylist()] == lines


def test_stream_of_commits(spark, tmp_path):
    source, sink, place = (str(tmp_path / x) for x in ("source", "sink", "place"))

    def run():
        query = committed.write_stream_committed(committed.stream_committed(spark, source, SCHEMA), sink, "s", place).trigger(availableNow=True).start()
        query.awaitTermination()

    committed.write_committed(made(spark, 100), source, "a")
    run()
    committed.write_committed(made(spark, 20), source, "b")
    run()
    run()
    assert kept(spark, sink) == sorted(wanted(spark, 100) + wanted(spark, 20))


RETRY = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from corvane.plans.q_sinks import _failing_once
from corvane.sources import committed
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.range(0, 90000, 1, 3).select(F.col("id").alias("k"))
committed.write_committed(_failing_once(rows), sys.argv[1], "a")
back = committed.read_committed(spark, sys.argv[1], "k long")
print("ROWS", back.count(), back.distinct().count())
"""


def test_a_retried_task_is_committed_once(tmp_path):
    """In a session of its own that allows four attempts: the first task fails once, its second attempt alone is listed."""
    path = str(tmp_path / "t")
    out = subprocess.run([sys.executable, "-c", RETRY, path], capture_output=True, text=True, timeout=180, cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, check=False)
    assert "ROWS 90000 90000" in out.stdout, out.stderr[-2000:]
    assert "a task lost on purpose" in out.stderr
    assert len(files(path)[0]) == 3
