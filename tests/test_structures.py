"""The table function over structure files."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.sources import structures

SCHEMA = "structure string, place int, line string"


def line(atom, residue, chain, number, confidence, insertion=" ", x=1.5):
    return f"ATOM  {number:5d} {atom:<4s} {residue:>3s} {chain}{number:4d}{insertion}   {x:8.3f}{2.0:8.3f}{-3.25:8.3f}{1.0:6.2f}{confidence:6.2f}"


CASES = {
    "good": [line("N", "SER", "A", 1, 0.1), line("CA", "SER", "A", 1, 0.5), line("CA", "SER", "A", 1, 0.5), line("CA", "HIS", "A", 2, 0.8), "TER"],
    "two chains": [line("CA", "SER", "A", 1, 80), line("CA", "HIS", "B", 2, 90)],
    "none": ["HEADER", None, ""],
    "gap": [line("CA", "SER", "A", 1, 80), line("CA", "HIS", "A", 3, 90)],
    "late": [line("CA", "SER", "A", 2, 80)],
    "inserted": [line("CA", "SER", "A", 1, 80), line("CA", "HIS", "A", 2, 90, "A")],
    "unknown": [line("CA", "XYZ", "A", 1, 70)],
    "broken": [line("CA", "GLY", "A", 1, 70)[:40]],
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, i, t) for k, v in CASES.items() for i, t in enumerate(v)]
    return spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)


def test_sequences_and_problems(lines):
    got = {r["structure"]: (r["sequence"], r["residues"], round(r["confidence"], 6), r["problem"]) for r in structures.structure_sequences(lines, "structure", "place", "line").collect()}
    assert got == {
        "good": ("SH", 2, 60.0, None), "two chains": (None, 2, 85.0, "chains"), "none": (None, 0, 0.0, "chains"), "gap": (None, 2, 85.0, "numbering"),
        "late": (None, 1, 80.0, "numbering"), "inserted": (None, 2, 85.0, "numbering"), "unknown": (None, 1, 70.0, "residue"), "broken": ("G", 1, 0.0, None),
    }


def test_atoms(lines):
    got = structures.structure_atoms(lines.filter("structure IN ('good', 'broken')"), "structure", "place", "line").collect()
    assert len(got) == 4
    assert all((r["x"], r["y"], r["z"]) == (1.5, 2.0, -3.25) for r in got)
    assert sorted(r["atom"] for r in got) == ["CA", "CA", "CA", "N"]


def test_schema_follows_the_arguments(spark, lines):
    keyed = lines.select(F.hash("structure").cast("long").alias("k"), "place", "line")
    assert structures.structure_sequences(keyed, "k", "place", "line").schema["k"].dataType.simpleString() == "bigint"
    assert structures.structure_sequences(lines.limit(0), "structure", "place", "line").count() == 0
    with pytest.raises(PySparkException):
        structures.parse_structure(lines.select("structure").asTable(), F.lit("atom")).count()
    with pytest.raises(PySparkException):
        structures.parse_structure(lines.asTable(), F.lit("helix")).count()


def test_from_sql(spark, lines):
    spark.udtf.register("parse_structure", structures.parse_structure)
    lines.createOrReplaceTempView("structure_lines")
    got = spark.sql("SELECT structure, problem FROM parse_structure(TABLE(structure_lines), 'structure') WHERE problem = 'residue'").collect()
    assert [(r["structure"], r["problem"]) for r in got] == [("unknown", "residue")]


ODD = {
    **CASES,
    "words": [line("CA", "SER", "A", 1, 80).replace("   1.500", "   x.500"), line("CA", "HIS", "A", 2, 90).replace("   1.500", "     nan")],
    "no number": [line("CA", "SER", "A", 1, 80).replace("   1 ", "  1a ")],
    "again": [line("CA", "SER", "A", 1, 80), line("CA", "HIS", "A", 2, 90), line("CA", "GLY", "A", 1, 10), line("CA", "HIS", "A", 2, 90)],
    "short": ["ATOM", "ATOM  " + " " * 10],
}


@pytest.mark.parametrize("level", ["atom", "structure"])
def test_columns_agree_with_the_table_function(spark, level):
    """The same rows without a Python row a line."""
    rows = [(k, i, t) for k, v in ODD.items() for i, t in enumerate(v)] + [(None, 0, line("CA", "SER", "A", 1, 80))]
    lines = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)
    columns = {"atom": structures.structure_atoms, "structure": structures.structure_sequences}[level](lines, "structure", "place", "line")
    told = structures.parse_structure(lines.asTable(), F.lit(level))
    assert columns.columns == told.columns
    assert sorted(map(repr, columns.collect())) == sorted(map(repr, told.collect()))
    assert "Python" not in columns._jdf.queryExecution().executedPlan().toString()
