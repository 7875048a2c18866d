"""Readers and writers for records: JSON Lines, nested reports, TSV, FASTA, fixed-width structures."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_path(spark: SparkSession) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Only a local master, all one process, gets a folder of its own where none is."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not context.isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        root = context.getCheckpointDir().get()
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Strict: a bad line fails the read. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Bad lines give nulls; a missing path gives no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_jsonl_quarantine(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of bad lines."""
    raw = spark.read.text(path).filter(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.filter(~bad).select("r.*").drop("_bad"), parsed.filter(bad).select("value")


def json_documents(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Parse a column of JSON objects; what is not an object becomes null."""
    return df.withColumn("document", F.when(F.ltrim(F.col(text)).startswith("{"), F.from_json(text, schema)))


def record_kind(df: DataFrame, records: str = "records", inner: str = "candidates") -> str:
    """candidate_audit, report or rows, from the shape of the schema."""
    if records not in df.columns:
        return "rows"
    element = df.schema[records].dataType.elementType
    return "candidate_audit" if hasattr(element, "fieldNames") and inner in element.fieldNames() else "report"


def unnest_audit(df: DataFrame, records: str, inner: str, carry: Sequence[Column] = ()) -> DataFrame:
    """One row a candidate, with parent columns and an id step-00000-rank-0000."""
    r = df.select(*carry, F.posexplode(records).alias("step", "_r"))
    c = r.select(*[x for x in r.columns if x != "_r"], F.posexplode(F.col("_r")[inner]).alias("rank", "candidate"))
    return c.withColumn("candidate_id", F.format_string("step-%05d-rank-%04d", "step", "rank"))


def unnest_report(df: DataFrame, records: str, carry: Sequence[Column] = ()) -> DataFrame:
    return df.select(*carry, F.explode(records).alias("record"))


def discover(spark: SparkSession, root: str, include: str, exclude: str | None = None) -> DataFrame:
    """Files under a root whose path matches one pattern and not another, with size and time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    files = files.filter(F.col("path").rlike(include))
    return files.filter(~F.col("path").rlike(exclude)) if exclude else files


def unique_by(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """df, failing when it is run if a key occurs twice."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.concat_ws(",", *key)))).otherwise(F.col("_n"))).filter("_n = 1").drop("_n")


def write_jsonl(df: DataFrame, path: str, canonical: bool = False) -> None:
    """One object a line; canonical: keys in alphabetical order, nulls left out."""
    cols = sorted(df.columns) if canonical else df.columns
    df.select(F.to_json(F.struct(*cols)).alias("value")).write.text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", "true").option("quote", "\u0000").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)


def write_fasta(df: DataFrame, path: str, id_col: str, sequence: str) -> None:
    df.select(F.concat(F.lit(">"), F.col(id_col).cast("string"), F.lit("\n"), F.col(sequence)).alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id and sequence of records that begin with >."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    return records.select(head.alias("id"), F.regexp_replace(F.substring(F.col("value"), F.length(head) + 2, F.length("value")), "\\s", "").alias("sequence"))


def pending(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return todo.join(done.select(*key), list(key), "left_anti")


def same_settings(a: DataFrame, b: DataFrame, key: Sequence[str], exact: Sequence[str], close: Sequence[str] = ()) -> DataFrame:
    """Keys whose settings differ: exactly, or by more than 1e-9 relatively for doubles."""
    x = a.select(*key, *(F.col(c).alias(f"a_{c}") for c in [*exact, *close])).join(b.select(*key, *(F.col(c).alias(f"b_{c}") for c in [*exact, *close])), list(key))
    tests = [(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in exact]
    tests += [(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > 1e-9 * F.greatest(F.abs(F.col(f"a_{c}")), F.abs(F.col(f"b_{c}"))), c) for c in close]
    return x.select(*key, F.explode(F.filter(F.array(*(F.when(t, F.lit(c)) for t, c in tests)), lambda v: v.isNotNull())).alias("setting"))


def atoms(lines: DataFrame, structure: str, line: str = "value") -> DataFrame:
    """ATOM lines of fixed-width structure files: residue, atom, coordinates, confidence. Lines that do not parse are left out."""
    cut = lambda a, b: F.trim(F.substring(line, a, b))
    num = lambda a, b, kind="double": cut(a, b).try_cast(kind)
    out = lines.filter(F.col(line).startswith("ATOM")).select(
        structure, cut(13, 4).alias("atom"), cut(18, 3).alias("residue"), num(23, 4, "int").alias("number"), num(31, 8).alias("x"), num(39, 8).alias("y"), num(47, 8).alias("z"), num(61, 6).alias("confidence")
    )
    return out.dropna(subset=["number", "x", "y", "z", "confidence"])


def mean_confidence(found: DataFrame, structure: str) -> DataFrame:
    """Mean over CA atoms, with 0-1 scales brought to 0-100."""
    m = found.filter("atom = 'CA'").groupBy(structure).agg(F.avg("confidence").alias("m"))
    return m.select(structure, F.when((F.col("m") > 0) & (F.col("m") <= 1), F.col("m") * 100).otherwise(F.col("m")).alias("confidence"))


# fixed values: three-letter residue codes
THREE_LETTERS = dict(ALA="A", CYS="C", ASP="D", GLU="E", PHE="F", GLY="G", HIS="H", ILE="I", LYS="K", LEU="L", MET="M", ASN="N", PRO="P", GLN="Q", ARG="R", SER="S", THR="T", VAL="V", TRP="W", TYR="Y")


def residue_sequence(found: DataFrame, structure: str) -> DataFrame:
    """One-letter sequence of the CA atoms in residue order, and whether their numbers have no gap."""
    letter = F.create_map(*(F.lit(x) for pair in THREE_LETTERS.items() for x in pair))
    ca = found.filter("atom = 'CA'").groupBy(structure, "number").agg(F.first("residue").alias("residue"))
    listed = ca.groupBy(structure).agg(F.array_sort(F.collect_list(F.struct("number", letter[F.col("residue")].alias("letter")))).alias("r"), F.min("number").alias("low"), F.max("number").alias("high"))
    return listed.select(structure, F.array_join(F.col("r.letter"), "", "X").alias("sequence"), (F.col("high") - F.col("low") + 1 == F.size("r")).alias("contiguous"))
