"""Fixed-width structure files: atoms, or one checked sequence a structure.

`parse_structure` is the table function for SQL, which takes a line at a time;
`structure_atoms` and `structure_sequences` give the same rows by column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .records import THREE_LETTERS

# plain types: analysis runs in a worker, where no session parses DDL
TEXT, WHOLE, REAL = StringType(), IntegerType(), DoubleType()
LEVELS = {
    "atom": dict(chain=TEXT, number=WHOLE, insertion=TEXT, residue=TEXT, atom=TEXT, x=REAL, y=REAL, z=REAL, confidence=REAL),
    "structure": dict(sequence=TEXT, residues=WHOLE, confidence=REAL, problem=TEXT),
}
INPUT = ("structure", "place", "line")
# what int and float take
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_REAL = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\s*$|^\s*[+-]?(nan|inf|infinity)\s*$"


def _number(text: str, kind: type):
    """int or float of a field; null where it is none."""
    try:
        return kind(text)
    except ValueError:
        return None


@F.udtf
class parse_structure:
    """parse_structure(TABLE(structure, place, line), level): the table is taken a structure at a time, its lines in order of place.

    level 'atom' gives a row for each ATOM line whose number, coordinates and confidence
    parse. level 'structure' gives one row for each structure: its one-letter sequence, or
    the first reason why it has none, and the mean confidence of its CA atoms in 0 to 100
    (files of 0 to 1 are scaled; 0 without a CA). Reasons: `chains` (not exactly one chain
    of residues), `numbering` (residues are not 1, 2, 3... or have insertion codes) and
    `residue` (a residue that is none of the twenty). A residue counts once, with its first
    CA line. Null lines are skipped. The key keeps the type that it has in the table.

    It keeps the CA residues of one structure, not its lines.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, level: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {*INPUT} <= {*rows.dataType.fieldNames()}:
            raise ValueError(f"parse_structure takes a table with the columns {', '.join(INPUT)}")
        if level.value not in LEVELS:
            raise ValueError(f"level must be one of {', '.join(LEVELS)}")
        schema = StructType([rows.dataType["structure"], *(StructField(name, kind) for name, kind in LEVELS[level.value].items())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("structure")], orderBy=[OrderingColumn("place")])

    def __init__(self):
        self.key, self.level, self.seen, self.names, self.confidence = None, None, {}, [], []

    def eval(self, row, level: str) -> Iterator[tuple]:
        self.key, self.level, line = row["structure"], level, row["line"]
        if line is None or not line.startswith("ATOM"):
            return
        atom, chain, number, insertion, residue = line[12:16].strip(), line[21:22], line[22:26], line[26:27].strip(), line[17:20].strip()
        place = _number(number, int)
        values = [_number(line[a:b], float) for a, b in ((30, 38), (38, 46), (46, 54), (60, 66))]
        whole = place is not None and None not in values
        if level == "atom":
            if whole:
                yield (self.key, chain.strip(), place, insertion, residue, atom, *values)
            return
        if atom == "CA":
            if whole:
                self.confidence.append(values[3])
            if (chain, number, insertion) not in self.seen:
                self.seen[chain, number, insertion] = place
                self.names.append(residue)

    def terminate(self) -> Iterator[tuple]:
        if self.level != "structure":
            return
        mean = sum(self.confidence) / len(self.confidence) if self.confidence else 0.0
        problem = None
        if len({chain for chain, _, _ in self.seen}) != 1:
            problem = "chains"
        elif list(self.seen.values()) != list(range(1, len(self.seen) + 1)) or any(code for _, _, code in self.seen):
            problem = "numbering"
        elif not all(name in THREE_LETTERS for name in self.names):
            problem = "residue"
        sequence = None if problem else "".join(THREE_LETTERS[name] for name in self.names)
        yield self.key, sequence, len(self.names), mean * 100 if 0 < mean <= 1 else mean, problem


def _fields(lines: DataFrame, structure: str, place: str, line: str) -> DataFrame:
    """The fields of each line; `is_atom` marks ATOM lines, `whole` those whose numbers parse."""
    # behind the generator a filter on the fields stays where it is and a computed line is made once, not once a field
    lines = lines.select(F.col(structure).alias(structure), F.col(place).alias("place"), F.explode(F.array(F.col(line))).alias("line"))
    cut = lambda at, n: F.substring("line", at, n)
    strip = lambda c: F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))
    plain = cut(31, 36).rlike("^[-+0-9. ]*$")
    real = lambda at, n: F.when(plain | cut(at, n).rlike(_REAL), cut(at, n).try_cast("double"))
    rows = lines.select(
        structure, "place", F.coalesce(F.startswith("line", F.lit("ATOM")), F.lit(False)).alias("is_atom"), cut(22, 1).alias("chain"), cut(23, 4).alias("digits"),
        F.when(cut(23, 4).rlike(_WHOLE), cut(23, 4).try_cast("int")).alias("number"), strip(cut(27, 1)).alias("insertion"), strip(cut(18, 3)).alias("residue"), strip(cut(13, 4)).alias("atom"),
        real(31, 8).alias("x"), real(39, 8).alias("y"), real(47, 8).alias("z"), real(61, 6).alias("confidence"),
    )
    # the same for the fields
    rows = rows.select(structure, F.inline(F.array(F.struct(*(c for c in rows.columns if c != structure)))))
    return rows.withColumn("whole", F.col("number").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull() & F.col("confidence").isNotNull())


def structure_atoms(lines: DataFrame, structure: str, place: str, line: str) -> DataFrame:
    """Atoms of structures given as lines, the key under its own name: the rows of parse_structure at level 'atom', by column expressions."""
    rows = _fields(lines, structure, place, line).filter("is_atom AND whole")
    return rows.select(structure, F.trim("chain").alias("chain"), *(c for c in LEVELS["atom"] if c != "chain"))


def structure_sequences(lines: DataFrame, structure: str, place: str, line: str) -> DataFrame:
    """Checked sequence, residues, confidence and problem of each structure: the rows of parse_structure at level 'structure'.

    Lines are cut where they are; of each structure its CA residues meet as one array.
    """
    letter = F.create_map(*(F.lit(x) for pair in THREE_LETTERS.items() for x in pair))[F.col("residue")]
    own = F.concat("chain", "digits", "insertion")  # of fixed widths up to the last
    residue = F.struct(own.alias("own"), "place", "chain", "number", (F.col("insertion") != "").alias("inserted"), letter.alias("letter"), F.when(F.col("whole"), F.col("confidence")).alias("confidence"))
    rows = _fields(lines, structure, place, line).select(structure, F.when(F.col("is_atom") & (F.col("atom") == "CA"), residue).alias("ca"))
    found = rows.groupBy(structure).agg(F.sort_array(F.collect_list("ca")).alias("ca"))
    firsts = F.filter("ca", lambda x, i: (i == 0) | (F.get("ca", i - 1)["own"] != x["own"]))
    ordered = F.sort_array(F.transform(firsts, lambda x: F.struct(x["place"].alias("place"), x["chain"].alias("chain"), x["number"].alias("number"), x["inserted"].alias("inserted"), x["letter"].alias("letter"))))
    sure = F.transform(F.sort_array(F.transform(F.filter("ca", lambda x: x["confidence"].isNotNull()), lambda x: F.struct(x["place"], x["confidence"].alias("c")))), lambda x: x["c"])
    found = found.select(structure, ordered.alias("at"), sure.alias("sure"))
    problem = (
        F.when(F.size(F.array_distinct(F.transform("at", lambda x: x["chain"]))) != 1, "chains")
        .when(F.exists(F.transform("at", lambda x, i: F.coalesce(x["number"] != i + 1, F.lit(True)) | x["inserted"]), lambda wrong: wrong), "numbering")
        .when(F.exists("at", lambda x: x["letter"].isNull()), "residue")
    )
    mean = F.coalesce(F.try_divide(F.aggregate("sure", F.lit(0.0), lambda a, c: a + c), F.size("sure")), F.lit(0.0))
    found = found.select(structure, F.array_join(F.transform("at", lambda x: x["letter"]), "").alias("sequence"), F.size("at").alias("residues"), mean.alias("mean"), problem.alias("problem"))
    scaled = F.when((F.col("mean") > 0) & (F.col("mean") <= 1), F.col("mean") * 100).otherwise(F.col("mean"))
    return found.select(structure, F.when(F.col("problem").isNull(), F.col("sequence")).alias("sequence"), "residues", scaled.alias("confidence"), "problem")


def atom_line(serial: Column, atom: Column, residue: Column, chain: Column, number: Column, x: Column, y: Column, z: Column, confidence: Column) -> Column:
    """One ATOM line of a structure file."""
    return F.format_string("ATOM  %5d %-4s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", serial, atom, residue, chain, number, x, y, z, F.lit(1.0), confidence)
