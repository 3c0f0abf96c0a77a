"""Tables with a header, read by the names of their columns.

Small files, one for each source (``read_files``), are read whole through Spark's own file
reader, so that they may lie in any store, and parsed by their own header; a file that can't be
parsed is one row that says why. Large tables (``read_table``) are read in splits.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_FLAGS = {"true": True, "false": False, "1": True, "0": False}
#: fixed values: the format's data types and what they are here
KINDS = {"bool": bool, "string": str, **{f"{u}int{n}": int for u in ("", "u") for n in (8, 16, 32, 64)}, **{f"float{n}": float for n in (16, 32, 64, 128)}}


def header(comments: list[str]) -> tuple[str, dict[str, str]]:
    """Delimiter, and the columns with their data types, of an ECSV header's YAML lines (without ``#``); a space and none without one."""
    text = "\n".join(comments)
    if not text.lstrip().startswith("%ECSV"):
        return " ", {}
    delimiter = re.search(r"^\s*delimiter:\s*['\"]?(.)['\"]?\s*$", text, re.M)
    entries = re.split(r"^\s*-\s+(?=\{|name:)", text.split("datatype:", 1)[1], flags=re.M)[1:] if "datatype:" in text else []
    value = r":\s*(?:'([^']*)'|\"([^\"]*)\"|([^,}\n]+))"
    columns = {}
    for entry in entries:
        name, kind = (re.search(rf"\b{key}{value}", entry) for key in ("name", "datatype"))
        if not name or not kind:
            raise ValueError("a column without name or datatype")
        columns["".join(g or "" for g in name.groups()).strip()] = "".join(g or "" for g in kind.groups()).strip()
    unknown = set(columns.values()) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown datatype {sorted(unknown)[0]}")
    return delimiter.group(1) if delimiter else " ", columns


def parse(content: bytes, wanted: dict[str, type], needed: set[str]) -> dict[str, list]:
    """The wanted columns of a file's text, by name; absent ones are null, unless ``needed``. Empty cells are masked, so null."""
    lines = content.decode("utf-8").splitlines()
    delimiter, declared = header([x.lstrip()[1:].removeprefix(" ") for x in lines if x.lstrip().startswith("#")])
    body = [x.rstrip() for x in lines if x.strip() and not x.lstrip().startswith("#")]
    if not body:
        raise ValueError("no header line")
    rows = list(csv.reader(body, delimiter=delimiter, skipinitialspace=True))
    names = rows[0]
    if declared and list(declared) != names:
        raise ValueError("the header line differs from the declared columns")
    if any(len(r) != len(names) for r in rows):
        raise ValueError("a line of another length")
    absent = needed - set(names)
    if absent:
        raise ValueError(f"no column {sorted(absent)[0]}")

    def cell(x: str, kind: type):
        return None if x == "" else _FLAGS[x.lower()] if kind is bool else kind(x)

    return {c: [cell(r[names.index(c)], kind) for r in rows[1:]] if c in names else [None] * (len(rows) - 1) for c, kind in wanted.items()}


def read_files(spark: SparkSession, folder: str, pattern: str, schema: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``schema`` of all files ``pattern`` anywhere under ``folder``, with ``path``, the row's place ``ord`` and ``error``.

    Columns are found by name in each file's own header, whatever their order; further
    ones are left out, absent ones are null, but a file without a ``needed`` one, or one that
    can't be parsed, is a single row with an ``error``. An empty table has no rows.
    """
    fields = StructType.fromDDL(schema)
    kinds = {"double": float, "float": float, "boolean": bool, "string": str}
    wanted = {f.name: kinds.get(f.dataType.typeName(), int) for f in fields}
    out = pa.schema([("path", pa.string()), ("ord", pa.int64()), ("error", pa.string()), *to_arrow_schema(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                error = None
                try:
                    columns = parse(content, wanted, set(needed))
                    n = len(next(iter(columns.values())))
                except (ValueError, KeyError, csv.Error) as e:
                    error, n, columns = str(e)[:200] or type(e).__name__, 1, {c: [None] for c in wanted}
                arrays = [[path] * n, range(n), [error] * n, *columns.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(arrays, out, strict=True)], schema=out)

    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    return reader.load(folder).select("path", "content").mapInArrow(run, f"path string, ord long, error string, {schema}")


def bad_files(rows: DataFrame) -> DataFrame:
    """``path, error`` of the files of ``read_files`` that were skipped."""
    return rows.where("error is not null").select("path", "error")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of ``schema``, by name, of a ``.csv``, ``.dat`` (blanks) or ``.ecsv`` table with a header line.

    Comments start with ``#``; an ECSV table's delimiter is that of its header; empty or quoted empty
    cells, and cells that aren't of the type, are null. A column that the table lacks is an error; further ones are left out.
    """
    if not path.endswith((".csv", ".dat", ".ecsv")):
        raise ValueError(f"unknown suffix: {path}")
    wanted = StructType.fromDDL(schema)
    if path.endswith(".dat"):
        lines = spark.read.text(path).where(r"not value rlike '^\\s*#' and value rlike '\\S'")
        cells = lambda line: F.transform(F.regexp_extract_all(line, F.lit(r'"[^"]*"|\S+'), F.lit(0)), lambda x: F.trim(x, F.lit('"')))
        first = lines.select("value", cells(F.col("value")).alias("x")).first()
        names = first["x"] if first else []
        rows = lines.where(F.col("value") != (first["value"] if first else "")).select(cells(F.col("value")).alias("x"))
        of: dict[str, Column] = {n: F.get("x", F.lit(i)) for i, n in enumerate(names)}
    else:
        said = spark.read.text(path).where(r"value rlike '^# *delimiter:'").first() if path.endswith(".ecsv") else None
        sep = "," if path.endswith(".csv") or (said and "," in said["value"]) else " "
        rows = spark.read.option("header", True).option("comment", "#").option("sep", sep).option("enforceSchema", False).csv(path)
        names = rows.columns
        of = {n: F.col(f"`{n}`") for n in names}
    absent = [f.name for f in wanted if f.name not in of]
    if absent:
        raise ValueError(f"{path} has no column {absent[0]}, only {', '.join(names)}")
    return rows.select(*(F.nullif(of[f.name], F.lit("")).try_cast(f.dataType).alias(f.name) for f in wanted))
