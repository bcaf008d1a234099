"""COPY sources and sinks: text, CSV and binary.

Text and CSV are read by Spark, split by Spark, and unescaped by column expressions.  Binary files have no row boundaries
to split at, so each file is one task of a Python reader.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import SqlError

SIGNATURE = b"PGCOPY\n\xff\r\n\0"
EMPTY = "\x01"


@dataclass
class Copy:
    table: str
    columns: list[str]
    format: str
    delimiter: str
    null: str
    header: bool
    to: bool
    path: str | None = None  # None: the client
    query: str | None = None


def parse_copy(statement: str) -> Copy:
    """COPY t [(a, b)] or COPY (query), FROM STDIN | FROM 'path' | TO STDOUT | TO 'path', [WITH] [(options)] with FORMAT, DELIMITER, NULL, HEADER."""
    m = re.match(r"\s*COPY\s+(?:([\w.\"]+)\s*(?:\(([^)]*)\))?|\((.*)\))\s+(FROM|TO)\s+(STDIN|STDOUT|'(?:[^']|'')*')\s*(?:WITH\b)?\s*(.*?);?\s*$", statement, re.I | re.S)
    if not m or (m[4].upper(), m[5].upper()) in (("FROM", "STDOUT"), ("TO", "STDIN")) or (m[3] and m[4].upper() == "FROM"):
        raise SqlError("42601", "COPY is not understood")
    columns = [c.strip().strip('"') for c in m[2].split(",")] if m[2] else []
    for c in columns:
        if not re.fullmatch(r"[A-Za-z_]\w*", c):
            raise SqlError("42601", f"column name {c!r} is not understood")
    options = m[6]
    kind = re.search(r"\b(csv|binary|text)\b", options, re.I)
    kind = kind[1].lower() if kind else "text"
    pick = lambda name, default: (x[1].replace("''", "'").replace("\\t", "\t") if (x := re.search(rf"\b{name}\b\s*(?:AS\s+)?E?'((?:[^']|'')*)'", options, re.I)) else default)
    header = re.search(r"\bHEADER\b\s*(true|false|on|off)?", options, re.I)
    path = m[5][1:-1].replace("''", "'") if m[5][0] == "'" else None
    return Copy((m[1] or "").replace('"', ""), columns, kind, pick("DELIMITER", "," if kind == "csv" else "\t"), pick("NULL", "" if kind == "csv" else "\\N"), bool(header) and (header[1] or "on").lower() in ("true", "on"), m[4].upper() == "TO", path, m[3])


#: The escapes of COPY's text format, as the format fixes them.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def unescaped(field: Column) -> Column:
    r"""\n, \t ..., \\, octal \ooo and hex \xhh of COPY text; another escaped character stands for itself."""
    pieces = F.regexp_extract_all(field, F.lit(r"(?s)\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\.|[^\\]+|\\$"), F.lit(0))

    def plain(p: Column) -> Column:
        out = F.when(p.rlike(r"^\\x[0-9A-Fa-f]"), F.chr(F.conv(F.substr(p, F.lit(3)), 16, 10).cast("bigint")))
        out = out.when(p.rlike(r"^\\[0-7]"), F.chr(F.conv(F.substr(p, F.lit(2)), 8, 10).cast("bigint")))
        for letter, meant in ESCAPES.items():
            out = out.when(p == F.lit("\\" + letter), F.lit(meant))
        return out.when(p.startswith("\\") & (F.length(p) > 1), F.substr(p, F.lit(2))).otherwise(p)

    return F.when(F.instr(field, "\\") == 0, field).otherwise(F.array_join(F.transform(pieces, plain), ""))


def read_text(spark: SparkSession, path: str, columns: list[str], delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    """COPY text: every column a string.  The line \\. ends the data and is left out; a wrong number of fields is an error."""
    lines = spark.read.text(path).where(F.col("value") != "\\.")
    fields = F.split(F.col("value"), re.escape(delimiter) if delimiter != "\t" else "\t", -1)
    # an escaped delimiter is a backslash before it: fields that end in an odd run of backslashes go on
    joined = F.aggregate(
        fields,
        F.array().cast("array<string>"),
        lambda acc, f: F.when(
            (F.size(acc) > 0) & F.element_at(F.concat(F.array(F.lit("")), acc), -1).rlike(r"(?<!\\)(\\\\)*\\$"),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(F.concat(F.array(F.lit("")), acc), -1), F.lit(delimiter), f))),
        ).otherwise(F.concat(acc, F.array(f))),
    )
    split = lines.select(joined.alias("f"))
    n = F.lit(len(columns))
    good = F.when(F.size("f") == n, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"22P04: expected {len(columns)} columns, found "), F.size("f").cast("string"))))
    return split.select(good.alias("f")).select(*[F.when(F.col("f")[i] == null, F.lit(None)).otherwise(unescaped(F.col("f")[i])).alias(c) for i, c in enumerate(columns)])


def read_csv(spark: SparkSession, path: str, columns: list[str], delimiter: str = ",", null: str = "", header: bool = False) -> DataFrame:
    """COPY CSV: every column a string; an unquoted empty field is null, a quoted one is ''; quoted fields may hold line ends."""
    reader = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("mode", "FAILFAST").option("multiLine", True)
    df = reader.option("sep", delimiter).option("quote", '"').option("escape", '"').option("header", header).option("emptyValue", EMPTY).option("nullValue", null).csv(path)
    return df.select(*[F.when(F.col(f"`{c}`") == EMPTY, F.lit("")).otherwise(F.col(f"`{c}`")).alias(c) for c in columns])


def decode_binary(data: bytes, kinds: list[str]) -> list[list]:
    """The rows of a binary COPY file; kinds are Spark type names.  A file that breaks off is an error."""
    if not data.startswith(SIGNATURE):
        raise SqlError("22P04", "no COPY signature")
    try:
        (extra,) = struct.unpack_from(">i", data, 15)
        at, rows = 19 + extra, []
        while True:
            (n,) = struct.unpack_from(">h", data, at)
            at += 2
            if n == -1:
                return rows
            if n != len(kinds):
                raise SqlError("22P04", f"expected {len(kinds)} fields, found {n}")
            row = []
            for kind in kinds:
                (size,) = struct.unpack_from(">i", data, at)
                at += 4
                if size < 0:
                    row.append(None)
                    continue
                field = data[at : at + size]
                if len(field) < size:
                    raise struct.error
                at += size
                if kind in ("smallint", "int", "bigint"):
                    row.append(int.from_bytes(field, "big", signed=True))
                elif kind in ("float", "double"):
                    row.append(struct.unpack(">f" if size == 4 else ">d", field)[0])
                elif kind == "boolean":
                    row.append(field != b"\0")
                else:
                    row.append(field.decode())
            rows.append(row)
    except struct.error:
        raise SqlError("22P04", "the binary data break off") from None


def read_binary(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    kinds = [k.lower() for k in columns.values()]
    types = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = decode_binary(content.as_py(), kinds)
                for at in range(0, len(rows), 10_000):
                    part = list(zip(*rows[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, types.get(k, pa.string())) for c, k in zip(part, kinds)], list(columns))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in columns.items()))


def escaped(field: Column) -> Column:
    out = F.replace(field, F.lit("\\"), F.lit("\\\\"))
    for letter, meant in ESCAPES.items():
        out = F.replace(out, F.lit(meant), F.lit("\\" + letter))
    return out


def write_text(df: DataFrame, path: str, null: str = "\\N", delimiter: str = "\t") -> None:
    """COPY ... TO in text format, a part file a partition."""
    own = lambda f: f if delimiter == "\t" else F.replace(f, F.lit(delimiter), F.lit("\\" + delimiter))
    fields = [F.coalesce(own(escaped(F.when(F.col(f"`{c}`"), "t").when(~F.col(f"`{c}`"), "f") if k == "boolean" else F.col(f"`{c}`").cast("string"))), F.lit(null)) for c, k in df.dtypes]
    df.select(F.concat_ws(delimiter, *fields).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str, header: bool = False, delimiter: str = ",", null: str = "") -> None:
    """COPY ... TO in CSV: null unquoted, and what would read as null, holds a delimiter, a quote or a line end, quoted; with a header a file."""
    one = lambda f: F.when(f.rlike("[\"\r\n]") | f.contains(delimiter) | (f == "") | (f == F.lit(null)), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f)
    shown = [F.when(F.col(f"`{c}`"), "t").when(~F.col(f"`{c}`"), "f") if k == "boolean" else F.col(f"`{c}`").cast("string") for c, k in df.dtypes]
    quoted = [F.coalesce(one(f), F.lit(null)) for f in shown]
    lines = df.select(F.concat_ws(delimiter, *quoted).alias("value"))
    if not header:
        lines.write.option("lineSep", "\n").text(path)
        return
    # a header a file: Spark's writer puts one, and unquoted lines stay as they are
    lines.toDF(delimiter.join(df.columns)).write.option("lineSep", "\n").option("header", True).option("sep", "\x02").option("quote", "").option("escape", "").option("emptyValue", "").csv(path)
