"""CSV and JSON output of any query's result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import hadoop_path

#: Fixed value: the mark by which spreadsheets know UTF-8.
BOM = "\ufeff"


def _cell(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    return F.to_json(c) if kind.startswith(("array", "struct", "map")) else c


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files written by the tasks, each with the mark and a header; nulls are empty and quotes
    doubled. Lines end in LF, as CRLF would alter line ends inside texts. A result without rows has the header only."""
    cells = [_cell(n, t).alias(n if k else BOM + n) for k, (n, t) in enumerate(df.dtypes)]
    df.select(*cells).write.mode("overwrite").options(header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8").csv(path)


#: Names of columns that a CSV export may have at most; they are gathered to write one header.
MAX_KEYS = 16_384


def _number(c: Column) -> Column:
    """A double in the fewest digits, plain between a ten-thousandth and ten to the sixteenth, else with an exponent of
    two digits or more."""
    text, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(text.cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
    digits = F.lpad(F.abs(power.cast("int")).cast("string"), 2, "0")
    short = F.concat(F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", ""), F.when(power.startswith("-"), "e-").otherwise("e+"), F.when(F.length(power) > 2, F.abs(power.cast("int")).cast("string")).otherwise(digits))
    zero = F.when(text.startswith("-"), "-0.0").otherwise("0.0")
    named = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(named, F.when(c == 0, zero).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short))


def _quoted(c: Column) -> Column:
    """A cell's text; in quotes where it holds a comma, a quote or a line end. Null is empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(r'[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _line(cells: list[Column]) -> Column:
    line = F.concat_ws(",", *map(_quoted, cells))
    return F.when(line == "", '""').otherwise(line) if len(cells) == 1 else line


def _write_whole(rows: DataFrame, names: list[str], cells: list[Column], path: str) -> None:
    spark, none = rows.sparkSession, rows.isEmpty()
    if not none:
        rows.select(_line(cells)).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/1-rows")
    where, files = hadoop_path(spark, f"{path}/0-header.csv")
    head = "" if none else spark.range(1).select(_line([F.lit(n) for n in names])).first()[0] + "\r\n"
    out = files.create(where, True)
    out.write(bytearray((BOM + head).encode("utf-8")))
    out.close()


def write_csv_whole(df: DataFrame, path: str) -> None:
    """One CSV text in a folder: its files one after the other, by name, have one mark and one header. Lines end in
    CR and LF, line ends inside texts stay as they are, quotes stand only where needed; a result without rows is the
    mark alone."""
    cells = [_number(F.col(f"`{n}`").cast("double")) if t in ("double", "float") else _cell(n, t).cast("string") for n, t in df.dtypes]
    _write_whole(df, df.columns, cells, path)


def write_csv_rows(df: DataFrame, path: str, order: list[str], cells: str = "cells") -> None:
    """The same for rows of differing keys: ``cells`` is an array of (key, value) texts, and the header has all keys in
    the order in which the rows, by ``order``, first show them. A key twice in a row counts by its last value."""
    first = df.select(*order, F.posexplode(cells).alias("place", "c")).where("c.key is not null").groupBy("c.key").agg(F.min(F.struct(*order, "place")).alias("seen"))
    names = [r.key for r in first.orderBy("seen").limit(MAX_KEYS + 1).collect()]
    if len(names) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} columns")
    value = lambda n: F.try_element_at(F.filter(cells, lambda c: c["key"] == n), F.lit(-1))["value"]
    _write_whole(df.orderBy(*order), names, [value(n) for n in names], path)


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines; nulls are kept as members."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
