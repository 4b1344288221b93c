"""Dictionary building: CSV rows to values, rejections and counts.

The cores take tables of rows with a line number and are plain DataFrame operations; the
file readers in front of them detect delimiter, columns and encoding on the driver, from
the head of a file.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, suspicious

# Column names of the source files.
NAME_COLUMNS = ("name", "imie", "imię")
SURNAME_COLUMNS = ("surname", "nazwisko")
COUNT_COLUMNS = ("count", "liczba", "liczba_wystapien")
LOCALITY_COLUMNS = ("nazwa", "name", "miejscowosc", "miejscowość")
TERC_COLUMNS = ("woj", "pow", "gmi", "rodz", "nazwa")
ULIC_COLUMNS = ("nazwa_1", "nazwa_2")
ENCODINGS = ("utf-8-sig", "utf-8", "cp1250", "iso-8859-2")
REASON = "Podejrzany znak zastepczy (? lub U+FFFD)"


@dataclass(frozen=True)
class Built:
    """values: the dictionary; rejections (file_path, line_no, source_value, reason); counts (valid, empty, duplicates, rejected)."""

    values: DataFrame
    rejections: DataFrame
    counts: DataFrame


def squeeze(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"(?U)\s+", " "))


def _build(rows: DataFrame, source: Column, value: Column, extra: Sequence[Column] = (), file_path: str = "") -> Built:
    """rows (line_no, ...) -> first row of each value; damaged values are rejected before duplicates count."""
    each = rows.select("line_no", source.alias("_source"), value.alias("value"), *extra)
    names = [c for c in each.columns if c not in ("_source",)]
    state = F.when(F.coalesce(F.col("value"), F.lit("")) == "", "empty").when(suspicious(F.col("value")), "rejected").otherwise("good")
    each = each.withColumn("_state", state)
    first = each.filter("_state = 'good'").groupBy("value").agg(F.min_by(F.struct(*names), "line_no").alias("_first"))
    values = first.select("_first.*")
    rejections = each.filter("_state = 'rejected'").select(
        F.lit(file_path).alias("file_path"), F.col("line_no").cast("string").alias("line_no"), F.col("_source").alias("source_value"), F.lit(REASON).alias("reason")
    )
    counts = _counts(each, F.col("_state") == "good", F.col("value"))
    return Built(values, rejections, counts)


def _counts(rows: DataFrame, good: Column, value: Column) -> DataFrame:
    """One row: distinct good values, good rows besides these, empty and rejected rows."""
    valid = F.count_distinct(F.when(good, value))
    states = [F.count_if(F.col("_state") == s).alias(s) for s in ("empty", "rejected")]
    return rows.agg(valid.alias("valid"), F.count_if(good).alias("_good"), *states).select("valid", (F.col("_good") - F.col("valid")).alias("duplicates"), "empty", "rejected")


def build_names(rows: DataFrame, file_path: str = "") -> Built:
    """rows (line_no, value, count) -> values (line_no, value, count): trimmed, upper case, first wins, in source order by line_no.

    A count that is no whole number is 0.
    """
    upper = F.upper(strip(F.col("value")))
    count = strip(F.col("count"))
    return _build(rows, upper, upper, [F.coalesce(F.when(count.rlike(r"(?U)\A\d+\z"), count), F.lit("0")).alias("count")], file_path)


def build_localities(rows: DataFrame, file_path: str = "") -> Built:
    """rows (line_no, value) -> values (line_no, value): white space squeezed, lower case, distinct."""
    plain = squeeze(F.col("value"))
    return _build(rows, plain, F.lower(plain), (), file_path)


def build_streets(rows: DataFrame, file_path: str = "") -> Built:
    """rows (line_no, nazwa_1, nazwa_2) -> values: nazwa_2 before nazwa_1, squeezed, lower case, distinct."""
    parts = [F.nullif(strip(F.col(c)), F.lit("")) for c in ("nazwa_2", "nazwa_1")]
    street = squeeze(F.concat_ws(" ", *parts))
    return _build(rows, street, F.lower(street), (), file_path)


def build_terc(rows: DataFrame, file_path: str = "") -> Built:
    """rows (line_no, woj, pow, gmi, rodz, nazwa) -> values (level, value), distinct.

    The level follows from which codes are filled; of communes, kinds 1 to 3 count, and a
    town (kind 1) also stands with m. before its name, with and without a space.
    """
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    name = squeeze(F.col("nazwa"))
    level = (
        F.when(~blank("woj") & blank("pow") & blank("gmi"), "voivodeship")
        .when(~blank("woj") & ~blank("pow") & blank("gmi"), "county")
        .when(~blank("gmi") & strip(F.col("rodz")).isin("1", "2", "3"), "commune")
    )
    lower = F.lower(name)
    town = (level == "commune") & (strip(F.col("rodz")) == "1")
    forms = F.when(town, F.array(lower, F.concat(F.lit("m."), lower), F.concat(F.lit("m. "), lower))).otherwise(F.array(lower))
    state = F.when(F.coalesce(name, F.lit("")) == "", "empty").when(suspicious(name), "rejected").otherwise("good")
    each = rows.select("line_no", name.alias("_source"), level.alias("level"), forms.alias("_forms"), state.alias("_state"))
    values = each.filter("_state = 'good' AND level IS NOT NULL").select("level", F.explode("_forms").alias("value")).distinct()
    rejections = each.filter("_state = 'rejected'").select(
        F.lit(file_path).alias("file_path"), F.col("line_no").cast("string").alias("line_no"), F.col("_source").alias("source_value"), F.lit(REASON).alias("reason")
    )
    counts = _counts(each, (F.col("_state") == "good") & F.col("level").isNotNull(), F.struct("level", F.lower("_source")))
    return Built(values, rejections, counts)


def detect_delimiter(first_line: str) -> str | None:
    return next((d for d in (";", "\t", ",") if d in first_line), None)


def decode(raw: bytes, encodings: Sequence[str] = ENCODINGS) -> str:
    for name in encodings:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"none of {', '.join(encodings)} decodes the file")


def find_column(header: Sequence[str], candidates: Sequence[str], file_path: str) -> int:
    """Position of the only header name among the candidates."""
    at = [i for i, h in enumerate(header) if h in candidates]
    if len(at) != 1:
        raise ValueError(f"{file_path}: {len(at)} columns of {list(header)} are among {list(candidates)}, one is needed")
    return at[0]


def read_rows(spark: SparkSession, path: str | Path, wanted: dict[str, Sequence[str]], optional: Sequence[str] = (), default_delimiter: str | None = ";", encodings: Sequence[str] = ("utf-8-sig",)) -> DataFrame:
    """(line_no, one column for each key of wanted): rows of a CSV file, null where a row is too short.

    Source dictionaries are single files of a country's registers, so the driver parses them.
    Without any delimiter in the head and without a default, lines are values and the header
    is optional.
    """
    text = decode(Path(path).read_bytes(), encodings)
    head = text.split("\n", 1)[0].strip()
    delimiter = detect_delimiter(head) or default_delimiter
    schema = "line_no int, " + ", ".join(f"{c} string" for c in wanted)
    if not delimiter:
        (only,) = wanted
        lines = text.splitlines()
        skip = 1 if lines and lines[0].strip().lower() in wanted[only] else 0
        return spark.createDataFrame([(i + 1, v) for i, v in enumerate(lines) if i >= skip], schema)
    rows = list(csv.reader(text.splitlines(keepends=True), delimiter=delimiter))
    if not rows:
        raise ValueError(f"{path} is empty")
    header = [h.strip().lower() for h in rows[0]]
    at = {}
    for name, candidates in wanted.items():
        if name in optional:
            at[name] = next((i for i, h in enumerate(header) if h in candidates), -1)
        else:
            at[name] = find_column(header, candidates, str(path))
    pick = lambda row, i: row[i] if 0 <= i < len(row) else None
    return spark.createDataFrame([(n, *(pick(row, i) for i in at.values())) for n, row in enumerate(rows[1:], 2)], schema)


def read_names(spark: SparkSession, path: str | Path, surnames: bool = False) -> DataFrame:
    return read_rows(spark, path, {"value": SURNAME_COLUMNS if surnames else NAME_COLUMNS, "count": COUNT_COLUMNS}, optional=("count",))


def read_localities(spark: SparkSession, path: str | Path) -> DataFrame:
    return read_rows(spark, path, {"value": LOCALITY_COLUMNS}, default_delimiter=None)


def read_terc(spark: SparkSession, path: str | Path) -> DataFrame:
    return read_rows(spark, path, {c: (c,) for c in TERC_COLUMNS}, encodings=ENCODINGS)


def read_ulic(spark: SparkSession, path: str | Path) -> DataFrame:
    return read_rows(spark, path, {c: (c,) for c in ULIC_COLUMNS}, encodings=ENCODINGS)


def write_lines(values: DataFrame, path: str | Path) -> None:
    """Sorted values, one a line."""
    names = sorted(r[0] for r in values.select("value").collect())  # a register's names
    Path(path).write_text("".join(f"{n}\n" for n in names), encoding="utf-8")


def write_names(values: DataFrame, path: str | Path, header: str) -> None:
    """A semicolon CSV file in source order."""
    with Path(path).open("w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, delimiter=";")
        out.writerow([header, "count"])
        out.writerows((r["value"], r["count"]) for r in values.orderBy("line_no").collect())


def build_all(spark: SparkSession, sources: str | Path, target: str | Path) -> list:
    """All dictionaries of a folder of source files; the rejections, also written if there are any."""
    src, out = Path(sources), Path(target)
    out.mkdir(parents=True, exist_ok=True)
    rejected = []

    def keep(built: Built, write) -> None:
        write(built.values)
        rejected.extend(built.rejections.collect())

    for file, to, header in (("first_names_source.csv", "first_names.csv", "name"), ("surnames_source.csv", "surnames.csv", "surname")):
        keep(build_names(read_names(spark, src / file, header == "surname"), str(src / file)), lambda v, to=to, header=header: write_names(v, out / to, header))
    keep(build_localities(read_localities(spark, src / "SIMC.csv"), str(src / "SIMC.csv")), lambda v: write_lines(v, out / "localities.txt"))

    def write_levels(v: DataFrame) -> None:
        for level, to in (("voivodeship", "voivodeships.txt"), ("county", "counties.txt"), ("commune", "communes.txt")):
            write_lines(v.filter(F.col("level") == level), out / to)

    keep(build_terc(read_terc(spark, src / "TERC.csv"), str(src / "TERC.csv")), write_levels)
    keep(build_streets(read_ulic(spark, src / "ULIC.csv"), str(src / "ULIC.csv")), lambda v: write_lines(v, out / "streets.txt"))
    if rejected:
        with (out / "rejections.csv").open("w", encoding="utf-8", newline="") as f:
            w = csv.writer(f)
            w.writerow(["file_path", "line_no", "source_value", "reason"])
            w.writerows(tuple(r) for r in rejected)
    return rejected
