"""Text helpers as native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import let

#: White space at the ends of values, as Unicode has it.
_EDGE = r"(?U)\A\s+|\s+\z"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, _EDGE, "")


def near(text: Column, position: Column, keywords: Sequence[str], window: int) -> Column:
    """Whether a keyword stands in the window around a position, both counted from the match's start."""
    start = F.greatest(position - window, F.lit(0))
    snippet = F.lower(F.substring(text, start + 1, position + window - start))
    # a keyword that holds another one adds nothing
    words = [k.lower() for k in keywords if not any(o.lower() in k.lower() for o in keywords if o != k)]

    def seen(part: Column) -> Column:
        hit = F.lit(False)
        for k in words:
            hit = hit | F.contains(part, F.lit(k))
        return hit

    return let(snippet, seen)


def normal_value(value: Column) -> Column:
    """What markers are numbered by: the trimmed value in lower case."""
    return F.lower(strip(value))


def normal_locality(value: Column) -> Column:
    return F.upper(F.btrim(F.regexp_replace(value, r"(?U)\s+", " "), F.lit(" ,;")))


def normal_line(value: Column) -> Column:
    """No-break spaces become spaces, runs of blanks one, the ends are trimmed; upper case."""
    return F.upper(strip(F.regexp_replace(F.translate(value, " ", " "), r"[ \t]+", " ")))


def suspicious(value: Column) -> Column:
    """A value that a wrong decoding has damaged."""
    return value.rlike("[?�]")


def delimiter(first_line: Column) -> Column:
    """The delimiter of a CSV file by its first line; null for a single column."""
    return F.when(F.contains(first_line, F.lit(";")), ";").when(F.contains(first_line, F.lit("\t")), "\t").when(F.contains(first_line, F.lit(",")), ",")


def street_before(text: Column, start: Column) -> Column:
    """Whether the 50 characters before a position end in a street word."""
    begin = F.greatest(start - 50, F.lit(0))
    return F.substring(text, begin + 1, start - begin).rlike(r"(?iu)(?:ulica|ul\.)[ \t\r\n:]*\z")


def output_name(extension: Column, at: Column) -> Column:
    """Name of a redacted file: never the original one; the clock is an argument."""
    return F.concat(F.lit("anonimizacja_"), F.date_format(at, "dd-MM_HH-mm"), F.lower(extension))


def package_path(name: Column) -> Column:
    return F.regexp_replace(F.translate(name, "\\", "/"), r"\A(?:\./|/)+", "")


def is_property_part(name: Column) -> Column:
    path = package_path(name)
    return (path == "docProps") | path.startswith("docProps/")


def embedded_risk(name: Column) -> Column:
    """Whether a part may hold text that is not looked at, as sources.ooxml.embedded_risks has it."""
    return name.rlike("(?i)word/embeddings/|activeX|oleObject|/digitalSignature|vbaProject")


def cell_target(location: Column, part: Column, cell: Column) -> Column:
    """(part, cell) of a finding: given, or taken from a location at its last exclamation mark."""
    from_location = F.struct(F.regexp_extract(location, r"(?s)\A(.*)!([^!]*)\z", 1).alias("part"), F.regexp_extract(location, r"(?s)\A(.*)!([^!]*)\z", 2).alias("cell"))
    given = F.struct(part.alias("part"), cell.alias("cell"))
    return F.when(part.isNotNull() & cell.isNotNull(), given).when(F.contains(location, F.lit("!")), from_location)


def to_pdf_box(box: Sequence[Column], matrix: Sequence[Column]) -> Column:
    """Rectangle (x0, y0, x1, y1) times the inverse of the page matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = matrix
    det = a * d - b * c

    def point(x: Column, y: Column) -> tuple[Column, Column]:
        return (d * (x - e) - c * (y - f)) / det, (a * (y - f) - b * (x - e)) / det

    corners = [point(x, y) for x in (box[0], box[2]) for y in (box[1], box[3])]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))
