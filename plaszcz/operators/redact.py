"""Redaction of text: by value (every occurrence of a confirmed value) or by span."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_values(text: Column, replacements: Column) -> Column:
    """replacements: array<struct<raw, marker>>, applied one after another to all occurrences."""
    return F.aggregate(replacements, text, lambda acc, r: F.when(F.length(r["raw"]) > 0, F.replace(acc, r["raw"], r["marker"])).otherwise(acc))


def replace_spans(text: Column, spans: Column) -> Column:
    """spans: array<struct<start, end, marker>>, in order of start and without overlaps."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans, empty, lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["marker"]).alias("out"))
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def redact_by_value(units: DataFrame, confirmed: DataFrame, doc: str = "doc_id", text: str = "text", order: str = "id", trim: bool = False) -> DataFrame:
    """units with redacted: every occurrence of a confirmed (doc, raw_value, marker) becomes its marker.

    Values are applied in numeric order of `order`; a later value may hit an earlier marker,
    as replacing by value does. trim compares without white space at the values' ends.
    """
    raw = F.btrim("raw_value", F.lit(" \t\r\n ")) if trim else F.col("raw_value")
    pairs = confirmed.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("n"), raw.alias("raw"), F.col("marker")))).alias("_pairs"))
    joined = units.join(pairs, doc, "left")
    return joined.withColumn("redacted", F.when(F.col("_pairs").isNull(), F.col(text)).otherwise(replace_values(F.col(text), F.col("_pairs")))).drop("_pairs")


def redact_by_span(units: DataFrame, findings: DataFrame, keys: Sequence[str] = ("doc_id", "unit_no"), text: str = "text") -> DataFrame:
    """units with redacted: each found span becomes its marker."""
    spans = findings.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "marker"))).alias("_spans"))
    joined = units.join(spans, list(keys), "left")
    return joined.withColumn("redacted", F.when(F.col("_spans").isNull(), F.col(text)).otherwise(replace_spans(F.col(text), F.col("_spans")))).drop("_spans")


def leaks(redacted: DataFrame, confirmed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows whose redacted text still holds a confirmed value; none after a sound redaction."""
    values = confirmed.groupBy(doc).agg(F.collect_set("raw_value").alias("_values"))
    held = F.exists("_values", lambda v: (F.length(v) > 0) & F.contains(F.col("redacted"), v))
    return redacted.join(values, doc).filter(held).drop("_values")
