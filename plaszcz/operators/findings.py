"""Findings: markers, groups, ids and confirmation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.spans import each
from ..functions.text import normal_value
from ..sources.config import MARKERS


def explode_findings(detected: DataFrame, keys: Sequence[str] = ("doc_id", "unit_no"), text: str = "text") -> DataFrame:
    """One row for each span: keys, start, end, entity_type, raw_value, norm_value, score, reason."""
    s = F.col("_s")
    raw = F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])
    rows = each(detected, "spans", "_s", *keys, text)
    return rows.select(
        *keys, s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), raw.alias("raw_value"), s["score"].alias("score"), s["recognizer"].alias("reason")
    ).withColumn("norm_value", normal_value(F.col("raw_value")))


def marker_text(entity_type: Column, suffix: Column, templates: dict[str, str] | None = None) -> Column:
    templates = MARKERS if templates is None else templates
    number = suffix.cast("string")
    out = None
    for kind, template in templates.items():
        made = F.replace(F.lit(template), F.lit("{}"), number)
        out = F.when(entity_type == kind, made) if out is None else out.when(entity_type == kind, made)
    unknown = F.concat(F.lit("["), entity_type, F.lit("_"), number, F.lit("]"))
    return unknown if out is None else out.otherwise(unknown)


#: Rows for each range of ranks() that its bounds are read from.
_SAMPLED = 20


def _literal(value: object) -> Column:
    return F.struct(*[_literal(v).alias(n) for n, v in value.asDict().items()]) if isinstance(value, Row) else F.lit(value)


def ranks(rows: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """rows with rank: the place of each row, from 1, in the given order within the columns `by`.

    Rows are dealt by ranges of (by, order), so that no group needs a task of its own: a row's
    rank is its place in its range plus what the ranges before hold of its group. The bounds are
    read from the rows of least hash, so many a range, whatever the values look like.
    """
    key = F.struct(*by, *order)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(parts * _SAMPLED)
    bounds = [r.k for r in sample.orderBy("k").collect()][_SAMPLED - 1 :: _SAMPLED]
    kind = sample.schema["k"].dataType.simpleString()
    limits = F.array(*map(_literal, bounds)).cast(f"array<{kind}>")
    dealt = rows.withColumn("_range", F.size(F.filter(limits, lambda b: b < key)) if bounds else F.lit(0))
    window = Window.partitionBy("_range", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    counts = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    # a row a range and group
    before = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range")) - F.col("_n")
    starts = counts.select(F.col("_range").alias("_at"), *[F.col(c).alias(f"_{c}") for c in by], before.alias("_before"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = dealt.withColumn("_place", F.row_number().over(window)).join(starts, same)
    return joined.withColumn("rank", F.col("_before") + F.col("_place")).drop("_range", "_at", "_place", "_before", *[f"_{c}" for c in by])


def number_values(findings: DataFrame, scope: Sequence[str] = (), order: Sequence[str] = ("doc_id", "unit_no", "start")) -> DataFrame:
    """(scope, entity_type, norm_value, suffix): values numbered by first appearance within scope and type.

    Distinct values only are ranked. Without a scope a type's values could fill one task, so
    they are ranked by ranges of their first places, whatever these look like.
    """
    place = F.struct(*[F.col(c) for c in order])
    first = findings.groupBy(*scope, "entity_type", "norm_value").agg(F.min(place).alias("_first"))
    if scope:
        ranked = first.withColumn("suffix", F.row_number().over(Window.partitionBy(*scope, "entity_type").orderBy("_first", "norm_value")))
        return ranked.select(*scope, "entity_type", "norm_value", "suffix")
    ranked = ranks(first, ["_first", "norm_value"], ["entity_type"])
    return ranked.select("entity_type", "norm_value", F.col("rank").cast("int").alias("suffix"))


def assign_markers(findings: DataFrame, scope: Sequence[str] = (), order: Sequence[str] = ("doc_id", "unit_no", "start"), templates: dict[str, str] | None = None, registry: DataFrame | None = None, keep_suffix: bool = False) -> DataFrame:
    """findings with marker, and suffix if wanted. registry (scope, entity_type, norm_value, suffix) of an earlier run is continued."""
    keys = [*scope, "entity_type", "norm_value"]
    if registry is None:
        numbers = number_values(findings, scope, order)
    else:
        known = registry.select(*keys, "suffix")
        last = known.groupBy(*scope, "entity_type").agg(F.max("suffix").alias("_last"))
        more = number_values(findings.join(known, keys, "left_anti"), scope, order).join(last, [*scope, "entity_type"], "left")
        more = more.select(*keys, (F.col("suffix") + F.coalesce("_last", F.lit(0))).cast("int").alias("suffix"))
        numbers = known.unionByName(more)
    marked = findings.join(numbers, keys).withColumn("marker", marker_text(F.col("entity_type"), F.col("suffix"), templates))
    return marked if keep_suffix else marked.drop("suffix")


def group_findings(findings: DataFrame, doc: str = "doc_id", order: Sequence[str] = ("unit_no", "start"), location: Sequence[str] = ("unit_no", "start", "end")) -> DataFrame:
    """(doc, id, entity_type, raw_value, marker, reason, score, count, occurrences): one row for each type and exact value.

    Marker and reason are the first occurrence's, the score is the greatest, ids count the
    groups of a document in order of first appearance.
    """
    place = F.struct(*[F.col(c) for c in order])
    spot = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *location])])
    groups = findings.groupBy(doc, "entity_type", "raw_value").agg(
        F.min(place).alias("_first"), F.min_by("marker", place).alias("marker"), F.min_by("reason", place).alias("reason"),
        F.max("score").alias("score"), F.count("*").alias("count"), F.array_sort(F.collect_list(spot)).alias("occurrences"),
    )
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("_first", "entity_type", "raw_value"))
    return groups.withColumn("id", rank.cast("string")).select(doc, "id", "entity_type", "raw_value", "marker", "reason", "score", "count", "occurrences")


def signature_groups(signatures: DataFrame, grouped: DataFrame, doc: str = "doc_id") -> DataFrame:
    """grouped with one more group, the last, for each document that has signatures (doc, page)."""
    sizes = grouped.groupBy(doc).agg(F.count("*").alias("_n"))
    found = signatures.groupBy(doc).agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.col("page"))).alias("_pages")).join(sizes, doc, "left")
    spot = F.transform("_pages", lambda p: F.struct(p.cast("int").alias("unit_no"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    rows = found.select(
        doc, (F.coalesce("_n", F.lit(0)) + 1).cast("string").alias("id"), F.lit("PDF_SIGNATURE").alias("entity_type"), F.lit("PDF_SIGNATURE").alias("raw_value"),
        F.lit("[PODPIS]").alias("marker"), F.lit("signature").alias("reason"), F.lit(1.0).alias("score"), "count", spot.alias("occurrences"),
    )
    return grouped.unionByName(rows)


def confirm(grouped: DataFrame, confirmed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Groups whose id is among the confirmed ones (doc, id)."""
    return grouped.join(confirmed, [doc, "id"], "left_semi")


def add_boxes(findings: DataFrame, hits: DataFrame, doc: str = "doc_id") -> DataFrame:
    """findings with the first place (page, raw_value -> bbox) where their value is seen on their page."""
    first = hits.groupBy(doc, "page", "raw_value").agg(F.min_by("bbox", "hit_no").alias("bbox"))
    return findings.join(first, [doc, "page", "raw_value"], "left")
