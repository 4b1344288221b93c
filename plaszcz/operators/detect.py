"""Detection: all recognizers over a text column, allowlist and overlaps resolved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPANS, allow, resolve
from ..sources.config import Rules
from .lexicon import address_spans, administrative_spans, person_spans
from .recognizers import registered


def raw_spans(text: Column, rules: Rules, entity_types: Sequence[str] | None = None) -> Column:
    """The spans of all recognizers, overlaps included."""
    wanted = None if entity_types is None else set(entity_types)
    parts = [r.find(text, rules) for r in registered() if wanted is None or wanted & set(r.entity_types)]
    if wanted is None or "ADDRESS" in wanted:
        parts += [address_spans(text, rules), administrative_spans(text, rules)]
    if wanted is None or "PERSON" in wanted:
        parts.append(person_spans(text, rules))
    return F.concat(*parts) if parts else F.array().cast(SPANS)


def detect(df: DataFrame, text: str = "text", rules: Rules | None = None, entity_types: Sequence[str] | None = None) -> DataFrame:
    """df with spans: resolved, allowlisted values left out, in order of start. Null and empty texts have none."""
    rules = rules or Rules()
    found = df.withColumn("_raw", raw_spans(F.coalesce(F.col(text), F.lit("")), rules, entity_types))
    return found.withColumn("spans", resolve(allow(F.col("_raw"), F.col(text), list(rules.allowlist)))).drop("_raw")
