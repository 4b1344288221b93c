"""Detection over a stream. Detection itself keeps no state, so the batch operators run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect
from ..operators.findings import assign_markers, explode_findings
from ..sources.config import Rules


def detect_stream(units: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Findings of a streaming table of units (doc_id, unit_no, text)."""
    return explode_findings(detect(units, rules=rules))


#: Batches after which the registry's tables become one.
COMPACT_EVERY = 50


def write_with_markers(findings: DataFrame, findings_path: str, registry_path: str, checkpoint: str, templates: dict[str, str] | None = None) -> StreamingQuery:
    """Append findings with markers, batch by batch; numbers continue in a registry table.

    Each batch writes the registry's new values under its own number, so a batch that is
    run again writes the same. Every COMPACT_EVERY batches a batch writes the whole registry
    instead, from which later ones go on.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = _registry(spark, registry_path, batch_id)
        marked = assign_markers(batch, registry=seen, templates=templates, keep_suffix=True)
        kept = f"{findings_path}/batch={batch_id}"
        marked.write.mode("overwrite").parquet(kept)
        numbers = spark.read.schema(marked.schema).parquet(kept).select("entity_type", "norm_value", "suffix").distinct()
        whole = batch_id % COMPACT_EVERY == COMPACT_EVERY - 1
        fresh = numbers.unionByName(seen).distinct() if whole else numbers.join(seen, ["entity_type", "norm_value"], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{registry_path}/{'whole' if whole else 'batch'}={batch_id}")

    return findings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _registry(spark: SparkSession, path: str, before: int) -> DataFrame:
    """(entity_type, norm_value, suffix) of all batches before one: the last whole table and what came after it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = sorted((int(n.split("=")[1]), n) for n in names if n.startswith(("batch=", "whole=")))
    found = [(k, n) for k, n in found if k < before]
    last = max((k for k, n in found if n.startswith("whole=")), default=-1)
    paths = [f"{path}/{n}" for k, n in found if k > last or k == last and n.startswith("whole=")]
    schema = "entity_type string, norm_value string, suffix int"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
