"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it again, so that a lost executor never
takes the only copy of a result with it.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


#: Bytes of one Arrow batch, unless the session asks for fewer: batches of long texts have few rows.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches in bytes, so that what Python and the JVM hold at once does not follow from the rows' length."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get(setting).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one (tests) gets its own, a cluster must name it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder; return the table read back and its path."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def write_file(path: str, data: bytes) -> None:
    store, at = filesystem(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as f:
        f.write(data)


def read_file(path: str) -> bytes:
    store, at = filesystem(path)
    with store.open_input_stream(at) as f:
        return f.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator on a table whose columns may have any names.

    Names that begin with an underscore are the operators' own; a table's columns of such names
    have others while the operator runs.
    """

    @wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        own = {c: f"own{i}{c}" for i, c in enumerate(df.columns) if c.startswith("_")}
        if not own:
            return operator(df, *args, **options)
        named = lambda x: own.get(x, x) if isinstance(x, str) else x
        out = operator(df.withColumnsRenamed(own), *map(named, args), **{k: named(v) for k, v in options.items()})
        return out.withColumnsRenamed({v: k for k, v in own.items()})

    return run
