"""Reading snapshots and writing results."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import supported


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A table of entities from any format that Spark reads; csv and json should be given a schema. Columns of kinds that can't be compared are left out."""
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.select(*[f"`{c}`" for c in supported(df.schema)])


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def require_key(df: DataFrame, key: list[str]) -> None:
    """Refuses null and repeated entity keys; one aggregate."""
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    bad = df.groupBy(*key).count().where((F.col("count") > 1) | null).limit(1).collect()
    if bad:
        raise ValueError(f"key {key} is null or repeated: {bad[0]}")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share; where that is unset and executors are in this process, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="changeset-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
