"""Replica state from a stream of deltas.

Lateness has no meaning here: an old delta is dropped because its stamp isn't newer, however late it
comes, so there is no watermark (it would evict clocks that are still needed). Delivering a delta
twice changes nothing, since the second is not strictly newer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.conditions import from_predicate
from ..operators.interpret import evaluate

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest_ops(ops: DataFrame, key: list[str], stamp: str = "hlc") -> DataFrame:
    """The newest op of each path: key, path, kind, new, hlc. Streams in update mode; batch tables as well."""
    return ops.groupBy(*key, "path").agg(F.max(F.struct(F.col(stamp).alias("s"), F.col("kind"), F.col("new"))).alias("m")).select(*key, "path", F.col("m.kind").alias("kind"), F.col("m.new").alias("new"), F.col("m.s").alias(stamp))


class ReplicaProcessor(StatefulProcessor):
    """Per entity: a value and its stamp for each path; deltas in order of stamp, with conditions on the current values.

    Input rows: key, path, kind, new (JSON text), if_cond, w, l, n. Output: the paths that changed.
    """

    def __init__(self, key: str, fields: T.StructType) -> None:
        self.key, self.fields = key, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paths = handle.getMapState("paths", "path string", "new string, gone boolean, w long, l int, n string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["w", "l", "n", "path"], kind="stable")
        changed = {}
        for r in got.itertuples(index=False):
            at = (r.path,)
            if self.paths.containsKey(at):
                have = self.paths.getValue(at)
                if (int(r.w), int(r.l), r.n) <= (have[2], have[3], have[4]):
                    continue
            if isinstance(r.if_cond, str) and evaluate(from_predicate(r.if_cond), self._row(), self.fields) is not True:
                continue
            gone = r.kind == "remove"
            new = None if gone or not isinstance(r.new, str) else r.new
            self.paths.updateValue(at, (new, gone, int(r.w), int(r.l), r.n))
            changed[r.path] = (new, gone, int(r.w), int(r.l), r.n)
        rows_out = [(key[0], p, *v) for p, v in sorted(changed.items())]
        yield pd.DataFrame(rows_out, columns=[self.key, "path", "new", "gone", "w", "l", "n"])

    def _row(self) -> dict:
        out = {f.name: None for f in self.fields}
        for (path,), v in self.paths.iterator():
            if path[1:] in out and v[0] is not None:
                out[path[1:]] = json.loads(v[0])
        return out

    def close(self) -> None:
        pass


def conditional_replicas(ops: DataFrame, key: str, fields: T.StructType) -> DataFrame:
    """A stream of op rows (key, path, kind, new, if_cond, hlc) through ReplicaProcessor; needs the RocksDB state store."""
    kind = ops.schema[key].dataType.simpleString()
    flat = ops.select(key, "path", "kind", "new", "if_cond", "hlc.w", "hlc.l", "hlc.n")
    return flat.groupBy(key).transformWithStateInPandas(ReplicaProcessor(key, fields), f"{key} {kind}, path string, new string, gone boolean, w long, l int, n string", "Update", "none")


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


#: Segments of one level that are merged into one of the next.
FAN = 8


def upsert_to(path: str, key: list[str]):
    """A foreachBatch function that keeps the newest rows of all batches at path; read_state reads them.

    Each batch writes a segment of its own newest rows. FAN segments of a level are merged into one of the next, so a
    row is written again once for each level and not for each batch. Segments are named by level and batch, so a
    repeated batch writes the same ones; merged ones are deleted after their successor is complete, and reading both does no harm.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest_ops(batch, key).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{_segment(0, batch_id)}")
        level, width = 0, FAN
        while (batch_id + 1) % width == 0:
            old = [f"{path}/{_segment(level, i)}" for i in range(batch_id + 1 - width + width // FAN - 1, batch_id + 1, width // FAN)]
            here = [p for p in old if _filesystem(spark, p).exists(_hadoop_path(spark, f"{p}/_SUCCESS"))]
            if len(here) == len(old):
                rows = spark.read.schema(batch.schema).parquet(*old)
                newest_ops(rows, key).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{_segment(level + 1, batch_id)}")
            for p in here:
                _filesystem(spark, p).delete(_hadoop_path(spark, p), True)
            level, width = level + 1, width * FAN

    return write


def _segment(level: int, batch_id: int) -> str:
    return f"level{level}-batch{batch_id}"


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def read_state(spark: SparkSession, path: str, key: list[str], schema: T.StructType) -> DataFrame:
    """The newest rows of all segments that upsert_to wrote at path."""
    return newest_ops(spark.read.schema(schema).parquet(f"{path}/level*"), key).select(*schema.names)
