"""Inputs of the catalogue, derived from the driver's tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The hour of an event in seconds; Spark and DuckDB name the function differently.
HOUR_SPARK = "timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', ts) * 3600"
HOUR_DUCK = "(epoch_us(ts) // 3600000000) * 3600"

#: name -> (table, select list, condition). {hour} is the event's hour.
VIEWS = {
    "snap_a": ("orders", "o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority", "o_orderkey % 19 <> 0"),
    "snap_b": ("orders", "o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority", "o_orderkey % 17 <> 0"),
    "snap_c": ("orders", "o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 7 ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority", "o_orderkey % 19 <> 0"),
    "parts_a": ("part", "p_partkey, p_name AS draft, CAST(NULL AS string) AS pub", "true"),
    "parts_b": ("part", "p_partkey, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 2 = 0 THEN NULL ELSE p_name END AS draft, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 2 = 0 THEN p_name END AS pub", "true"),
    "stamped": ("events", "event_id, user_id, event_type, value, ts, get_json_object(props, '$.k') AS element, {hour} AS w, CAST(event_id AS int) AS l, concat('node-', CAST(user_id % 5 AS string)) AS n", "true"),
    "ops": (
        "lineitem",
        "l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'replace' END AS kind, "
        "CASE WHEN l_linenumber % 2 = 1 THEN '/o_orderstatus' ELSE '/o_orderpriority' END AS path, CASE WHEN l_suppkey % 7 = 0 THEN 'O' END AS old_value, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS new_value, l_suppkey % 7 = 0 AS strict",
        "true",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, where = VIEWS[name]
    df = table(spark, sf_dir, source).where(where)
    return spark.sql(f"SELECT {columns.replace('{hour}', HOUR_SPARK)} FROM {{t}}", t=df)


def duck(*names: str) -> str:
    """WITH clause of the named views for DuckDB."""
    parts = []
    for name in names:
        source, columns, where = VIEWS[name]
        columns = columns.replace("{hour}", HOUR_DUCK).replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')").replace("AS string)", "AS varchar)")
        parts.append(f"{name} AS (SELECT {columns} FROM {source} WHERE {where})")
    return "WITH " + ", ".join(parts)


def op_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patch table: view ops with values as JSON text."""
    text = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit('"'), c, F.lit('"')))
    return view(spark, sf_dir, "ops").select("o_orderkey", F.col("seq").cast("int").alias("seq"), "kind", "path", text("old_value").alias("old"), text("new_value").alias("new"), "strict")


def keyed_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """l_orderkey and lines, a list of elements keyed by ln, before and after."""
    flat = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("partkey"), F.sum("l_quantity").cast("long").alias("qty"))
    flat = flat.select("l_orderkey", F.col("l_linenumber").cast("long").alias("ln"), "partkey", "qty")
    after = flat.where("not (ln = 2 and l_orderkey % 5 = 0)").withColumn("qty", F.expr("case when l_orderkey % 3 = 0 then qty + 1 else qty end"))
    more = flat.select("l_orderkey").distinct().where("l_orderkey % 4 = 0").selectExpr("l_orderkey", "cast(99 as bigint) ln", "cast(1 as bigint) partkey", "cast(1 as bigint) qty")
    pack = lambda df: df.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ln", "partkey", "qty"))).alias("lines"))
    return pack(flat), pack(after.unionByName(more))


KEYED_DUCK = """WITH fa AS (SELECT l_orderkey, CAST(l_linenumber AS bigint) ln, min(l_partkey) partkey, CAST(sum(l_quantity) AS bigint) qty FROM lineitem GROUP BY 1, 2),
fb AS (SELECT l_orderkey, ln, partkey, CASE WHEN l_orderkey % 3 = 0 THEN qty + 1 ELSE qty END qty FROM fa WHERE NOT (ln = 2 AND l_orderkey % 5 = 0) UNION ALL SELECT DISTINCT l_orderkey, 99, 1, 1 FROM fa WHERE l_orderkey % 4 = 0)"""


def status_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """o_custkey and its orders' statuses as a list, before and after."""
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.expr("transform(array_sort(collect_list(struct(o_orderkey, o_orderstatus))), x -> x.o_orderstatus)").alias("xs"))
    head = F.expr("case when o_custkey % 2 = 0 then transform(xs, (x, i) -> if(i = 0, 'X', x)) else xs end")
    return a, a.select("o_custkey", head.alias("xs")).withColumn("xs", F.expr("case when o_custkey % 5 = 0 then array_append(xs, 'Y') else xs end"))


LISTS_DUCK = """WITH la AS (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) xs FROM orders GROUP BY 1),
lb AS (SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN list_append(ys, 'Y') ELSE ys END xs FROM (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN ['X'] || xs[2:] ELSE xs END ys FROM la))"""


def type_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """user_id and a map of event types to counts, of two halves of the events."""
    e = table(spark, sf_dir, "events")
    pack = lambda df: df.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "count")))).alias("m"))
    return pack(e.where("event_id % 2 = 0")), pack(e.where("event_id % 3 <> 0"))


def replica(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """One replica's state by event type: entity the hour of day, path the type."""
    from ..functions.hlc import hlc
    from ..operators.crdt import apply_deltas

    rows = view(spark, sf_dir, "stamped").where(F.col("user_id") % 2 == side)
    ops = rows.select((F.col("user_id") % 10 - side).alias("entity"), F.concat(F.lit("/"), "event_type").alias("path"), F.expr("if(event_id % 6 = 0, 'remove', 'replace')").alias("kind"), F.col("event_id").cast("string").alias("new"), hlc(F.col("w"), F.col("l"), F.col("n")).alias("hlc"))
    empty = ops.where("false").selectExpr("entity", "path", "new as value", "hlc as write_hlc", "hlc as tomb_hlc")
    return apply_deltas(empty, ops, ["entity"])


#: r: of each side's paths the newest write and tombstone; an event's value is its id, which is also its logical time.
REPLICA_DUCK = duck("stamped") + """, rows AS (SELECT user_id % 2 side, user_id % 10 - user_id % 2 entity, '/' || event_type path, event_id % 6 = 0 gone, event_id, w, l, n FROM stamped),
r AS (SELECT side, entity, path, max({'w': w, 'l': l, 'n': n}) FILTER (WHERE NOT gone) wh, max({'w': w, 'l': l, 'n': n}) FILTER (WHERE gone) th FROM rows GROUP BY 1, 2, 3)"""


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows: one document per conversation, each turn hung on the one before it."""
    c = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text", "lag(named_struct('w', turn + 1, 'l', octet_length(text) - 1, 'n', role)) over (partition by conv_id order by turn) as before")
    zero = F.expr("named_struct('w', 0L, 'l', 0, 'n', '')")
    return c.select("conv_id", "turn", F.expr("named_struct('w', turn + 1, 'l', 0, 'n', role)").alias("id"), F.col("text").alias("v"), F.coalesce("before", zero).alias("p"), (F.col("turn") % 4 == 3).alias("d"))
