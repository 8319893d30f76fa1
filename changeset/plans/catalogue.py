"""The query catalogue: every operator applied to the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canon, hlc
from ..functions import conditions as C
from ..functions import schema as S
from ..functions.paths import resolve
from ..operators import apply, crdt, diff, edit_script, merge, moves, ops, text
from ..sources import codec, snapshots
from ..streaming import deltas
from .fixtures import KEYED_DUCK, LISTS_DUCK, REPLICA_DUCK, duck, keyed_lists, op_rows, replica, status_lists, table, text_runs, type_counts, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


KEY = ["o_orderkey"]
OPS = ["o_orderkey", "CAST(seq AS bigint) seq", "kind", "path", "old", "new"]


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "snap_a"), view(spark, d, "snap_b")


def _json(x: str, quote: bool = True) -> str:
    return f"""'"' || {x} || '"'""" if quote else f"CAST({x} AS varchar)"


def _row(t: str) -> str:
    return f"""'{{"o_custkey":' || {t}.o_custkey || ',"o_orderstatus":"' || {t}.o_orderstatus || '","o_orderpriority":' || coalesce('"' || {t}.o_orderpriority || '"', 'null') || '}}'"""


def _diff_duck(a: str, b: str, name: str, custkey: bool = True, whole: bool = True) -> str:
    """CTE `name`: the op rows of two snapshot views; leaf gives the order within an entity."""
    leaves = [("o_custkey", False)] * custkey + [("o_orderstatus", True), ("o_orderpriority", True)]
    both = f"{a} a JOIN {b} b USING (o_orderkey)"
    kind = lambda c: f"CASE WHEN a.{c} IS NULL THEN 'add' WHEN b.{c} IS NULL THEN 'remove' ELSE 'replace' END"
    parts = [f"SELECT o_orderkey, {i} leaf, {kind(c)} kind, '/{c}' path, {_json('a.' + c, q)} old, {_json('b.' + c, q)} AS new FROM {both} WHERE a.{c} IS DISTINCT FROM b.{c}" for i, (c, q) in enumerate(leaves)]
    if whole:
        parts.append(f"SELECT b.o_orderkey, 0, 'add', '/', NULL, {_row('b')} FROM {b} b ANTI JOIN {a} a USING (o_orderkey)")
        parts.append(f"SELECT a.o_orderkey, 0, 'remove', '/', {_row('a')}, NULL FROM {a} a ANTI JOIN {b} b USING (o_orderkey)")
    return f"{name} AS (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY leaf) - 1 AS bigint) seq, kind, path, old, new FROM ({' UNION ALL '.join(parts)}))"


SNAPS = duck("snap_a", "snap_b")
D1 = f"{SNAPS}, {_diff_duck('snap_a', 'snap_b', 'd')}"


# --- diff


@query(f"{D1} SELECT * FROM d")
def diff_orders(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff(*_snapshots(spark, d), KEY).selectExpr(*OPS)


@query(
    f"""{SNAPS} SELECT coalesce(a.o_orderkey, b.o_orderkey) o_orderkey, CASE WHEN a.o_orderstatus IS NULL THEN 'add' WHEN b.o_orderstatus IS NULL THEN 'remove' ELSE 'replace' END kind,
    '"' || a.o_orderstatus || '"' old, '"' || b.o_orderstatus || '"' AS new FROM snap_a a FULL JOIN snap_b b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus"""
)
def diff_orders_status_leaves(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff(*_snapshots(spark, d), KEY, ignore=["/o_custkey", "/o_orderpriority"], rows="leaves").select("o_orderkey", "kind", "old", "new")


@query(f"{D1} SELECT o_orderkey, kind, old, new FROM d WHERE path = '/o_orderpriority' AND kind <> 'replace'")
def diff_orders_null_transitions(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff(*_snapshots(spark, d), KEY).where("path = '/o_orderpriority' and kind <> 'replace'").select("o_orderkey", "kind", "old", "new")


@query(f"{SNAPS}, {_diff_duck('snap_a', 'snap_b', 'd', custkey=False, whole=False)} SELECT * FROM d")
def diff_orders_ignore_path(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff(*_snapshots(spark, d), KEY, ignore=["/o_custkey"]).where("path <> '/'").selectExpr(*OPS)


@query("""WITH c AS (SELECT c_custkey, c_nationkey n, c_mktsegment s, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END n2, CASE WHEN c_custkey % 6 = 0 THEN 'X' ELSE c_mktsegment END s2 FROM customer)
SELECT c_custkey, 'replace' kind, '/home' path, '{"nation":' || n || ',"segment":"' || s || '"}' old, '{"nation":' || n2 || ',"segment":"' || s2 || '"}' AS new FROM c WHERE n <> n2 OR s <> s2""")
def diff_customer_atomic(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("home"))
    b = a.select("c_custkey", F.expr("named_struct('nation', if(c_custkey % 4 = 0, home.nation + 1, home.nation), 'segment', if(c_custkey % 6 = 0, 'X', home.segment))").alias("home"))
    return diff.diff(a, b, ["c_custkey"], schema=S.with_tags(a.schema, {"home": [S.ATOMIC]})).select("c_custkey", "kind", "path", "old", "new")


@query("""WITH ma AS (SELECT user_id, event_type, count(*) c FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), mb AS (SELECT user_id, event_type, count(*) c FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2),
ua AS (SELECT DISTINCT user_id FROM ma), ub AS (SELECT DISTINCT user_id FROM mb)
SELECT user_id, CASE WHEN ma.c IS NULL THEN 'add' WHEN mb.c IS NULL THEN 'remove' ELSE 'replace' END kind, '/m/' || event_type path, CAST(ma.c AS varchar) old, CAST(mb.c AS varchar) AS new
FROM ma FULL JOIN mb USING (user_id, event_type) WHERE ma.c IS DISTINCT FROM mb.c AND user_id IN (SELECT user_id FROM ua) AND user_id IN (SELECT user_id FROM ub)""")
def diff_map_props(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff(*type_counts(spark, d), ["user_id"]).where("path <> '/'").select("user_id", "kind", "path", "old", "new")


KEYED = f"""{KEYED_DUCK}, el AS (SELECT l_orderkey, ln, fa.partkey pa, fb.partkey pb, fa.qty qa, fb.qty qb FROM fa FULL JOIN fb USING (l_orderkey, ln))
SELECT l_orderkey, 'add' kind, '/lines/' || ln path, NULL old, '{{"ln":' || ln || ',"partkey":' || pb || ',"qty":' || qb || '}}' AS new FROM el WHERE qa IS NULL
UNION ALL SELECT l_orderkey, 'remove', '/lines/' || ln, '{{"ln":' || ln || ',"partkey":' || pa || ',"qty":' || qa || '}}', NULL FROM el WHERE qb IS NULL
UNION ALL SELECT l_orderkey, 'replace', '/lines/' || ln || '/qty', CAST(qa AS varchar), CAST(qb AS varchar) FROM el WHERE qa <> qb"""


@query(KEYED)
def diff_keyed_lineitem(spark: SparkSession, d: str) -> DataFrame:
    a, b = keyed_lists(spark, d)
    return diff.diff_keyed_list(a, b, ["l_orderkey"], "lines", "ln").select("l_orderkey", "kind", "path", "old", "new")


@query(f"SELECT * FROM ({KEYED}) WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1 OR min(l_linenumber) <> 2 OR l_orderkey % 5 <> 0 OR l_orderkey % 4 = 0)")
def diff_keyed_expression(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from the expression form, where lists stay whole; orders that lose their only line are left to the row level."""
    from pyspark.sql import types as T

    a, b = keyed_lists(spark, d)
    element = T.StructType([T.StructField("ln", T.LongType(), metadata={S.KEY: True}), T.StructField("partkey", T.LongType()), T.StructField("qty", T.LongType())])
    return diff.diff(a, b, ["l_orderkey"], schema=T.StructType([a.schema["l_orderkey"], T.StructField("lines", T.ArrayType(element))])).where("path <> '/'").select("l_orderkey", "kind", "path", "old", "new")


@query(f"{KEYED_DUCK} SELECT l_orderkey, ln, 'add' kind FROM fb ANTI JOIN fa USING (l_orderkey, ln) UNION ALL SELECT l_orderkey, ln, 'remove' FROM fa ANTI JOIN fb USING (l_orderkey, ln)")
def membership_diff_lineitem(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("l_orderkey", F.explode("lines.ln").alias("ln")) for x in keyed_lists(spark, d))
    return diff.membership_diff(a, b, ["l_orderkey", "ln"])


LIST_JSON = """'["' || array_to_string({}, '","') || '"]'"""


@query(f"""{LISTS_DUCK}, pairs AS (SELECT o_custkey, la.xs a, lb.xs b FROM la JOIN lb USING (o_custkey))
SELECT o_custkey, 'replace' kind, '/xs' path, {LIST_JSON.format('a')} old, {LIST_JSON.format('b')} AS new FROM pairs WHERE len(a) <> len(b)
UNION ALL SELECT o_custkey, 'replace', '/xs/' || (i - 1), '"' || a[i] || '"', '"' || b[i] || '"' FROM (SELECT o_custkey, a, b, unnest(range(1, len(a) + 1)) i FROM pairs WHERE len(a) = len(b)) WHERE a[i] <> b[i]""")
def diff_list_positional(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff(*status_lists(spark, d), ["o_custkey"]).select("o_custkey", "kind", "path", "old", "new")


@query("""WITH v AS (SELECT vec_id, [CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END for i in [1, 2, 3]] a, [CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END for i in [2, 3, 4]] b FROM embeddings)
SELECT vec_id, 'replace' kind, '/signs/' || (i - 1) path, CAST(a[i] AS varchar) old, CAST(b[i] AS varchar) AS new FROM (SELECT *, unnest([1, 2, 3]) i FROM v) WHERE a[i] <> b[i]""")
def diff_fixed_array(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    signs = lambda at: F.transform(F.slice("embedding", at, 3), lambda x: F.when(x > 0, 1).otherwise(0)).alias("signs")
    return diff.diff(v.select("vec_id", signs(1)), v.select("vec_id", signs(2)), ["vec_id"]).select("vec_id", "kind", "path", "old", "new")


@query("""SELECT c_custkey, '/c_acctbal' path, CASE WHEN c_custkey % 3 = 0 THEN 'up' ELSE 'down' END new FROM customer WHERE c_custkey % 3 <> 2""")
def diff_custom_rule(spark: SparkSession, d: str) -> DataFrame:
    """A registered rule for one path: it reports the direction in place of the values."""
    a = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    b = a.withColumn("c_acctbal", F.expr("case c_custkey % 3 when 0 then c_acctbal + 10 when 1 then c_acctbal - 10 else c_acctbal end"))

    def direction(x, y, path):
        op = F.array(F.struct(F.lit("replace").alias("kind"), path.alias("path"), F.lit(None).cast("string").alias("from_path"), F.lit(None).cast("string").alias("old"), F.when(y > x, "up").otherwise("down").alias("new")))
        return F.when(x == y, F.array().cast(f"array<{diff.OP}>")).otherwise(op)

    return diff.diff(a, b, ["c_custkey"], custom={"/c_acctbal": direction}).select("c_custkey", "path", "new")


@query(f"""{duck('parts_a', 'parts_b')} SELECT p_partkey, CASE WHEN b.draft IS NULL THEN 'move' ELSE 'copy' END kind, '/draft' from_path, '/pub' path, '"' || b.pub || '"' AS value FROM parts_a a JOIN parts_b b USING (p_partkey) WHERE b.pub IS NOT NULL""")
def detect_moves(spark: SparkSession, d: str) -> DataFrame:
    return moves.detect_moves(view(spark, d, "parts_a"), view(spark, d, "parts_b"), ["p_partkey"])


# --- equality and clones


@query(f"{SNAPS} SELECT coalesce(a.o_orderkey, b.o_orderkey) o_orderkey, CAST(a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AS int) equal FROM snap_a a FULL JOIN snap_b b ON a.o_orderkey = b.o_orderkey")
def equal_rows(spark: SparkSession, d: str) -> DataFrame:
    return canon.row_equal(*_snapshots(spark, d), KEY)


@query(f"{SNAPS} SELECT coalesce(a.o_orderkey, b.o_orderkey) o_orderkey, CAST(a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL AND a.o_custkey = b.o_custkey AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AS int) equal FROM snap_a a FULL JOIN snap_b b ON a.o_orderkey = b.o_orderkey")
def equal_ignore(spark: SparkSession, d: str) -> DataFrame:
    return canon.row_equal(*_snapshots(spark, d), KEY, ignore={"/o_orderstatus"})


@query(f"{SNAPS} SELECT a.o_orderkey, CAST(a.o_custkey // 10 = b.o_custkey // 10 AND a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority AS int) equal FROM snap_a a JOIN snap_b b ON a.o_orderkey = b.o_orderkey")
def equal_custom_rule(spark: SparkSession, d: str) -> DataFrame:
    a, b = _snapshots(spark, d)
    both = canon.row_equal(a, b, KEY, rules={"/o_custkey": lambda x, y: F.floor(x / 10) == F.floor(y / 10)})
    return both.join(a, KEY, "left_semi").join(b, KEY, "left_semi")


@query("SELECT c_custkey, CAST(NULL AS varchar) c_name, CAST(NULL AS int) nation, lower(c_mktsegment) segment FROM customer")
def clone_masked(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("home"))
    return canon.clone(c, ignore={"/c_name", "/home/nation"}, rewrite={"/home/segment": F.lower}).select("c_custkey", "c_name", "home.nation", "home.segment")


# --- apply


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def _applied(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", F.coalesce(apply.report(F.col("errors")), F.lit(""))).drop("log")


@query("SELECT o_orderkey, CAST(42 AS bigint) o_custkey, 'Z' o_orderstatus, CAST(NULL AS varchar) o_orderpriority, 'ok' status, '' errors FROM orders")
def apply_static_orders(spark: SparkSession, d: str) -> DataFrame:
    return _applied(apply.apply_static(_orders(spark, d), ops.Patch((ops.set_("/o_orderstatus", "Z"), ops.add("/o_custkey", 42), ops.remove("/o_orderpriority")))))


@query("SELECT o_orderkey, o_custkey, CAST(NULL AS varchar) o_orderstatus, o_orderstatus o_orderpriority, 'ok' status, '' errors FROM orders")
def apply_move_copy(spark: SparkSession, d: str) -> DataFrame:
    return _applied(apply.apply_static(_orders(spark, d), ops.Patch((ops.copy("/o_orderstatus", "/o_orderpriority"), ops.move("/o_orderpriority", "/o_orderstatus"), ops.move("/o_orderstatus", "/o_orderpriority")))))


@query("SELECT o_orderkey, o_orderpriority o_orderstatus, o_orderstatus o_orderpriority FROM orders")
def apply_swap_simultaneous(spark: SparkSession, d: str) -> DataFrame:
    patch = ops.Patch((ops.copy("/o_orderpriority", "/o_orderstatus"), ops.copy("/o_orderstatus", "/o_orderpriority")))
    return apply.apply_static(_orders(spark, d), patch, mode="simultaneous").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""WITH s1 AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END s FROM orders)
SELECT o_orderkey, s o_orderstatus, CASE WHEN s = 'open' THEN 'late' WHEN o_custkey >= 500 THEN 'few' ELSE o_orderpriority END o_orderpriority, 'ok' status, '' errors FROM s1""")
def apply_conditional(spark: SparkSession, d: str) -> DataFrame:
    """Later operations see what earlier ones left."""
    patch = ops.Patch((
        ops.set_("/o_orderstatus", "open").when(C.eq("/o_orderstatus", "O")),
        ops.set_("/o_orderpriority", "few").except_when(C.lt("/o_custkey", 500)),
        ops.set_("/o_orderpriority", "late").when(C.and_(C.matches("/o_orderstatus", "^op"), C.exists("/o_custkey"))),
    ))
    return _applied(apply.apply_static(_orders(spark, d), patch)).drop("o_custkey")


@query(f"""{duck('snap_a')}, told AS (SELECT *, coalesce((o_orderpriority = '1-URGENT' AND o_custkey > 100) OR regexp_matches(o_orderpriority, '^[45]'), false) ok FROM snap_a)
SELECT o_orderkey, CASE WHEN ok THEN 'seen' ELSE o_orderstatus END o_orderstatus, CASE WHEN ok THEN 'ok' ELSE 'guard_failed' END status FROM told""")
def apply_guard_policy(spark: SparkSession, d: str) -> DataFrame:
    """Or counts what can't be told as false, so a null priority fails the guard rather than breaking it."""
    guard = C.or_(C.and_(C.eq("/o_orderpriority", "1-URGENT"), C.gt("/o_custkey", 100)), C.matches("/o_orderpriority", "^[45]"))
    return apply.apply_static(view(spark, d, "snap_a"), ops.Patch((ops.set_("/o_orderstatus", "seen"),), guard)).select("o_orderkey", "o_orderstatus", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 OR left(o_orderpriority, 1) <> '2' THEN o_orderstatus ELSE 'G' END o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN 'guard_error' WHEN left(o_orderpriority, 1) <> '2' THEN 'guard_failed' ELSE 'ok' END status FROM orders WHERE o_orderkey % 19 <> 0")
def apply_guard_error(spark: SparkSession, d: str) -> DataFrame:
    return apply.apply_static(view(spark, d, "snap_a"), ops.Patch((ops.set_("/o_orderstatus", "G"),), C.matches("/o_orderpriority", "^2"))).select("o_orderkey", "o_orderstatus", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 'ok' ELSE 'error' END status, CASE WHEN o_orderstatus = 'O' THEN '' ELSE '/o_orderstatus: strict check failed' END errors FROM orders")
def apply_strict(spark: SparkSession, d: str) -> DataFrame:
    return _applied(apply.apply_static(_orders(spark, d), ops.Patch((ops.set_("/o_orderstatus", "P", old="O"),)).as_strict())).drop("o_custkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey, 'done' o_orderstatus, o_orderpriority, 'error' status, '2 errors:\n- /o_custkey: field is read-only\n- /o_orderstatus: field is read-only' errors FROM orders")
def apply_readonly_errors(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    patch = ops.Patch((ops.set_("/o_custkey", 1), ops.set_("/o_orderstatus", "done"), ops.set_("/o_orderpriority", "x"), ops.move("/o_custkey", "/o_orderstatus")))
    return _applied(apply.apply_static(df, patch, schema=S.with_tags(df.schema, {"o_custkey": [S.READONLY], "o_orderpriority": [S.IGNORE]})))


@query("SELECT o_orderkey, 'final order' AS line FROM orders WHERE o_orderstatus = 'F'")
def apply_log(spark: SparkSession, d: str) -> DataFrame:
    patch = ops.Patch((ops.log("final order").when(C.eq("/o_orderstatus", "F")),))
    return apply.apply_static(_orders(spark, d), patch).select("o_orderkey", F.explode("log").alias("line"))


@query("""WITH m AS (SELECT user_id, event_type, count(*) c FROM events GROUP BY 1, 2), u AS (SELECT user_id, max(CASE WHEN event_type = 'view' THEN c END) v, max(CASE WHEN event_type = 'click' THEN c END) k, max(CASE WHEN event_type = 'purchase' THEN c END) p FROM m GROUP BY 1)
SELECT user_id, CAST(NULL AS bigint) view, CAST(7 AS bigint) click, CAST(-1 AS bigint) seen, p purchase, v moved FROM u""")
def apply_nested_map(spark: SparkSession, d: str) -> DataFrame:
    """Setting, adding, removing and moving at map keys."""
    m = table(spark, d, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    patch = ops.Patch((ops.set_("/m/click", 7), ops.add("/m/a~1b", -1), ops.move("/m/view", "/m/moved")))
    out = apply.apply_static(m, patch)
    get = lambda k: F.try_element_at("m", F.lit(k))
    return out.select("user_id", get("view").alias("view"), get("click").alias("click"), get("a/b").alias("seen"), get("purchase").alias("purchase"), get("moved").alias("moved"))


PATCHED = """ops AS (SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus END v, l_linenumber % 2 = 1 st, l_suppkey % 7 = 0 strict FROM lineitem)"""


@query(f"""WITH {PATCHED}, last AS (SELECT o_orderkey, arg_max_null(v, seq) FILTER (WHERE st) s, count(*) FILTER (WHERE st) ns, arg_max_null(v, seq) FILTER (WHERE NOT st) p, count(*) FILTER (WHERE NOT st) np FROM ops GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN ns > 0 THEN s ELSE o_orderstatus END o_orderstatus, CASE WHEN np > 0 THEN p ELSE o_orderpriority END o_orderpriority, 'ok' status FROM orders o LEFT JOIN last USING (o_orderkey)""")
def apply_patch_table(spark: SparkSession, d: str) -> DataFrame:
    """Every order's own operations, the last at a path counts."""
    return apply.apply_writes(_orders(spark, d).drop("o_custkey"), op_rows(spark, d).withColumn("strict", F.lit(False)), KEY).drop("errors")


@query(f"""WITH RECURSIVE {PATCHED}, f AS (SELECT o_orderkey, 0 seq, o_orderstatus s, o_orderpriority p, 0 bad FROM orders
UNION ALL SELECT f.o_orderkey, o.seq, CASE WHEN o.st AND NOT (o.strict AND f.s IS DISTINCT FROM 'O') THEN o.v ELSE f.s END, CASE WHEN NOT o.st AND NOT (o.strict AND f.p IS DISTINCT FROM 'O') THEN o.v ELSE f.p END,
f.bad + CASE WHEN o.strict AND (CASE WHEN o.st THEN f.s ELSE f.p END) IS DISTINCT FROM 'O' THEN 1 ELSE 0 END FROM f JOIN ops o ON o.o_orderkey = f.o_orderkey AND o.seq = f.seq + 1)
SELECT o_orderkey, arg_max_null(s, seq) o_orderstatus, arg_max_null(p, seq) o_orderpriority, CAST(max(bad) AS bigint) n_errors FROM f GROUP BY 1""")
def apply_patch_table_strict(spark: SparkSession, d: str) -> DataFrame:
    """The fold where strict operations depend on what earlier ones left."""
    return apply.apply_table(_orders(spark, d).drop("o_custkey"), op_rows(spark, d), KEY).select("o_orderkey", "o_orderstatus", "o_orderpriority", F.size("errors").cast("long").alias("n_errors"))


@query(f"""WITH {PATCHED}, last AS (SELECT o_orderkey, arg_max_null(v, seq) FILTER (WHERE st) s, count(*) FILTER (WHERE st) ns FROM ops WHERE st GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN ns > 0 AND o_custkey >= 300 THEN s ELSE o_orderstatus END o_orderstatus FROM orders o LEFT JOIN last USING (o_orderkey)""")
def apply_patch_table_conditional(spark: SparkSession, d: str) -> DataFrame:
    """Operations with conditions, run by the interpreter."""
    rows = op_rows(spark, d).where("path = '/o_orderstatus'").withColumn("strict", F.lit(False)).withColumn("if_cond", F.lit(C.ge("/o_custkey", 300).to_json()))
    return apply.apply_table_general(_orders(spark, d), rows, KEY).select("o_orderkey", "o_orderstatus")


# --- conditions


def _where(spark: SparkSession, d: str, cond: C.Condition) -> DataFrame:
    df = view(spark, d, "snap_a")
    state = apply.State(df.schema)
    return df.select("o_orderkey", F.coalesce(C.compile_condition(cond, state.find).cast("int"), F.lit(-1)).alias("told"))


def _told(sql: str) -> str:
    return f"{duck('snap_a')} SELECT o_orderkey, coalesce(CAST(({sql}) AS int), -1) told FROM snap_a"


@query(_told("o_custkey > 100.5 AND o_custkey <= 700 AND o_orderstatus <> 'P' AND o_orderstatus >= 'F' AND NOT o_custkey = 333"))
def cond_compare(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, C.and_(C.gt("/o_custkey", 100.5), C.le("/o_custkey", 700), C.ne("/o_orderstatus", "P"), C.ge("/o_orderstatus", "F"), C.not_(C.eq("/o_custkey", 333))))


@query(_told("o_orderpriority IN ('1-URGENT', '5-LOW')"))
def cond_in(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, C.in_("/o_orderpriority", ["1-URGENT", "5-LOW", 7]))


@query(_told("o_orderpriority IS NOT NULL"))
def cond_exists(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, C.and_(C.exists("/o_orderpriority"), C.not_(C.exists("/nowhere"))))


@query(_told("regexp_matches(o_orderpriority, '[HL][IO][GW]')"))
def cond_matches(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, C.matches("/o_orderpriority", "[HL][IO][GW]"))


@query(_told("o_orderpriority IS NULL"))
def cond_type(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, C.and_(C.type_is("/o_orderpriority", "null"), C.type_is("/o_custkey", "number"), C.type_is("/o_orderstatus", "string")))


@query(_told("CASE WHEN o_custkey < 400 THEN coalesce(o_orderpriority > '3', false) OR o_orderstatus = 'F' ELSE CASE WHEN o_orderpriority IS NULL THEN NULL ELSE NOT (o_orderpriority = '2-HIGH') END END"))
def cond_logic(spark: SparkSession, d: str) -> DataFrame:
    """and stops at the first false or untold part, or counts the untold as false, not hands it on."""
    few = C.and_(C.lt("/o_custkey", 400), C.or_(C.gt("/o_orderpriority", "3"), C.eq("/o_orderstatus", "F")))
    many = C.and_(C.ge("/o_custkey", 400), C.not_(C.eq("/o_orderpriority", "2-HIGH")))
    df = view(spark, d, "snap_a")
    find = apply.State(df.schema).find
    told = F.when(F.col("o_custkey") < 400, C.compile_condition(few, find)).otherwise(C.compile_condition(many, find))
    return df.select("o_orderkey", F.coalesce(told.cast("int"), F.lit(-1)).alias("told"))


@query("""WITH m AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') p, count(*) FILTER (WHERE event_type = 'error') e FROM events GROUP BY 1)
SELECT user_id, CAST(p > 12 AS int) many, CAST(e = 0 OR e <> 10 AS int) other, CAST(e > 0 AS int) has FROM m""")
def cond_map_keys(spark: SparkSession, d: str) -> DataFrame:
    """Absent map keys: orderings are false, != is true."""
    m = table(spark, d, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    find = apply.State(m.schema).find
    told = lambda c: C.compile_condition(c, find).cast("int")
    return m.select("user_id", told(C.gt("/m/purchase", 12)).alias("many"), told(C.ne("/m/error", 10)).alias("other"), told(C.exists("/m/error")).alias("has"))


# --- paths


@query("SELECT o_custkey, xs[2] AS snd, CAST(len(xs) > 10 AS int) eleventh FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) xs FROM orders GROUP BY 1)")
def path_resolve(spark: SparkSession, d: str) -> DataFrame:
    a, _ = status_lists(spark, d)
    at = lambda i: resolve(F.col("xs"), a.schema["xs"].dataType, (str(i),))
    return a.select("o_custkey", at(1).value.alias("snd"), at(10).present.cast("int").alias("eleventh"))


@query("""WITH l AS (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) xs FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(CASE WHEN len(xs) > 2 THEN ['first'] || xs[2:2] || xs[4:] ELSE ['first'] || xs[2:] END, ',') xs, CASE WHEN len(xs) > 2 THEN '' ELSE '/xs/2: out of range' END errors FROM l""")
def path_list_edit(spark: SparkSession, d: str) -> DataFrame:
    """An index in range is overwritten; removal moves the rest up or is an error."""
    a, _ = status_lists(spark, d)
    return apply.apply_static(a, ops.Patch((ops.set_("/xs/0", "first"), ops.remove("/xs/2")))).select("o_custkey", F.array_join("xs", ",").alias("xs"), F.coalesce(apply.report(F.col("errors")), F.lit("")).alias("errors"))


# --- patch algebra


@query(f"{D1} SELECT o_orderkey, CAST(max(seq) OVER (PARTITION BY o_orderkey) - seq AS bigint) seq, CASE kind WHEN 'add' THEN 'remove' WHEN 'remove' THEN 'add' ELSE kind END kind, path, new AS old, old AS new FROM d")
def patch_reverse(spark: SparkSession, d: str) -> DataFrame:
    return ops.reverse_table(diff.diff(*_snapshots(spark, d), KEY), KEY).selectExpr(*OPS)


D3 = f"{duck('snap_a', 'snap_b', 'snap_c')}, {_diff_duck('snap_a', 'snap_b', 'd')}, {_diff_duck('snap_a', 'snap_c', 'e')}"


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, b = _snapshots(spark, d)
    return diff.diff(a, b, KEY), diff.diff(a, view(spark, d, "snap_c"), KEY)


@query(f"{D3} SELECT coalesce(d.o_orderkey, e.o_orderkey) o_orderkey, CAST(row_number() OVER (PARTITION BY coalesce(d.o_orderkey, e.o_orderkey) ORDER BY coalesce(d.path, e.path)) - 1 AS bigint) seq, coalesce(e.kind, d.kind) kind, coalesce(d.path, e.path) path, CASE WHEN e.path IS NOT NULL THEN e.old ELSE d.old END old, CASE WHEN e.path IS NOT NULL THEN e.new ELSE d.new END AS new FROM d FULL JOIN e ON d.o_orderkey = e.o_orderkey AND d.path = e.path")
def patch_merge_other_wins(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_tables(*_both(spark, d), KEY).selectExpr(*OPS)


@query(f"{D3} SELECT o_orderkey, path, CASE WHEN path = '/o_custkey' THEN CAST(greatest(CAST(d.new AS bigint), CAST(e.new AS bigint)) AS varchar) ELSE greatest(d.new, e.new) END AS new FROM d JOIN e USING (o_orderkey, path)")
def patch_merge_resolver(spark: SparkSession, d: str) -> DataFrame:
    x, y = _both(spark, d)
    return merge.merge_tables(x, y, KEY, merge.largest).join(x, [*KEY, "path"], "left_semi").join(y, [*KEY, "path"], "left_semi").select("o_orderkey", "path", "new")


def _merged(c: str) -> str:
    return f"CASE WHEN a.o_orderkey IS NULL AND c.o_orderkey IS NULL OR a.o_orderkey IS NOT NULL AND c.{c} IS NOT DISTINCT FROM a.{c} THEN b.{c} ELSE c.{c} END {c}"


@query(f"""{duck('snap_a', 'snap_b', 'snap_c')} SELECT o_orderkey, {', '.join(map(_merged, ('o_custkey', 'o_orderstatus', 'o_orderpriority')))} FROM snap_a a FULL JOIN snap_b b USING (o_orderkey) FULL JOIN snap_c c USING (o_orderkey)
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NOT NULL AND c.o_orderkey IS NOT NULL""")
def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = _snapshots(spark, d)
    return merge.three_way(a, b, view(spark, d, "snap_c"), KEY).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


LINE = "CASE kind WHEN 'add' THEN 'Add ' || path || ': ' || new WHEN 'remove' THEN 'Remove ' || path || ' (was ' || old || ')' ELSE 'Replace ' || path || ': ' || old || ' -> ' || new END"
SUMMARY = "CASE kind WHEN 'add' THEN 'Added ' || path || ': ' || new WHEN 'remove' THEN 'Removed ' || path || ' (was ' || old || ')' ELSE 'Updated ' || path || ' from ' || old || ' to ' || new END"


@query(f"{D1} SELECT o_orderkey, string_agg({LINE}, '\n' ORDER BY seq) AS text FROM d GROUP BY 1")
def patch_render(spark: SparkSession, d: str) -> DataFrame:
    return ops.render_table(diff.diff(*_snapshots(spark, d), KEY), KEY)


@query(f"{D1} SELECT o_orderkey, string_agg({SUMMARY}, '\n' ORDER BY seq) AS text FROM d GROUP BY 1")
def patch_summary(spark: SparkSession, d: str) -> DataFrame:
    return ops.render_table(diff.diff(*_snapshots(spark, d), KEY), KEY, "summary")


@query(f"{SNAPS} SELECT * FROM snap_b")
def roundtrip_apply_diff(spark: SparkSession, d: str) -> DataFrame:
    """apply(a, diff(a, b)) is b."""
    a, b = _snapshots(spark, d)
    return apply.apply_writes(a, diff.diff(a, b, KEY), KEY).select(*b.columns)


@query(f"{SNAPS} SELECT * FROM snap_a")
def undo_redo(spark: SparkSession, d: str) -> DataFrame:
    """apply(b, reverse(diff(a, b))) is a."""
    a, b = _snapshots(spark, d)
    return merge.undo(b, diff.diff(a, b, KEY).withColumn("version", F.lit(1)), KEY, "version").select(*a.columns)


# --- wire formats


@query(f"{D1} SELECT o_orderkey, seq, kind, path, CASE WHEN kind = 'remove' THEN NULL ELSE new END AS new FROM d")
def jsonpatch_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    texts = codec.table_to_json_patch(diff.diff(*_snapshots(spark, d), KEY), KEY)
    return codec.json_patch_to_table(texts, KEY).selectExpr("o_orderkey", "CAST(seq AS bigint) seq", "kind", "path", "new")


@query(f"""{D1} SELECT o_orderkey, '[' || string_agg('{{"op":"' || kind || '","path":"' || path || '"' || CASE WHEN kind = 'remove' THEN '' ELSE ',"value":' || new END || '}}', ',' ORDER BY seq) || ']' AS patch FROM d GROUP BY 1""")
def jsonpatch_export(spark: SparkSession, d: str) -> DataFrame:
    return codec.table_to_json_patch(diff.diff(*_snapshots(spark, d), KEY), KEY)


@query(f"{D1} SELECT * FROM d")
def native_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return codec.native_to_table(codec.table_to_native(diff.diff(*_snapshots(spark, d), KEY), KEY), KEY).selectExpr(*OPS)


@query(f"{duck('stamped')} SELECT event_id, '/' || event_type path, CAST(event_id AS varchar) AS new, CAST(w AS bigint) w, l, n FROM stamped")
def delta_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = _stamped(spark, d).select("event_id", F.lit(0).alias("seq"), F.lit("replace").alias("kind"), F.concat(F.lit("/"), "event_type").alias("path"), F.col("event_id").cast("string").alias("new"), "hlc")
    texts = codec.table_to_native(rows, ["event_id"]).join(rows.select("event_id", "hlc"), "event_id")
    return codec.json_to_deltas(codec.deltas_to_json(texts, ["event_id"]), ["event_id"]).select("event_id", "path", "new", "hlc.w", "hlc.l", "hlc.n")


# --- clocks


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "stamped").withColumn("hlc", hlc.hlc(F.col("w"), F.col("l"), F.col("n")))


@query(f"{duck('stamped')} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY w, l, n) AS bigint) place, w || ':' || l || ':' || n AS stamp FROM stamped")
def hlc_order(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("hlc")).cast("long")
    return _stamped(spark, d).select("event_id", place.alias("place"), hlc.text(F.col("hlc")).alias("stamp"))


@query(f"""{duck('stamped')}, x AS (SELECT event_id, n, CAST(w AS bigint) phys, 1 + event_id % 3 k, max(w) OVER (PARTITION BY n ORDER BY event_id) w FROM stamped)
SELECT event_id, n AS node, CAST(w AS bigint) w, CAST(coalesce(sum(k) OVER (PARTITION BY n, w ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS int) l FROM x""")
def hlc_reserve(spark: SparkSession, d: str) -> DataFrame:
    calls = _stamped(spark, d).select("event_id", F.col("n").alias("node"), F.col("w").alias("phys"), (1 + F.col("event_id") % 3).alias("k"))
    return hlc.reserve(calls, "node", ["event_id"], "phys", "k").select("event_id", "node", "w", "l")


@query(f"{duck('stamped')} SELECT n AS node, CAST(greatest(max(w), max(CASE WHEN event_id % 2 = 0 THEN w + 1800 END)) AS bigint) w FROM stamped GROUP BY 1")
def hlc_receive(spark: SparkSession, d: str) -> DataFrame:
    """Each node's clock after ticks and messages in order; the wall is the largest seen."""
    remote = F.when(F.col("event_id") % 2 == 0, hlc.hlc(F.col("w") + 1800, F.col("l"), F.lit("peer")))
    events = _stamped(spark, d).select(F.col("n").alias("node"), F.struct("event_id", F.col("w").alias("phys"), remote.alias("remote")).alias("e"))
    per = events.groupBy("node").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return per.select("node", hlc.receive(F.col("es"), "node")["w"].alias("w"))


# --- convergent values

LAST = "{'w': w, 'l': l, 'n': n}"


@query(f"{duck('stamped')} SELECT user_id, arg_max(value, {LAST}) AS value, arg_max(event_type, {LAST}) event_type FROM stamped GROUP BY 1")
def lww_register(spark: SparkSession, d: str) -> DataFrame:
    return crdt.lww(_stamped(spark, d), ["user_id"], {"value": "value", "event_type": "event_type"}).drop("hlc")


@query(f"{duck('stamped')} SELECT user_id, arg_max(value, {LAST}) FILTER (WHERE event_type = 'purchase') bought, arg_max(element, {LAST}) FILTER (WHERE event_type = 'click') clicked FROM stamped GROUP BY 1")
def lww_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = _stamped(spark, d).withColumn("h1", F.when(F.col("event_type") == "purchase", F.col("hlc"))).withColumn("h2", F.when(F.col("event_type") == "click", F.col("hlc")))
    return crdt.lww_fields(rows, ["user_id"], {"bought": ("value", "h1"), "clicked": ("element", "h2")})


@query(f"{duck('stamped')} SELECT user_id, event_type, v AS value FROM (SELECT user_id, event_type, arg_max(value, {LAST}) v, arg_max(event_id % 6 = 0, {LAST}) gone FROM stamped GROUP BY 1, 2) WHERE NOT gone")
def lww_map_live(spark: SparkSession, d: str) -> DataFrame:
    rows = _stamped(spark, d).withColumn("deleted", F.col("event_id") % 6 == 0)
    return crdt.live(crdt.lww_map(rows, ["user_id"], "event_type", "value", "deleted")).select("user_id", "event_type", "value")


STEP = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END"


@query(f"{duck('stamped')} SELECT user_id, CAST(sum({STEP}) AS bigint) AS value FROM stamped GROUP BY 1")
def pn_counter(spark: SparkSession, d: str) -> DataFrame:
    return crdt.counter_value(crdt.counter(_stamped(spark, d).withColumn("step", F.expr(STEP)), ["user_id"], "n", "step"), ["user_id"])


@query(f"{duck('stamped')} SELECT n AS node, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS bigint) inc, CAST(count(*) FILTER (WHERE event_type = 'error') AS bigint) AS dec FROM stamped GROUP BY 1")
def pn_counter_merge(spark: SparkSession, d: str) -> DataFrame:
    """Replicas' running totals, all merged."""
    e = _stamped(spark, d)
    run = Window.partitionBy("n").orderBy("hlc").rowsBetween(Window.unboundedPreceding, 0)
    states = e.select(F.lit(1).alias("c"), F.col("n").alias("node"), F.sum(F.expr("if(event_type = 'purchase', 1L, 0L)")).over(run).alias("inc"), F.sum(F.expr("if(event_type = 'error', 1L, 0L)")).over(run).alias("dec"))
    return crdt.merge_counters(states, ["c"], "node").drop("c")


@query(f"{duck('stamped')}, last AS (SELECT user_id, max(ts) t FROM stamped WHERE event_type = 'error' GROUP BY 1) SELECT DISTINCT s.user_id, element FROM stamped s LEFT JOIN last USING (user_id) WHERE event_type IN ('signup', 'click', 'view') AND (t IS NULL OR ts >= t)")
def or_set_items(spark: SparkSession, d: str) -> DataFrame:
    """A remove takes the tags of earlier adds of its user; of a user's removes the latest sees most."""
    e = _stamped(spark, d)
    adds = e.where("event_type in ('signup', 'click', 'view')").select("user_id", "element", hlc.text(F.col("hlc")).alias("tag"), "ts")
    removes = e.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return crdt.or_set_items(crdt.or_set_tags(adds, removes, ["user_id"], "element", "tag", F.col("a.ts") < F.col("r.ts")), ["user_id"], "element")


@query(f"""{REPLICA_DUCK}, eff AS (SELECT side, entity, path, greatest(coalesce(wh, th), coalesce(th, wh)) h FROM r)
SELECT CAST(a.entity AS bigint) entity, a.path, CASE WHEN b.h > a.h THEN 1 ELSE 0 END newer FROM eff a JOIN eff b ON a.entity = b.entity AND a.path = b.path WHERE a.side = 0 AND b.side = 1""")
def replica_apply_delta(spark: SparkSession, d: str) -> DataFrame:
    """Which of the other replica's paths, sent as deltas, are accepted."""
    mine, theirs = replica(spark, d, 0), replica(spark, d, 1)
    rows = theirs.select("entity", "path", F.greatest("write_hlc", "tomb_hlc").alias("hlc"))
    taken = crdt.accepted(rows, mine, ["entity"]).select("entity", "path", F.lit(1).alias("newer"))
    both = mine.select("entity", "path").join(theirs.select("entity", "path"), ["entity", "path"])
    return both.join(taken, ["entity", "path"], "left").select("entity", "path", F.coalesce("newer", F.lit(0)).alias("newer"))


@query(f"""{REPLICA_DUCK}, m AS (SELECT entity, path, max(wh) w, max(th) t FROM r GROUP BY 1, 2) SELECT CAST(entity AS bigint) entity, path, CASE WHEN t IS NULL OR w > t THEN CAST(w.l AS varchar) END AS value, w.w || ':' || w.l || ':' || w.n AS wrote, t.w || ':' || t.l || ':' || t.n AS gone FROM m""")
def replica_merge(spark: SparkSession, d: str) -> DataFrame:
    out = crdt.merge_replicas(replica(spark, d, 0), replica(spark, d, 1), ["entity"])
    shown = lambda c: F.when(F.col(c).isNotNull(), hlc.text(F.col(c)))
    return out.select("entity", "path", "value", shown("write_hlc").alias("wrote"), shown("tomb_hlc").alias("gone"))


@query(f"""{REPLICA_DUCK} SELECT CAST(entity AS bigint) entity, path, w.w || ':' || w.l || ':' || w.n AS wrote FROM (SELECT entity, path, wh w FROM r WHERE side = 0)""")
def replica_snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    state = codec.json_to_state(codec.state_to_json(replica(spark, d, 0), ["entity"], "a"), ["entity"])
    return state.select("entity", "path", F.when(F.col("write_hlc").isNotNull(), hlc.text(F.col("write_hlc"))).alias("wrote"))


# --- text


@query("SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE turn % 4 <> 3), '') AS text FROM conversations GROUP BY 1")
def text_render_linear(spark: SparkSession, d: str) -> DataFrame:
    return text.render_text(text_runs(spark, d).drop("turn"), ["conv_id"])


@query("SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE turn % 4 <> 3 AND turn % 3 <> 1), '') AS text FROM conversations GROUP BY 1")
def text_merge_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Two replicas with deletions of their own."""
    runs = text_runs(spark, d)
    other = runs.withColumn("d", F.col("turn") % 3 == 1)
    return text.render_text(text.merge_tombstones(runs.unionByName(other), ["conv_id"]), ["conv_id"])


@query("""SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN '[' || turn || ']' ELSE '' END || CASE WHEN turn % 4 <> 3 THEN text ELSE '' END, '' ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def text_render_branching(spark: SparkSession, d: str) -> DataFrame:
    """Each even turn has a rival at the same place; the newer id comes first."""
    runs = text_runs(spark, d)
    rival = runs.where("turn % 2 = 0").withColumn("id", F.expr("named_struct('w', id.w + 1000, 'l', 0, 'n', 'bot')")).withColumn("v", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]")))
    return text.render_text(runs.unionByName(rival).drop("turn"), ["conv_id"])


@query("SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS n FROM orders")
def edit_script_len(spark: SparkSession, d: str) -> DataFrame:
    a, b = status_lists(spark, d)
    both = a.withColumnRenamed("xs", "before").join(b.withColumnRenamed("xs", "after"), "o_custkey")
    return edit_script.edit_scripts(both, ["o_custkey"], "before", "after").select("o_custkey", F.size("script").alias("n"))


# --- streams


@query(f"{duck('stamped')} SELECT user_id, '/' || event_type path, arg_max(CAST(event_id AS varchar), {LAST}) AS new FROM stamped GROUP BY 1, 2")
def stream_lww(spark: SparkSession, d: str) -> DataFrame:
    """Events delivered twice as a stream of deltas; the final state is the batch state."""
    base = snapshots.scratch(spark, "stream")
    rows = _stamped(spark, d).select("user_id", F.concat(F.lit("/"), "event_type").alias("path"), F.lit("replace").alias("kind"), F.col("event_id").cast("string").alias("new"), "hlc", (F.col("event_id") % 4).alias("file"))
    rows.unionByName(rows.where("file = 1")).repartition(5, "file").drop("file").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.drop("file").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    run = stream.writeStream.foreachBatch(deltas.upsert_to(f"{base}/state", ["user_id"])).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return deltas.read_state(spark, f"{base}/state", ["user_id"], rows.drop("file").schema).select("user_id", "path", "new")
