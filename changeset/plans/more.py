"""More of the catalogue: paths and builders, wire formats with conditions, edit scripts, clocks, laws, text and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import canon, hlc
from ..functions import conditions as C
from ..functions import paths as P
from ..functions import schema as S
from ..operators import apply, crdt, custom, diff, edit_script, merge, ops, text
from ..sources import codec, snapshots
from ..streaming import deltas
from .catalogue import D1, D3, KEY, SNAPS, _both, _orders, _snapshots, _stamped, query
from .fixtures import KEYED_DUCK, LISTS_DUCK, REPLICA_DUCK, duck, keyed_lists, replica, status_lists, table, text_runs, type_counts, view

STAMP = "struct<w:bigint,l:int,n:string>"


def _homes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name")).alias("who")).alias("home"))


def _one_row(spark: SparkSession, **columns: object) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


# --- paths


@query("SELECT p_partkey, 'a/' || p_partkey AS fst, '~' || p_brand AS snd, '/a~1' || p_partkey || '/~0' || p_brand || '/7' AS again, 3 AS n FROM part")
def path_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Pointers of columns parsed, and joined again with their tokens escaped."""
    pointer = F.concat(F.lit("/a~1"), F.col("p_partkey").cast("string"), F.lit("/~0"), F.col("p_brand"), F.lit("/7"))
    rows = table(spark, d, "part").select("p_partkey", P.parse_column(pointer).alias("t"))
    again = F.concat(F.lit("/"), F.array_join(F.transform("t", P.escape_column), "/"))
    return rows.select("p_partkey", F.get("t", 0).alias("fst"), F.get("t", 1).alias("snd"), again.alias("again"), F.size("t").alias("n"))


@query("SELECT c_custkey, c_mktsegment segment, CAST(c_nationkey AS varchar) nation, '/home/who' above, 'segment' AS last, '/home/who/segment' AS path FROM customer")
def path_fields(spark: SparkSession, d: str) -> DataFrame:
    """Typed selectors against the schema, and the parent of a path."""
    df = _homes(spark, d)
    path = P.field(df.schema, "home.who.segment")
    above, last = P.resolve_parent(path)
    find = apply.State(df.schema).find
    return df.select("c_custkey", find(path).value.alias("segment"), find(P.join(P.parse("home/nation"))).value.cast("string").alias("nation"), F.lit(above).alias("above"), F.lit(last).alias("last"), F.lit(P.normalise("home/who/segment")).alias("path"))


@query(f"{KEYED_DUCK} SELECT l_orderkey, max(CASE WHEN ln = 2 THEN qty END) qty, CAST(max(CASE WHEN ln = 2 THEN 1 ELSE 0 END) AS int) there, arg_min(partkey, ln) AS first FROM fa GROUP BY 1")
def path_keyed_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of a keyed list by their key, of a plain one by position."""
    a, _ = keyed_lists(spark, d)
    element = T.StructType([T.StructField("ln", T.LongType(), metadata={S.KEY: True}), T.StructField("partkey", T.LongType()), T.StructField("qty", T.LongType())])
    keyed = apply.State(T.StructType([a.schema["l_orderkey"], T.StructField("lines", T.ArrayType(element))])).find("/lines/2/qty")
    plain = apply.State(a.schema).find(P.join([*P.parse(P.at("/lines", 0)), "partkey"]))
    return a.select("l_orderkey", keyed.value.alias("qty"), F.coalesce(keyed.present, F.lit(False)).cast("int").alias("there"), plain.value.alias("first"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 2 = 0) AS bought FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY 1")
def path_map_values(spark: SparkSession, d: str) -> DataFrame:
    a, _ = type_counts(spark, d)
    return a.select("user_id", F.coalesce(apply.State(a.schema).find(P.map_key("/m", "purchase")).value, F.lit(0)).alias("bought"))


# --- diff and equality


@query("""WITH c AS (SELECT c_custkey k, c_nationkey n, c_mktsegment s, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END n2, CASE WHEN c_custkey % 6 = 0 THEN 'X' ELSE c_mktsegment END s2 FROM customer)
SELECT k c_custkey, 'replace' kind, '/home/nation' path, CAST(n AS varchar) old, CAST(n2 AS varchar) AS new FROM c WHERE n <> n2 UNION ALL SELECT k, 'replace', '/home/who/segment', '"' || s || '"', '"' || s2 || '"' FROM c WHERE s <> s2""")
def diff_nested_struct(spark: SparkSession, d: str) -> DataFrame:
    """Field by field, with the path of each; a field that is tagged to be ignored gives nothing."""
    a = _homes(spark, d)
    b = a.select("c_custkey", F.expr("named_struct('nation', if(c_custkey % 4 = 0, home.nation + 1, home.nation), 'who', named_struct('segment', if(c_custkey % 6 = 0, 'X', home.who.segment), 'name', 'other'))").alias("home"))
    who = T.StructType([T.StructField("segment", T.StringType()), T.StructField("name", T.StringType(), metadata={S.IGNORE: True})])
    schema = T.StructType([a.schema["c_custkey"], T.StructField("home", T.StructType([T.StructField("nation", T.IntegerType()), T.StructField("who", who)]))])
    return diff.diff(a, b, ["c_custkey"], schema=schema).select("c_custkey", "kind", "path", "old", "new")


@query("""SELECT o_orderkey, 'replace' kind, '/v' path, '"' || o_custkey || '"' old, '"\\"' || o_custkey || '\\""' AS new FROM orders WHERE o_orderkey % 3 = 0""")
def diff_dynamic_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of any type are JSON text: a number that becomes the string of the same characters is a change."""
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("v"))
    b = a.withColumn("v", F.expr("""if(o_orderkey % 3 = 0, concat('"', v, '"'), v)"""))
    return diff.diff(a, b, KEY).select("o_orderkey", "kind", "path", "old", "new")


@query("SELECT o_orderstatus, count(DISTINCT {'c': o_custkey, 'p': o_orderpriority}) AS hashes, CAST(0 AS bigint) lists FROM orders GROUP BY 1")
def hash_keys(spark: SparkSession, d: str) -> DataFrame:
    """As many hash keys as different values; lists have none."""
    df = table(spark, d, "orders").select("o_orderstatus", F.struct("o_custkey", "o_orderpriority").alias("x"), F.array("o_custkey").alias("xs"))
    key = lambda c: canon.hash_key(F.col(c), df.schema[c].dataType)
    return df.select("o_orderstatus", key("x").alias("h"), key("xs").alias("hs")).groupBy("o_orderstatus").agg(F.count_distinct("h").alias("hashes"), F.count("hs").alias("lists"))


@query("SELECT DISTINCT conv_id, 'replace' kind, '/body' path FROM conversations WHERE conv_id % 3 = 0")
def diff_text_runs(spark: SparkSession, d: str) -> DataFrame:
    """A text field whose runs differ is one replace; equal ones give nothing."""
    a = _bodies(text_runs(spark, d))
    b = a.withColumn("body", F.expr("if(conv_id % 3 = 0, transform(body, (r, i) -> if(i = 0, named_struct('id', r.id, 'v', r.v, 'p', r.p, 'd', not r.d), r)), body)"))
    return diff.diff(a, b, ["conv_id"]).select("conv_id", "kind", "path")


def _bodies(runs: DataFrame) -> DataFrame:
    """conv_id, body: a conversation's runs as one text field."""
    kind = f"array<struct<id:{STAMP},v:string,p:{STAMP},d:boolean>>"
    return runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("id", "v", "p", "d"))).cast(kind).alias("body"))


@query(f"{SNAPS} SELECT CAST((SELECT count(*) FROM (SELECT * FROM snap_a EXCEPT ALL SELECT * FROM snap_a)) = 0 AS int) own, CAST((SELECT count(*) FROM (SELECT * FROM snap_a EXCEPT ALL SELECT * FROM snap_b)) = 0 AS int) other")
def table_equality(spark: SparkSession, d: str) -> DataFrame:
    a, b = _snapshots(spark, d)
    return _one_row(spark, own=int(canon.table_equal(a, a.orderBy("o_custkey"))), other=int(canon.table_equal(a, b)))


@query("SELECT n_nationkey, n_name FROM nation")
def skip_unsupported(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot without the columns that can't be compared."""
    df = table(spark, d, "nation").select("n_nationkey", "n_name", F.parse_json(F.lit('{"a":1}')).alias("v"), F.expr("make_interval(1)").alias("i"))
    return df.select(*S.supported(df.schema))


@query("SELECT c_custkey, CAST(c_custkey % 3 <> 2 AS int) changed, CASE c_custkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END way FROM customer")
def diff_by_method(spark: SparkSession, d: str) -> DataFrame:
    """A rule given as an object with a method of its own."""

    class Direction:
        def diff(self, x, y, path):
            op = F.struct(F.lit("replace").alias("kind"), path.alias("path"), F.lit(None).cast("string").alias("from_path"), F.lit(None).cast("string").alias("old"), F.when(y > x, "up").otherwise("down").alias("new"))
            return F.when(x == y, F.array().cast(f"array<{diff.OP}>")).otherwise(F.array(op))

    a = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    b = a.withColumn("c_acctbal", F.expr("case c_custkey % 3 when 0 then c_acctbal + 10 when 1 then c_acctbal - 10 else c_acctbal end"))
    rows = diff.diff(a, b, ["c_custkey"], custom={"double": Direction()}).select("c_custkey", F.col("new").alias("way"))
    return a.select("c_custkey").join(rows, "c_custkey", "left").select("c_custkey", F.col("way").isNotNull().cast("int").alias("changed"), "way")


# --- builders, patches and apply


@query("SELECT 1 empty, 0 built, 'No changes.' none, 'Replace /o_orderstatus: null -> Z\nRemove /o_orderpriority (was null)\nLog /: done' AS shown, 'Added /o_orderpriority: null\nUpdated /o_orderstatus from Z to null' undone")
def patch_builder(spark: SparkSession, d: str) -> DataFrame:
    """A built patch as text, its reverse as a summary."""
    patch = ops.Edit(_orders(spark, d).schema).with_(ops.set_("/o_orderstatus", "Z"), ops.remove("/o_orderpriority")).log("done").build()
    back = patch.reverse().to_table(spark).withColumn("k", F.lit(1))
    undone = ops.render_table(back.withColumn("new", F.coalesce("new", F.lit("null"))).withColumn("old", F.translate("old", '"', "")), ["k"], "summary")
    return undone.select(F.lit(int(ops.Patch().is_empty())).alias("empty"), F.lit(int(patch.is_empty())).alias("built"), F.lit(str(ops.Patch())).alias("none"), F.lit(str(patch)).alias("shown"), F.col("text").alias("undone"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Z' ELSE o_orderstatus END o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'guard_failed' END status FROM orders")
def patch_with_guard(spark: SparkSession, d: str) -> DataFrame:
    """A patch whose guard is replaced."""
    patch = ops.Patch((ops.set_("/o_orderstatus", "Z"),), C.eq("/o_orderstatus", "never")).with_guard(C.eq("/o_orderstatus", "F"))
    return apply.apply_static(_orders(spark, d), patch).select("o_orderkey", "o_orderstatus", "status")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'new' END o_orderstatus, CASE WHEN o_orderpriority LIKE '1%' THEN o_orderpriority END o_orderpriority, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE -o_custkey END o_custkey FROM orders""")
def apply_resolver(spark: SparkSession, d: str) -> DataFrame:
    """A resolver keeps some values from being set or removed and alters others, in the same patch."""

    def resolver(path, kind, current, proposed):
        if path == "/o_orderstatus":
            return F.when(current == "F", current).otherwise(proposed)
        if path == "/o_orderpriority":
            return F.when(current.like("1%"), current).otherwise(proposed)
        return F.when(current % 2 == 0, current).otherwise(-current)

    patch = ops.Patch((ops.set_("/o_orderstatus", "new"), ops.remove("/o_orderpriority"), ops.set_("/o_custkey", 5)))
    return apply.apply_static(_orders(spark, d), patch, resolver=resolver).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END o_orderpriority FROM orders")
def apply_resolver_move(spark: SparkSession, d: str) -> DataFrame:
    """A move that isn't allowed leaves both places as they were."""
    patch = ops.Patch((ops.move("/o_orderstatus", "/o_orderpriority"),))
    out = apply.apply_static(_orders(spark, d), patch, resolver=lambda path, kind, current, proposed: F.when(F.col("o_orderkey") % 2 == 0, current).otherwise(proposed))
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, lower(o_orderstatus) o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'error' END checked, o_orderstatus back FROM orders")
def apply_custom_op(spark: SparkSession, d: str) -> DataFrame:
    """An operation of one's own: applied, checked where strict, and reversed."""

    class Lower:
        def apply(self, current):
            return F.lower(current)

        def check(self, current):
            return current == "F"

        def reverse(self):
            return Upper()

        def summary(self, path):
            return f"Lowered {path}"

    class Upper:
        def apply(self, current):
            return F.upper(current)

        def reverse(self):
            return Lower()

    patch = ops.Patch((custom.custom("/o_orderstatus", Lower()),))
    df = _orders(spark, d).select("o_orderkey", "o_orderstatus")
    done = apply.apply_static(df, patch)
    back = apply.apply_static(done.select("o_orderkey", "o_orderstatus"), patch.reverse()).select("o_orderkey", F.col("o_orderstatus").alias("back"))
    checked = apply.apply_static(df, patch.as_strict()).select("o_orderkey", F.col("status").alias("checked"))
    return done.select("o_orderkey", "o_orderstatus").join(checked, "o_orderkey").join(back, "o_orderkey")


@query(f"""{KEYED_DUCK}, ks AS (SELECT l_orderkey, list(ln ORDER BY ln) ks FROM fa GROUP BY 1)
SELECT l_orderkey, CASE WHEN list_contains(ks, 2) THEN array_to_string(list_filter(ks, lambda x: x <= 5), ',') || ',50' || CASE WHEN len(list_filter(ks, lambda x: x > 5)) > 0 THEN ',' || array_to_string(list_filter(ks, lambda x: x > 5), ',') ELSE '' END
WHEN list_contains(ks, 6) OR list_contains(ks, 7) THEN array_to_string(list_filter(ks, lambda x: x <= 5), ',') || CASE WHEN len(list_filter(ks, lambda x: x <= 5)) > 0 THEN ',' ELSE '' END || '50,' || array_to_string(list_filter(ks, lambda x: x > 5), ',')
ELSE array_to_string(ks, ',') || ',50' END AS keys FROM ks""")
def keyed_insert(spark: SparkSession, d: str) -> DataFrame:
    """An element goes after a given one, or to the front where that is missing, and then past smaller key texts."""
    a, _ = keyed_lists(spark, d)
    element = T.StructType([T.StructField("ln", T.LongType(), metadata={S.KEY: True}), T.StructField("partkey", T.LongType()), T.StructField("qty", T.LongType())])
    new = F.expr("named_struct('ln', 50L, 'partkey', 1L, 'qty', 1L)")
    return a.select("l_orderkey", F.array_join(F.transform(P.insert_keyed(F.col("lines"), T.ArrayType(element), new, F.lit("2")), lambda x: x["ln"].cast("string")), ",").alias("keys"))


@query("SELECT 25 AS n, 10 AS told")
def log_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Log lines handed to a callback of the caller's, with their rows' keys."""
    got: list[tuple[tuple, str]] = []
    df = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    apply.deliver_logs(apply.apply_static(df, ops.Patch((ops.log("seen"), ops.log("low").when(C.lt("/n_regionkey", 2))))), ["n_nationkey"], lambda key, line: got.append((key, line)))
    return _one_row(spark, n=len({k for k, line in got if line == "seen"}), told=sum(line == "low" for _, line in got))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS bought, count(DISTINCT event_type) kinds FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def map_keys_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Keys that mean the same in several spellings."""
    a, _ = type_counts(spark, d)
    m = a.select("user_id", canon.canonical_keys(F.transform_keys("m", lambda k, _: F.concat(F.lit(" "), F.initcap(k))), lambda k: F.upper(F.trim(k))).alias("m"))
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("PURCHASE")), F.lit(0)).alias("bought"), F.size("m").cast("long").alias("kinds"))


# --- conditions


WIRE = '{"op":"and","apply":[{"op":"more-or-equal","path":"/o_custkey","value":300},{"op":"not","apply":[{"op":"test","path":"/o_orderstatus","value":"P"}]},{"op":"or","apply":[{"op":"contains","path":"/o_orderstatus","value":["O","F"]},{"op":"defined","path":"/o_custkey"}]}]}'


@query(f"{duck('snap_a')} SELECT o_orderkey, CAST(o_custkey >= 300 AND o_orderstatus <> 'P' AS int) told, '{WIRE}' wire FROM snap_a")
def predicate_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A condition as a wire predicate, and what comes back, tested."""
    cond = C.and_(C.ge("/o_custkey", 300), C.ne("/o_orderstatus", "P"), C.or_(C.in_("/o_orderstatus", ["O", "F"]), C.exists("/o_custkey")))
    df = view(spark, d, "snap_a")
    told = C.compile_condition(C.from_predicate(cond.to_json()), apply.State(df.schema).find)
    return df.select("o_orderkey", told.cast("int").alias("told"), F.lit(cond.to_json()).alias("wire"))


@query("SELECT o_orderkey, CAST(lower(o_orderpriority) = '2-high' AS int) folded, 0 plain FROM orders")
def cond_ignore_case(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    find, cond = apply.State(df.schema).find, C.eq("/o_orderpriority", "2-high")
    return df.select("o_orderkey", C.compile_condition(cond, find, ignore_case=True).cast("int").alias("folded"), C.compile_condition(cond, find).cast("int").alias("plain"))


# --- wire formats


CONDITIONS = """[{"op":"test","path":"/","if":{"op":"more","path":"/o_custkey","value":5}},{"op":"replace","path":"/o_custkey","value":' || o_custkey || ',"if":{"op":"test","path":"/s","value":"x"}},{"op":"add","path":"/o","value":{"value":"a"}},{"op":"add","path":"/q","value":"' || o_orderstatus || '"},{"op":"move","path":"/b","from":"/a"},{"op":"remove","path":"/r","unless":{"op":"defined","path":"/value"}}]"""


@query("""SELECT o_orderkey, seq, kind, path, from_path, new, if_cond, unless_cond, '{"op":"more","path":"/o_custkey","value":5}' AS guard FROM orders, (VALUES (1, 'replace', '/o_custkey', NULL, '{"op":"test","path":"/s","value":"x"}', NULL), (2, 'add', '/o', NULL, NULL, NULL),
(3, 'add', '/q', NULL, NULL, NULL), (4, 'move', '/b', '/a', NULL, NULL), (5, 'remove', '/r', NULL, NULL, '{"op":"defined","path":"/value"}')) v(seq, kind, path, from_path, if_cond, unless_cond),
LATERAL (SELECT CASE seq WHEN 1 THEN CAST(o_custkey AS varchar) WHEN 2 THEN '{"value":"a"}' WHEN 3 THEN '"' || o_orderstatus || '"' END AS new)""")
def jsonpatch_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, objects and strings beside conditions that have values of their own."""
    texts = table(spark, d, "orders").select("o_orderkey", F.expr("concat('" + CONDITIONS.replace("' || ", "', ").replace(" || '", ", '") + "')").alias("patch"))
    return codec.json_patch_to_table(texts, KEY).select("o_orderkey", F.col("seq").cast("int").alias("seq"), "kind", "path", "from_path", "new", "if_cond", "unless_cond", "guard")


@query(f"{SNAPS} SELECT * FROM snap_b")
def jsonpatch_apply(spark: SparkSession, d: str) -> DataFrame:
    """Patch texts, as an endpoint receives them, read as a table and applied; whole rows come and go."""
    a, b = _snapshots(spark, d)
    texts = codec.table_to_json_patch(diff.diff(a, b, KEY), KEY)
    return apply.apply_writes(a, codec.json_patch_to_table(texts, KEY), KEY).select(*b.columns)


@query("""SELECT o_orderkey, seq, kind, path, from_path, old, new, if_cond, seq = 2 AND false AS strict FROM orders, LATERAL (VALUES (0, 'replace', '/o', NULL, '{"n":"5"}', '{"n":' || o_custkey || ',"o":"x"}', '{"op":"test","path":"/n","value":"y"}'),
(1, 'replace', '/s', NULL, '5', '"5"', NULL), (2, 'move', '/t', '/s', NULL, NULL, NULL)) v(seq, kind, path, from_path, old, new, if_cond)""")
def native_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects, numbers and strings of digits as old and new values."""
    rows = table(spark, d, "orders").select(
        "o_orderkey",
        F.explode(F.array(
            F.struct(F.lit(0).alias("seq"), F.lit("replace").alias("kind"), F.lit("/o").alias("path"), F.lit(None).cast("string").alias("from_path"), F.lit('{"n":"5"}').alias("old"), F.concat(F.lit('{"n":'), F.col("o_custkey").cast("string"), F.lit(',"o":"x"}')).alias("new"), F.lit('{"op":"test","path":"/n","value":"y"}').alias("if_cond")),
            F.struct(F.lit(1).alias("seq"), F.lit("replace").alias("kind"), F.lit("/s").alias("path"), F.lit(None).cast("string").alias("from_path"), F.lit("5").alias("old"), F.lit('"5"').alias("new"), F.lit(None).cast("string").alias("if_cond")),
            F.struct(F.lit(2).alias("seq"), F.lit("move").alias("kind"), F.lit("/t").alias("path"), F.lit("/s").alias("from_path"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.lit(None).cast("string").alias("if_cond")),
        )).alias("x"),
    ).select("o_orderkey", "x.*")
    back = codec.native_to_table(codec.table_to_native(rows, KEY), KEY)
    return back.select("o_orderkey", F.col("seq").cast("int").alias("seq"), "kind", "path", "from_path", "old", "new", "if_cond", "strict")


@query(f"""{duck('stamped')} SELECT event_id, seq, kind, path, from_path, new, if_cond, true AS strict, CAST(w AS bigint) w FROM stamped, LATERAL (VALUES (0, 'replace', '/v', NULL, '"' || event_type || '"', '{{"op":"less","path":"/v","value":3}}'), (1, 'move', '/b', '/v', NULL, NULL)) x(seq, kind, path, from_path, new, if_cond)""")
def delta_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Deltas keep conditions, strictness, strings and the sources of moves."""
    e = _stamped(spark, d)
    none = F.lit(None).cast("string")
    first = e.select("event_id", F.lit(0).alias("seq"), F.lit("replace").alias("kind"), F.lit("/v").alias("path"), none.alias("from_path"), F.concat(F.lit('"'), "event_type", F.lit('"')).alias("new"), F.lit(C.lt("/v", 3).to_json()).alias("if_cond"))
    second = e.select("event_id", F.lit(1).alias("seq"), F.lit("move").alias("kind"), F.lit("/b").alias("path"), F.lit("/v").alias("from_path"), none.alias("new"), none.alias("if_cond"))
    texts = codec.table_to_native(first.unionByName(second).withColumn("strict", F.lit(True)), ["event_id"]).join(e.select("event_id", "hlc"), "event_id")
    return codec.json_to_deltas(codec.deltas_to_json(texts, ["event_id"]), ["event_id"]).select("event_id", F.col("seq").cast("int").alias("seq"), "kind", "path", "from_path", "new", "if_cond", "strict", "hlc.w")


@query(f"""{REPLICA_DUCK}, m AS (SELECT entity, path, wh, th FROM r WHERE side = 0) SELECT CAST(entity AS bigint) entity, path, CASE WHEN th IS NULL OR wh > th THEN '"n' || wh.l || '"' END AS value, wh.w || ':' || wh.l || ':' || wh.n AS wrote, th.w || ':' || th.l || ':' || th.n AS gone FROM m""")
def replica_snapshot_values(spark: SparkSession, d: str) -> DataFrame:
    """Values that are strings, and all clocks, through a snapshot text."""
    state = replica(spark, d, 0).withColumn("value", F.concat(F.lit('"n'), F.col("value"), F.lit('"')))
    back = codec.json_to_state(codec.state_to_json(state, ["entity"], "a"), ["entity"])
    shown = lambda c: F.when(F.col(c).isNotNull(), hlc.text(F.col(c)))
    return back.select("entity", "path", "value", shown("write_hlc").alias("wrote"), shown("tomb_hlc").alias("gone"))


@query("SELECT n_nationkey, n_name FROM nation")
def snapshot_formats(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot written and read as Parquet, JSON, ORC and CSV; the rows that all of them have."""
    df = table(spark, d, "nation").select("n_nationkey", "n_name")
    base, back = snapshots.scratch(spark, "formats"), []
    for fmt in ("parquet", "json", "orc", "csv"):
        snapshots.write_snapshot(df, f"{base}/{fmt}", fmt)
        back.append(snapshots.read_snapshot(spark, f"{base}/{fmt}", fmt, df.schema))
    return reduce(DataFrame.intersectAll, back)


# --- merging


@query("""WITH """ + D3.removeprefix("WITH ") + """, v AS (SELECT o_orderkey, greatest(b.o_custkey, c.o_custkey) most, least(b.o_custkey, c.o_custkey) few FROM snap_a a JOIN snap_b b USING (o_orderkey) JOIN snap_c c USING (o_orderkey) WHERE a.o_custkey <> b.o_custkey AND a.o_custkey <> c.o_custkey)
SELECT o_orderkey, CAST(most AS varchar) most, CAST(few AS varchar) few FROM v""")
def merge_numeric(spark: SparkSession, d: str) -> DataFrame:
    """The largest and smallest of two numbers by their amount, not their text."""
    x, y = _both(spark, d)
    both = lambda r: merge.merge_tables(x, y, KEY, r).where("path = '/o_custkey'").join(x, [*KEY, "path"], "left_semi").join(y, [*KEY, "path"], "left_semi")
    return both(merge.largest).select("o_orderkey", F.col("new").alias("most")).join(both(merge.smallest).select("o_orderkey", F.col("new").alias("few")), "o_orderkey")


# --- edit scripts


@query(f"{LISTS_DUCK} SELECT o_custkey, array_to_string(xs, ',') xs FROM lb")
def edit_script_applied(spark: SparkSession, d: str) -> DataFrame:
    """A list after its script is the other list."""
    a, b = status_lists(spark, d)
    both = a.withColumnRenamed("xs", "before").join(b.withColumnRenamed("xs", "after"), "o_custkey")
    scripts = edit_script.edit_scripts(both, ["o_custkey"], "before", "after")
    return edit_script.apply_scripts(a.join(scripts, "o_custkey"), ["o_custkey"], "xs", "script").select("o_custkey", F.array_join("xs", ",").alias("xs"))


@query(f"""{LISTS_DUCK}, x AS (SELECT o_custkey, len(xs) n, o_custkey % 2 = 0 h, o_custkey % 5 = 0 t FROM la)
SELECT o_custkey, 'remove' kind, 0 AS position FROM x WHERE h UNION ALL SELECT o_custkey, 'add', 0 FROM x WHERE h UNION ALL SELECT o_custkey, 'add', CAST(n AS int) FROM x WHERE t""")
def edit_script_positions(spark: SparkSession, d: str) -> DataFrame:
    """Where each edit stands when they are run one after another."""
    a, b = status_lists(spark, d)
    both = a.withColumnRenamed("xs", "before").join(b.withColumnRenamed("xs", "after"), "o_custkey")
    flat = edit_script.edit_scripts(both, ["o_custkey"], "before", "after").select("o_custkey", F.posexplode("script").alias("seq", "e")).select("o_custkey", "seq", "e.*")
    return edit_script.shifted_positions(flat, ["o_custkey"], "seq").select("o_custkey", "kind", "position")


# --- clocks and replicas


@query(f"""{duck('stamped')}, x AS (SELECT event_id, n, max(w) OVER (PARTITION BY n ORDER BY event_id) w FROM stamped)
SELECT event_id, CAST(w AS bigint) w, CAST(row_number() OVER (PARTITION BY n, w ORDER BY event_id) - 1 AS int) l FROM x""")
def hlc_now(spark: SparkSession, d: str) -> DataFrame:
    """One tick for each event, from a new clock."""
    calls = _stamped(spark, d).select("event_id", F.col("n").alias("node"), F.col("w").alias("phys"), F.lit(1).alias("one"))
    return hlc.reserve(calls, "node", ["event_id"], "phys", "one").select("event_id", "w", "l")


@query(f"""{duck('stamped').replace('WITH ', 'WITH RECURSIVE ')}, e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) i, w phys, CASE WHEN event_id % 2 = 0 THEN w + 1800 * (event_id % 3) END rw, l rl FROM stamped),
f AS (SELECT DISTINCT user_id, CAST(0 AS bigint) i, CAST(0 AS bigint) w, CAST(0 AS bigint) l FROM e
UNION ALL SELECT f.user_id, e.i, greatest(f.w, e.phys, coalesce(e.rw, 0)), CASE WHEN e.rw IS NULL THEN CASE WHEN f.w >= e.phys THEN f.l + 1 ELSE 0 END
  WHEN f.w = e.rw AND f.w >= e.phys THEN greatest(f.l, e.rl) + 1 WHEN f.w > e.rw AND f.w >= e.phys THEN f.l + 1 WHEN e.rw > f.w AND e.rw >= e.phys THEN e.rl + 1 ELSE 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, arg_max(w, i) w, CAST(arg_max(l, i) AS int) l FROM f GROUP BY 1""")
def hlc_receive_logical(spark: SparkSession, d: str) -> DataFrame:
    """The wall and logical parts of each user's clock after ticks and messages in order."""
    remote = F.when(F.col("event_id") % 2 == 0, hlc.hlc(F.col("w") + 1800 * (F.col("event_id") % 3), F.col("l"), F.lit("peer")))
    per = _stamped(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("w").alias("phys"), remote.alias("remote")))).alias("es"))
    got = hlc.receive(F.col("es"), "node")
    return per.select("user_id", got["w"].alias("w"), got["l"].alias("l"))


@query(f"{D1} SELECT o_orderkey, path, CASE WHEN kind <> 'remove' THEN '7:' || seq || ':a' END wrote, CASE WHEN kind = 'remove' THEN '7:' || seq || ':a' END gone FROM d")
def replica_local_edit(spark: SparkSession, d: str) -> DataFrame:
    """A local edit: its ops are the difference, each stamped by the clock, and leave a clock or a tombstone at their path."""
    edit = diff.diff(*_snapshots(spark, d), KEY).withColumn("hlc", hlc.hlc(F.lit(7), F.col("seq"), F.lit("a")))
    shown = lambda c: F.when(F.col(c).isNotNull(), hlc.text(F.col(c)))
    return crdt.stamped_metadata(edit, KEY).select("o_orderkey", "path", shown("write_hlc").alias("wrote"), shown("tomb_hlc").alias("gone"))


@query("SELECT unnest(['associative', 'commutative', 'idempotent']) law, CAST(0 AS bigint) AS differ")
def merge_laws(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of merged replicas depend on the order or number of merges."""
    x, y = replica(spark, d, 0), replica(spark, d, 1)
    z = y.select("entity", "path", F.concat(F.lit("z"), "value").alias("value"), F.expr("named_struct('w', write_hlc.w + 1, 'l', write_hlc.l, 'n', 'z')").alias("write_hlc"), "tomb_hlc")
    both = lambda a, b: crdt.merge_replicas(a, b, ["entity"])
    xy = both(x, y)
    pairs = {"commutative": (xy, both(y, x)), "idempotent": (both(xy, y), xy), "associative": (both(xy, z), both(x, both(y, z)))}
    rows = [p.exceptAll(q).unionAll(q.exceptAll(p)).agg(F.count("*").alias("differ")).select(F.lit(law).alias("law"), "differ") for law, (p, q) in pairs.items()]
    return reduce(DataFrame.unionByName, rows)


# --- text


@query("SELECT conv_id, coalesce(string_agg(CASE WHEN turn % 2 = 0 THEN left(text, 3) ELSE text END, '' ORDER BY turn) FILTER (WHERE turn % 4 <> 3), '') AS text FROM conversations GROUP BY 1")
def text_merge_unaligned(spark: SparkSession, d: str) -> DataFrame:
    """Replicas that cut their runs at other places, one with tails deleted."""
    runs = text_runs(spark, d)
    head = F.expr("left(v, 3)")
    begin = F.col("id.l") + F.octet_length(head)
    place = lambda l: F.struct(F.col("id.w").alias("w"), l.cast("int").alias("l"), F.col("id.n").alias("n"))
    tails = runs.select("conv_id", place(begin).alias("id"), F.expr("substr(v, 4)").alias("v"), place(begin - 1).alias("p"), (F.col("d") | (F.col("turn") % 2 == 0)).alias("d"))
    heads = runs.select("conv_id", "id", head.alias("v"), "p", "d")
    merged = text.merge_text(runs.drop("turn").unionByName(heads).unionByName(tails), ["conv_id"])
    return text.render_text(merged.select("conv_id", F.explode("runs").alias("r")).select("conv_id", "r.*"), ["conv_id"])


@query("WITH t AS (SELECT conv_id, '>>' || coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE turn % 4 <> 3), '') x FROM conversations GROUP BY 1) SELECT conv_id, left(x, 5) || substr(x, 10) AS text FROM t")
def text_edits(spark: SparkSession, d: str) -> DataFrame:
    """An insertion at the front and a deletion that cuts runs, by byte positions."""
    runs = text_runs(spark, d).drop("turn")
    states = text.merge_text(runs, ["conv_id"])
    shown = text.render_text(runs, ["conv_id"]).select("conv_id", F.concat(F.lit(">>"), "text").alias("x"))
    bytes_of = lambda a, n: F.octet_length(F.expr(f"substr(x, {a}, {n})"))
    edits = shown.select("conv_id", F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("insert").alias("kind"), F.lit(0).alias("pos"), F.lit(0).alias("length"), F.lit(">>").alias("v"), F.expr("named_struct('w', 99L, 'l', 0, 'n', 'me')").alias("id")),
        F.struct(F.lit(1).alias("seq"), F.lit("delete").alias("kind"), bytes_of(1, 5).alias("pos"), bytes_of(6, 4).alias("length"), F.lit(None).cast("string").alias("v"), F.lit(None).cast(STAMP).alias("id")),
    )).alias("e")).select("conv_id", "e.*")
    after = text.edit_text(states, edits, ["conv_id"])
    return text.render_text(after.select("conv_id", F.explode("runs").alias("r")).select("conv_id", "r.*"), ["conv_id"])


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) FILTER (WHERE turn % 4 <> 3 AND turn < 4) AS text FROM conversations GROUP BY 1")
def apply_text_field(spark: SparkSession, d: str) -> DataFrame:
    """Text fields merge with what a patch brings, whatever its conditions say."""
    runs = text_runs(spark, d)
    mine, theirs = _bodies(runs.where("turn < 2")), _bodies(runs.where("turn < 4"))
    changes = diff.diff(mine, theirs, ["conv_id"]).where("path <> '/'").withColumn("if_cond", F.lit(C.eq("/conv_id", -1).to_json()))
    done = apply.apply_table_general(mine, changes, ["conv_id"]).select("conv_id", F.explode("body").alias("r")).select("conv_id", "r.*")
    return text.render_text(done, ["conv_id"])


@query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN '' ELSE coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE turn % 4 <> 3), '') END AS early, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE turn % 4 <> 3), '') AS late FROM conversations GROUP BY 1 HAVING count(*) > 1")
def text_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose predecessor hasn't come are kept and shown once it has."""
    runs = text_runs(spark, d)
    missing = (F.col("turn") == 0) & (F.col("conv_id") % 2 == 0)
    state = text.merge_text(runs.where(~missing).drop("turn"), ["conv_id"]).select("conv_id", F.explode("runs").alias("r")).select("conv_id", "r.*")
    later = state.unionByName(runs.where(missing).drop("turn"))
    some = runs.groupBy("conv_id").count().where("count > 1").select("conv_id")
    early = text.render_text(state, ["conv_id"]).withColumnRenamed("text", "early")
    return some.join(early, "conv_id").join(text.render_text(later, ["conv_id"]).withColumnRenamed("text", "late"), "conv_id")


@query("SELECT conv_id, 1 AS same FROM conversations GROUP BY 1")
def text_convergence(spark: SparkSession, d: str) -> DataFrame:
    """Three replicas with edits of their own, merged in two orders."""
    runs = text_runs(spark, d)
    rows = lambda state: state.select("conv_id", F.explode("runs").alias("r")).select("conv_id", "r.*")
    both = lambda a, b: rows(text.merge_text(a.unionByName(b), ["conv_id"]))
    x = runs.drop("turn")
    y = x.withColumn("d", F.col("d") | (F.col("id.w") % 3 == 0))
    z = runs.where("turn % 2 = 0").select("conv_id", F.expr("named_struct('w', id.w + 1000, 'l', 0, 'n', 'bot')").alias("id"), F.lit("[+]").alias("v"), "p", F.lit(False).alias("d")).unionByName(x)
    one, two = text.render_text(both(both(x, y), z), ["conv_id"]), text.render_text(both(z, both(y, x)), ["conv_id"]).withColumnRenamed("text", "other")
    return one.join(two, "conv_id").select("conv_id", (F.col("text") == F.col("other")).cast("int").alias("same"))


@query("SELECT unnest(['/body', '/body/0/v', '/home/notes/2', '/home', '/n']) path, unnest(['/body', '/body', '/home/notes', NULL, NULL]) ancestor")
def text_ancestors(spark: SparkSession, d: str) -> DataFrame:
    runs = _bodies(text_runs(spark, d)).schema["body"].dataType
    schema = T.StructType([T.StructField("body", runs), T.StructField("home", T.StructType([T.StructField("notes", runs)])), T.StructField("n", T.LongType())])
    return spark.createDataFrame([(p, text.text_ancestor(schema, p)) for p in ("/body", "/body/0/v", "/home/notes/2", "/home", "/n")], "path string, ancestor string")


# --- streams


@query(f"""{duck('stamped').replace('WITH ', 'WITH RECURSIVE ')}, e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY w, l, n) i, event_id v, event_id % 5 = 0 free FROM stamped),
f AS (SELECT DISTINCT user_id, CAST(0 AS bigint) i, CAST(NULL AS bigint) v FROM e UNION ALL SELECT f.user_id, e.i, CASE WHEN e.free OR f.v % 2 = 0 AND f.v < 500 THEN e.v ELSE f.v END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, CAST(arg_max_null(v, i) AS varchar) AS new FROM f GROUP BY 1 HAVING arg_max_null(v, i) IS NOT NULL""")
def stream_conditional(spark: SparkSession, d: str) -> DataFrame:
    """Deltas with conditions on the current value, in order of their stamps, through the state store."""
    base = snapshots.scratch(spark, "stream")
    # An even value below 500 lets the next one in; every fifth comes unasked.
    free = F.col("event_id") % 5 == 0
    e = _stamped(spark, d)
    rows = e.select("user_id", F.lit("/v").alias("path"), F.lit("replace").alias("kind"), F.col("event_id").cast("string").alias("new"), F.when(~free, F.lit(C.and_(C.lt("/v", 500), C.in_("/v", list(range(0, 500, 2)))).to_json())).alias("if_cond"), "hlc")
    rows.coalesce(1).write.parquet(f"{base}/in")
    had = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    deltas.use_state_store(spark)
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    state = deltas.conditional_replicas(stream, "user_id", T.StructType([T.StructField("v", T.LongType())]))
    keep = state.select("user_id", "path", F.lit("replace").alias("kind"), "new", F.struct("w", "l", "n").alias("hlc"))
    run = keep.writeStream.outputMode("update").foreachBatch(deltas.upsert_to(f"{base}/state", ["user_id"])).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if had:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)
    return deltas.read_state(spark, f"{base}/state", ["user_id"], keep.schema).select("user_id", "new")
