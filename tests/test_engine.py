"""Operators on small literal tables: the shapes that the laws and corner cases need."""

import itertools
import json
import random

import harness
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeset.functions import canon, hlc
from changeset.functions import conditions as C
from changeset.functions import paths as P
from changeset.functions import schema as S
from changeset.operators import apply, crdt, diff, edit_script, merge, moves, ops, text
from changeset.plans import catalogue
from changeset.sources import codec, snapshots

TASK = T.StructType([T.StructField("ID", T.StringType(), metadata={S.KEY: True}), T.StructField("Status", T.StringType()), T.StructField("Value", T.LongType())])
USER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("info", T.StructType([T.StructField("age", T.LongType()), T.StructField("addr", T.StringType())])),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("score", T.MapType(T.StringType(), T.LongType())),
        T.StructField("tasks", T.ArrayType(TASK)),
        T.StructField("deep", T.MapType(T.StringType(), T.StructType([T.StructField("x", T.LongType())]))),
    ]
)
A = [(1, "ann", (30, "here"), ["a", "b", "c"], {"k": 1, "a/b": 2}, [("t1", "open", 1), ("t2", "done", 2)], {"m": (1,)}), (2, None, None, None, None, None, None), (3, "cy", (1, None), [], {}, [], {}), (4, "gone", None, None, None, None, None)]
B = [(1, "ann", (31, "here"), ["a", "x", "c"], {"k": 5, "n": 3}, [("t2", "done", 9), ("t3", "new", 0)], {"m": (2,), "q": (3,)}), (2, "bo", (1, "x"), ["z"], {"q": 1}, [("t", "s", 1)], {"m": (1,)}), (3, None, None, ["p", "q"], None, None, {}), (5, "come", None, None, None, None, None)]


@pytest.fixture(scope="module")
def ab(spark):
    return spark.createDataFrame(A, USER), spark.createDataFrame(B, USER)


def by_id(df, *cols):
    return {r["id"]: r for r in df.select("id", *cols).collect()}


def test_paths():
    assert P.parse("") == P.parse("/") == () and P.parse("a/b") == P.parse("/a/b") == ("a", "b")
    assert P.parse("/a~1b/~0") == ("a/b", "~") and P.join(["a/b", "~"]) == "/a~1b/~0" and P.join([]) == "/"
    assert P.normalise("/x/007") == "/x/7" and P.at("/xs", 3) == "/xs/3" and P.map_key("/m", "a/b") == "/m/a~1b"
    assert P.field(USER, "info.age") == "/info/age"
    with pytest.raises(KeyError):
        P.field(USER, "info.nope")


def test_parse_column(spark):
    df = spark.createDataFrame([("/a~1b/~0",), ("",), ("/",), ("x/y",)], "p string")
    assert [r[0] for r in df.select(P.parse_column(F.col("p"))).collect()] == [["a/b", "~"], [], [], ["x", "y"]]


def test_diff_covers_every_shape(ab):
    a, b = ab
    rows = diff.diff(a, b, ["id"], schema=USER).collect()
    got = {(r["id"], r["kind"], r["path"]): (r["old"], r["new"]) for r in rows}
    assert got[1, "replace", "/info/age"] == ("30", "31")
    assert got[1, "replace", "/roles/1"] == ('"b"', '"x"')
    assert got[1, "remove", "/score/a~1b"] == ("2", None) and got[1, "add", "/score/n"] == (None, "3") and got[1, "replace", "/score/k"] == ("1", "5")
    assert got[1, "remove", "/tasks/t1"][1] is None and got[1, "replace", "/tasks/t2/Value"] == ("2", "9") and json.loads(got[1, "add", "/tasks/t3"][1])["Status"] == "new"
    assert got[1, "replace", "/deep/m/x"] == ("1", "2") and got[1, "add", "/deep/q"] == (None, '{"x":3}')
    assert got[2, "add", "/name"] == (None, '"bo"') and (2, "add", "/info") in got and got[2, "add", "/score/q"] == (None, "1")
    assert got[3, "replace", "/roles"] == ("[]", '["p","q"]') and (3, "remove", "/info") in got and (3, "remove", "/score") in got
    assert (4, "remove", "/") in got and (5, "add", "/") in got
    seqs = sorted(r["seq"] for r in rows if r["id"] == 1)
    assert seqs == list(range(len(seqs)))
    assert diff.diff(a, a, ["id"], schema=USER).count() == 0


def test_apply_of_diff_is_the_other_side(ab):
    a, b = ab
    d = diff.diff(a, b, ["id"], schema=USER).where("path <> '/'")
    done = apply.apply_table_general(a, d, ["id"], schema=USER)
    assert {r["status"] for r in done.collect()} == {"ok"}
    left = diff.diff(done.select(*b.columns), b, ["id"], schema=USER).where("path <> '/'").collect()
    assert left == []
    back = apply.apply_table_general(b, ops.reverse_table(d, ["id"]), ["id"], schema=USER).select(*a.columns)
    # A map that was null comes back empty: its entries are added one by one, and so taken away one by one.
    assert {(r["old"], r["new"]) for r in diff.diff(back, a, ["id"], schema=USER).where("path <> '/'").collect()} <= {("{}", None)}


def test_diff_options(spark):
    s = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("skip", T.LongType(), metadata={S.IGNORE: True}), T.StructField("xs", T.ArrayType(TASK))])
    a = spark.createDataFrame([(1, float("nan"), 1, [("a", "", 1), ("b", "", 2)])], s)
    b = spark.createDataFrame([(1, float("nan"), 2, [("b", "", 2), ("a", "", 1)])], s)
    assert diff.diff(a, b, ["id"], schema=s).count() == 0
    assert [r["path"] for r in diff.diff(a, b, ["id"], schema=s, ieee_nan=True).collect()] == ["/x"]
    assert [r["path"] for r in diff.diff(a, b, ["id"], schema=s, preserve_order=True).collect()] == ["/xs"]
    with pytest.raises(TypeError):
        S.checked(T.StructType([T.StructField("v", T.VariantType())]))


def test_equal_and_clone(ab):
    a, b = ab
    assert by_id(canon.row_equal(a, a, ["id"]), "equal")[1]["equal"] == 1
    assert by_id(canon.row_equal(a, b, ["id"]), "equal")[1]["equal"] == 0
    c = canon.clone(a, ignore={"/info/addr", "/roles"}, rewrite={"/name": F.upper})
    row = by_id(c, "name", "info", "roles", "score")[1]
    assert (row["name"], row["info"]["addr"], row["info"]["age"], row["roles"], row["score"]["k"]) == ("ANN", None, 30, None, 1)
    assert canon.table_equal(a.select("id", "name"), a.select("id", "name")) and not canon.table_equal(a.select("id", "name"), b.select("id", "name"))


def applied(df, *todo, **kw):
    return apply.apply_static(df, ops.Patch(tuple(todo), kw.pop("guard", None), kw.pop("strict", False)), schema=USER, **kw)


def test_static_apply_agrees_with_the_interpreter(spark, ab):
    a, _ = ab
    todo = [
        ops.set_("/roles/0", "z"), ops.add("/roles/3", "end"), ops.add("/roles/9", "far"), ops.remove("/roles/1"), ops.set_("/score/k", 7), ops.add("/score/x~1y", 1), ops.remove("/score/none"),
        ops.set_("/tasks/t1/Value", 11), ops.add("/tasks/t9", {"ID": "t9", "Status": "s", "Value": 1}), ops.remove("/tasks/t2"), ops.remove("/tasks/zz"), ops.set_("/deep/m/x", 5), ops.set_("/deep/no/x", 5), ops.remove("/deep/m/x"),
        ops.copy("/name", "/info/addr"), ops.move("/info/age", "/score/age"), ops.log("seen"), ops.set_("/name", "cond").when(C.eq("/score/k", 7)), ops.set_("/name", "un").except_when(C.exists("/name")),
    ]
    one = by_id(applied(a, *todo), *[c for c in a.columns if c != "id"], "status", "errors", "log")
    rows = ops.Patch(tuple(todo)).to_table(spark).crossJoin(a.select("id"))
    two = by_id(apply.apply_table_general(a, rows, ["id"], schema=USER), *[c for c in a.columns if c != "id"], "status", "errors", "log")
    for k in one:
        for c in ("name", "info", "roles", "score", "tasks", "deep", "status", "log"):
            assert one[k][c] == two[k][c], (k, c, one[k], two[k])
        assert len(one[k]["errors"]) == len(two[k]["errors"])
    assert one[1]["roles"] == ["z", "c", "end"] and one[1]["name"] == "cond" and one[1]["tasks"][-1]["ID"] == "t9" and one[1]["score"]["x/y"] == 1


def test_modes_guards_and_tags(ab):
    a, _ = ab
    s = a.select("id", "name", F.lit("other").alias("second"))
    swap = ops.Patch((ops.copy("/second", "/name"), ops.copy("/name", "/second")))
    assert by_id(apply.apply_static(s, swap, mode="simultaneous"), "name", "second")[1][1:] == ("other", "ann")
    assert by_id(apply.apply_static(s, swap), "name", "second")[1][1:] == ("other", "other")
    cycle = ops.Patch((ops.move("/second", "/name"), ops.set_("/second", "kept")))
    assert by_id(apply.apply_static(s, cycle, mode="simultaneous"), "name", "second")[1][1:] == ("other", "kept")
    g = by_id(applied(a, ops.set_("/name", "x"), guard=C.gt("/info/age", 10)), "name", "status")
    assert (g[1]["status"], g[3]["status"], g[2]["status"]) == ("ok", "guard_failed", "guard_error") and g[3]["name"] == "cy"
    assert applied(a, ops.set_("/name", "x"), guard=C.gt("/info/age", 10), on_guard_fail="drop").count() == 1
    ro = S.with_tags(USER, {"name": [S.READONLY], "roles": [S.IGNORE]})
    t = by_id(apply.apply_static(a, ops.Patch((ops.set_("/name", "x"), ops.set_("/roles/0", "y"), ops.log("still"))), schema=ro), "name", "roles", "errors", "log")[1]
    assert (t["name"], t["roles"], t["errors"], t["log"]) == ("ann", ["a", "b", "c"], ["/name: field is read-only"], ["still"])
    st = by_id(applied(a, ops.set_("/name", "x", old="ann"), ops.remove("/score/zz", old=1), strict=True), "name", "errors")
    assert st[1]["name"] == "x" and st[2]["name"] is None and len(st[1]["errors"]) == 1 and len(st[2]["errors"]) == 2
    z = by_id(applied(a, ops.remove("/name"), ops.remove("/info/age"), zero_values=True), "name", "info")[1]
    assert z["name"] == "" and z["info"]["age"] == 0
    veto = by_id(applied(a, ops.set_("/name", "new"), resolver=lambda path, kind, now, new: F.coalesce(now, new)), "name")
    assert veto[1]["name"] == "ann" and veto[2]["name"] == "new"


def test_builder():
    p = ops.Edit(USER).with_(ops.set_("/name", "x"), ops.move("/name", "/info/addr")).log("m").guard(C.exists("/name")).guard(C.eq("/id", 1)).build()
    assert p.guard.op == "and" and str(p).splitlines() == ["Replace /name: null -> x", "Move /name to /info/addr", "Log /: m"]
    assert str(ops.Patch()) == "No changes." and ops.Patch().is_empty()
    r = ops.Patch((ops.add("/a", 1), ops.set_("/b", 2, old=3), ops.remove("/c", old=4), ops.move("/d", "/e"), ops.copy("/f", "/g"), ops.log("x"))).reverse()
    assert [(o.kind, o.path, o.old, o.new, o.from_path) for o in r.ops] == [("remove", "/g", None, None, None), ("move", "/d", None, None, "/e"), ("add", "/c", None, 4, None), ("replace", "/b", 2, 3, None), ("remove", "/a", 1, None, None)]
    with pytest.raises(P.PathError):
        ops.Edit(USER).with_(ops.set_("/nope", 1))


def test_conditions():
    c = C.and_(C.ne("/a", 1), C.or_(C.ge("/b", 2), C.in_("/c", ["x"])), C.not_(C.matches("/d", "^q")), C.exists("/e"), C.type_is("/f", "null"))
    assert C.from_predicate(c.to_json()) == c
    for bad in (lambda: C.Condition("not"), lambda: C.matches("/a", "(?=x)"), lambda: C.matches("/a", r"(a)\1"), lambda: C.Condition("in", "/a", 3), lambda: C.from_predicate({"op": "what"})):
        with pytest.raises(ValueError):
            bad()


def test_condition_values(ab):
    a, _ = ab
    find = apply.State(USER).find
    told = lambda c: [r[0] for r in a.orderBy("id").select(C.compile_condition(c, find)).collect()]
    assert told(C.gt("/info/age", 29.5)) == [True, None, False, None]
    assert told(C.eq("/score/k", 1)) == [True, False, False, False] and told(C.ne("/score/k", 1)) == [False, True, True, True]
    assert told(C.exists("/tasks/t1")) == [True, False, False, False] and told(C.eq("/tasks/t1/Status", "open"))[0] is True
    assert told(C.eq("/score", {"k": 1, "a/b": 2})) == [True, None, False, None] and told(C.eq("/roles", ["a", "b", "c"]))[0] is True
    assert told(C.gt("/score", 1)) == [None] * 4 and told(C.eq("/nope", 1)) == [None] * 4 and told(C.exists("/nope")) == [False] * 4
    assert told(C.eq("/name", None)) == [False, True, False, False]


def test_moves(spark):
    a = spark.createDataFrame([(1, "v", None, None), (2, "s", None, "k")], "id long, p string, q string, r string")
    b = spark.createDataFrame([(1, None, "v", None), (2, "s", "s", None)], "id long, p string, q string, r string")
    got = {(r["id"], r["kind"], r["from_path"], r["path"]) for r in moves.detect_moves(a, b, ["id"]).collect()}
    assert got == {(1, "move", "/p", "/q"), (2, "copy", "/p", "/q")}
    folded = moves.fold_moves(diff.diff(a, b, ["id"]), moves.detect_moves(a, b, ["id"]), ["id"]).collect()
    assert {(r["id"], r["kind"], r["path"], r["from_path"]) for r in folded} == {(1, "move", "/q", "/p"), (2, "copy", "/q", "/p"), (2, "remove", "/r", None)}
    done = apply.apply_table(a, spark.createDataFrame(folded, "id long, seq int, kind string, path string, from_path string, old string, new string"), ["id"])
    assert diff.diff(done.select(*b.columns), b, ["id"]).count() == 0


def test_merge(spark):
    cols = "id long, seq int, kind string, path string, old string, new string"
    x = spark.createDataFrame([(1, 0, "replace", "/a", "1", "2"), (1, 1, "replace", "/a", "2", "3"), (1, 2, "add", "/b", None, "5")], cols)
    y = spark.createDataFrame([(1, 0, "replace", "/a", "1", "7"), (1, 1, "replace", "/a", "7", "8"), (2, 0, "remove", "/c", "1", None)], cols)
    got = [(r["id"], r["seq"], r["kind"], r["path"], r["new"]) for r in merge.merge_tables(x, y, ["id"]).orderBy("id", "seq").collect()]
    assert got == [(1, 0, "replace", "/a", "8"), (1, 1, "add", "/b", "5"), (2, 0, "remove", "/c", None)]
    one = {r["path"]: r["new"] for r in merge.merge_tables(x, y, ["id"], merge.local_wins).collect()}
    assert one["/a"] == "2"


def test_three_way_by_fields(spark):
    """Tables of single values take one aggregate; the rows are those of the patches merged and applied."""
    rng = random.Random(7)
    some = lambda: rng.choice([None, 1.0, 2.0, float("nan")])
    a = {k: (some(), rng.choice("xyz")) for k in range(60)}
    sides = []
    for _ in range(2):
        rows = {k: v if rng.random() < 0.5 else (some(), rng.choice("xyz")) for k, v in a.items() if rng.random() < 0.9}
        sides.append(rows | {k: (some(), "new") for k in range(60, 70) if rng.random() < 0.5})
    frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], "id long, n double, s string")
    base, mine, theirs = frame(a), frame(sides[0]), frame(sides[1])
    merged = merge.merge_tables(diff.diff(base, mine, ["id"]), diff.diff(base, theirs, ["id"]), ["id"])
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(merge.three_way(base, mine, theirs, ["id"])) == shown(apply.apply_table(base, merged, ["id"]))


def test_wire_formats(spark):
    p = ops.Patch((ops.set_("/a", {"x": [1, "é"]}, old=None), ops.add("/b", "t").when(C.eq("/a", 1)), ops.remove("/c", old=2).except_when(C.exists("/d")), ops.move("/e", "/f"), ops.copy("/g", "/h"), ops.log("m")), C.gt("/n", 1), True)
    assert codec.from_native(codec.to_native(p)) == p
    j = codec.from_json_patch(codec.to_json_patch(p))
    assert j.guard == p.guard and [o.kind for o in j.ops] == [o.kind for o in p.ops] and codec.to_json_patch(ops.Patch()) == "[]"
    rows = p.to_table(spark).withColumn("id", F.lit(1))
    for write, read in ((codec.table_to_native, codec.native_to_table), (codec.table_to_json_patch, codec.json_patch_to_table)):
        back = read(write(rows, ["id"]), ["id"]).orderBy("seq").collect()
        assert [(r["kind"], r["path"], r["from_path"], r["new"] and json.loads(r["new"])) for r in back] == [(o.kind, o.path, o.from_path, o.new) for o in p.ops]
        assert C.from_predicate(back[1]["if_cond"]) == p.ops[1].if_ and C.from_predicate(back[2]["unless_cond"]) == p.ops[2].unless
    text = write(rows, ["id"]).first()["patch"]
    assert [o.kind for o in codec.from_json_patch(text).ops] == [o.kind for o in p.ops]
    odd = spark.createDataFrame([(1, '[{"op":"test","path":"/x","value":1},{"op":"what","path":"/"},{"op":"add","path":"/v","value":null}]')], "id long, patch string")
    assert [(r["seq"], r["kind"]) for r in codec.json_patch_to_table(odd, ["id"]).collect()] == [(2, "add")]


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id long, v string")
    for fmt in ("parquet", "json", "orc"):
        snapshots.write_snapshot(df, str(tmp_path / fmt), fmt)
        assert canon.table_equal(snapshots.read_snapshot(spark, str(tmp_path / fmt), fmt, df.schema), df)
    with pytest.raises(ValueError):
        snapshots.require_key(df, ["id"])
    snapshots.require_key(df.where("v is not null"), ["id", "v"])


def test_clock(spark):
    c = hlc.Clock("n")
    assert str(c.now(5)) == "5:0:n" and str(c.now(3)) == "5:1:n" and c.reserve(4, 5).l == 2 and c.now(5).l == 6
    assert str(c.update(hlc.Stamp(9, 3, "m"), 1)) == "9:4:n" and c.update(hlc.Stamp(9, 9, "m"), 9).l == 10 and c.update(hlc.Stamp(1, 0, "m"), 20) == hlc.Stamp(20, 0, "n")
    order = [hlc.Stamp(1, 0, "b"), hlc.Stamp(1, 1, "a"), hlc.Stamp(2, 0, "a")]
    df = spark.createDataFrame([(s.w, s.l, s.n) for s in order], "w long, l int, n string").select(hlc.hlc(F.col("w"), F.col("l"), F.col("n")).alias("h"))
    assert df.agg(F.max("h.w")).first()[0] == 2 and [hlc.Stamp(*r[0]) for r in df.orderBy("h").collect()] == order
    calls = [(3, None), (2, hlc.Stamp(5, 7, "m")), (5, hlc.Stamp(5, 2, "m")), (9, None)]
    k = hlc.Clock("n")
    for phys, r in calls:
        k.update(r, phys) if r else k.update(hlc.Stamp(0, 0, ""), phys)
    rows = spark.createDataFrame([(i, p, tuple(r.__dict__.values()) if r else None) for i, (p, r) in enumerate(calls)], "i int, phys long, remote struct<w:long,l:int,n:string>")
    got = rows.agg(F.array_sort(F.collect_list(F.struct("i", "phys", "remote"))).alias("e")).select(hlc.receive(F.col("e"), "n").alias("s")).first()["s"]
    assert (got["w"], got["l"]) == (k.now_.w, k.now_.l)


def test_merges_are_laws(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), rng.choice("xyz"), rng.randint(0, 9), rng.random() < 0.3, (i // 3, i, "n")) for i in range(60)]
    make = lambda r: spark.createDataFrame(r, "id long, k string, v long, deleted boolean, hlc struct<w:long,l:int,n:string>")
    want = sorted(map(str, crdt.lww_map(make(rows), ["id"], "k", "v", "deleted").collect()))
    for _ in range(2):
        mixed = rows + rng.sample(rows, 20)
        rng.shuffle(mixed)
        assert sorted(map(str, crdt.lww_map(make(mixed), ["id"], "k", "v", "deleted").collect())) == want
    state = lambda r: crdt.apply_deltas(make([]).selectExpr("id", "k path", "v value", "hlc write_hlc", "hlc tomb_hlc"), make(r).selectExpr("id", "k path", "if(deleted, 'remove', 'replace') kind", "v new", "hlc"), ["id"])
    shown = lambda df: sorted(map(str, df.collect()))
    x, y = state(rows[:30]), state(rows[30:])
    assert shown(crdt.merge_replicas(x, y, ["id"])) == shown(crdt.merge_replicas(y, x, ["id"])) == shown(state(rows)) == shown(crdt.merge_replicas(state(rows), y, ["id"]))
    v = crdt.view(state(rows), ["id"], ["x", "y"])
    assert v.columns == ["id", "x", "y"]


def common(a, b):
    """Length of the longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(len(b)), lambda left, j, x=x, old=row: old[j] + 1 if x == b[j] else max(left, old[j + 1]), initial=0))
    return row[-1]


def test_edit_scripts(spark):
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        s = edit_script.shortest(a, b)
        assert edit_script.run_script(a, s) == b and len(s) == len(a) + len(b) - 2 * common(a, b)
    far = edit_script.shortest(list(range(700)), list(range(5000, 5700)))
    assert len(far) == 1400 and edit_script.run_script(list(range(700)), far) == list(range(5000, 5700))
    df = spark.createDataFrame([(1, ["a", "b"], ["b", "c"]), (2, None, ["x"]), (3, ["s"], ["s"])], "id long, x array<string>, y array<string>")
    got = {r["id"]: [tuple(e) for e in r["script"]] for r in edit_script.edit_scripts(df, ["id"], "x", "y").collect()}
    assert got == {1: [("remove", 0, "a", None), ("add", 1, None, "c")], 2: [("add", 0, None, "x")], 3: []}
    flat = edit_script.edit_scripts(df, ["id"], "x", "y").select("id", F.posexplode("script").alias("seq", "e")).select("id", "seq", "e.*")
    assert {(r["id"], r["seq"]): r["position"] for r in edit_script.shifted_positions(flat, ["id"], "seq").collect()}[1, 0] == 0


def first_script(a, b):
    """Of the shortest scripts the first, by the table: keeps before removals before additions."""
    n, m, out, i, j = len(a), len(b), [], 0, 0
    left = lambda i, j: n - i + m - j - 2 * common(a[i:], b[j:])
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        elif i < n and left(i + 1, j) < left(i, j):
            out.append(("remove", i, a[i], None))
            i += 1
        else:
            out.append(("add", j, None, b[j]))
            j += 1
    return out


def test_first_of_the_shortest_edit_scripts():
    """Of a run of equal values the first goes, whichever way the search came by it."""
    assert edit_script.shortest(list("ooo"), list("xooy")) == [("remove", 0, "o", None), ("add", 0, None, "x"), ("add", 3, None, "y")]
    assert edit_script.shortest([], []) == [] and edit_script.shortest([None, "o"], ["o"]) == [("remove", 0, None, None)]
    rng = random.Random(7)
    for size in [3, 6, 12, 30] * 60:
        a, b = ([rng.choice("abc"[: 1 + size % 4]) for _ in range(rng.randint(0, size))] for _ in range(2))
        assert edit_script.shortest(a, b) == first_script(a, b)
    for a, b in (([1], list(range(9, 409))), (list(range(300)), list(range(900, 1200)))):
        s = edit_script.shortest(a, b)
        assert s == [("remove", i, v, None) for i, v in enumerate(a)] + [("add", j, None, v) for j, v in enumerate(b)]


def test_edit_positions_of_runs(spark, tmp_path):
    """Lists of one status throughout, also of many orders, beside the SQL."""
    rows = [(1000 * c + i, c, "OFP"[c % 3] if c % 4 else "FO"[i % 2]) for c in range(40) for i in range(1 + c * c % 37)] + [(90000 + i, 90, "O") for i in range(3000)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    name = "edit_script_positions"
    assert harness.compare(spark, harness.connect(tmp_path), catalogue.QUERIES[name], catalogue.ORACLES[name], str(tmp_path)) is None


def test_text_converges():
    rng = random.Random(11)
    sites = {n: [] for n in "abc"}
    clock = itertools.count(1)
    for _ in range(40):
        n = rng.choice("abc")
        length = len(text.render(sites[n]).encode())
        if rng.random() < 0.7 or not length:
            word = bytes(rng.choice(b"xyzuvw") for _ in range(rng.randint(1, 4)))
            sites[n] = text.insert(sites[n], rng.randint(0, length), word, (next(clock), 0, n))
        else:
            sites[n] = text.delete(sites[n], rng.randint(0, length - 1), rng.randint(1, 3))
        if rng.random() < 0.3:
            sites[n] = text.merge(sites[n], sites[rng.choice("abc")])
    shown = {text.render(text.merge(*(sites[n] for n in order))) for order in itertools.permutations("abc")}
    assert len(shown) == 1
    runs = text.insert([], 0, b"held", (1, 0, "a"))
    runs = text.insert(runs, 2, b"--", (2, 0, "b"))
    assert text.render(runs) == "he--ld" and text.render(text.delete(runs, 1, 4)) == "hd"
    early = [text.Run((9, 0, "b"), b"!", (1, 3, "a"), False)]
    assert text.render(early) == "" and text.render(text.merge(early, text.insert([], 0, b"held", (1, 0, "a")))) == "held!"


def test_text_tables(spark):
    z = {"w": 0, "l": 0, "n": ""}
    rows = [(1, {"w": 1, "l": 0, "n": "a"}, "né", z, False), (1, {"w": 2, "l": 0, "n": "b"}, "!", {"w": 1, "l": 2, "n": "a"}, False)]
    runs = spark.createDataFrame(rows, f"id0 long, id struct<w:bigint,l:int,n:string>, v string, p struct<w:bigint,l:int,n:string>, d boolean").withColumnRenamed("id0", "doc")
    assert text.render_text(runs, ["doc"]).first()["text"] == "né!"
    state = text.merge_text(runs, ["doc"])
    edits = spark.createDataFrame([(1, 0, "insert", 1, 0, "ø", {"w": 3, "l": 0, "n": "c"}), (1, 1, "delete", 0, 1, None, None)], "doc long, seq int, kind string, pos int, length int, v string, id struct<w:bigint,l:int,n:string>")
    after = text.edit_text(state, edits, ["doc"]).select("doc", F.explode("runs").alias("r")).select("doc", "r.*")
    assert text.render_text(after, ["doc"]).first()["text"] == "øé!"
    assert text.text_ancestor(T.StructType([T.StructField("Body", runs.select(F.array(F.struct("id", "v", "p", "d"))).schema[0].dataType)]), "/Body/0") == "/Body"


def test_conditional_stream(spark, tmp_path):
    from changeset.streaming import deltas

    deltas.use_state_store(spark)
    rows = [("e", "/n", "replace", "1", None, (1, 0, "a")), ("e", "/n", "replace", "5", C.lt("/n", 3).to_json(), (2, 0, "a")), ("e", "/n", "replace", "9", C.lt("/n", 3).to_json(), (3, 0, "a")), ("e", "/n", "replace", "0", None, (1, 5, "z")), ("e", "/m", "remove", None, None, (4, 0, "a"))]
    kinds = "id string, path string, kind string, new string, if_cond string, hlc struct<w:long,l:int,n:string>"
    for i, part in enumerate((rows[:1], rows[1:4], rows[3:] + rows[:1])):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    seen = {}
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("m", T.LongType())])

    def keep(batch, _):
        for r in batch.collect():
            seen[r["path"]] = (r["new"], r["gone"])

    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    run = deltas.conditional_replicas(stream, "id", schema).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert seen == {"/n": ("5", False), "/m": (None, True)}


def test_text_fields_merge_when_applied(spark):
    kinds = T.StructType([T.StructField("id", T.LongType()), T.StructField("body", T.ArrayType(T.StructType([T.StructField("id", T.StructType([T.StructField("w", T.LongType()), T.StructField("l", T.IntegerType()), T.StructField("n", T.StringType())])), T.StructField("v", T.StringType()), T.StructField("p", T.StructType([T.StructField("w", T.LongType()), T.StructField("l", T.IntegerType()), T.StructField("n", T.StringType())])), T.StructField("d", T.BooleanType())])))])
    base = text.insert([], 0, b"held", (1, 0, "a"))
    mine, theirs = text.insert(base, 0, b"I ", (2, 0, "a")), text.insert(base, 4, b"!", (2, 0, "b"))
    frame = lambda runs: spark.createDataFrame([(1, text.from_runs(runs))], kinds)
    changes = diff.diff(frame(base), frame(theirs), ["id"])
    assert [(r["kind"], r["path"]) for r in changes.collect()] == [("replace", "/body")]
    blocked = changes.withColumn("if_cond", F.lit(C.eq("/id", 99).to_json()))
    done = apply.apply_table_general(frame(mine), blocked, ["id"]).select(F.col("id").alias("doc"), F.explode("body").alias("r")).select("doc", "r.*")
    assert text.render_text(done, ["doc"]).first()["text"] == "I held!"


def test_plain_writes_agree_with_the_fold(spark):
    df = spark.createDataFrame([(1, "a", 1, 1), (2, "b", 2, 2), (3, "c", 3, 3)], "id long, s string, n long, ro long")
    kinds = "id long, seq int, kind string, path string, old string, new string, strict boolean"
    rows = [(1, 0, "replace", "/s", None, '"x"', False), (1, 1, "replace", "/n", None, "7", False), (1, 2, "remove", "/s", None, None, False), (1, 3, "add", "/n", None, '"8"', False), (2, 0, "replace", "/ro", None, "9", False), (2, 1, "replace", "/zz", None, "9", False)]
    schema = S.with_tags(df.schema, {"ro": [S.READONLY]})
    ops_ = spark.createDataFrame(rows, kinds)
    one, two = (sorted(map(tuple, f(df, ops_, ["id"], schema).collect())) for f in (apply.apply_writes, apply.apply_table))
    assert one == two and one[0][:3] == (1, None, 8) and one[1][-1] == ["/ro: field is read-only", "/zz: no such field"]
    odd = apply.apply_writes(df, spark.createDataFrame([(1, 0, "replace", "/s", None, '"x"', True)], kinds), ["id"]).orderBy("id").first()
    assert odd["s"] == "a" and odd["errors"] == ["/s: not a plain write"]


def test_small_helpers(spark):
    assert P.resolve_parent("/a/b~1c") == ("/a", "b/c")
    with pytest.raises(P.PathError):
        P.resolve_parent("/")
    xs = spark.createDataFrame([([("b", "", 1), ("d", "", 2), ("c", "", 3)],)], T.StructType([T.StructField("xs", T.ArrayType(TASK))]))
    kind = T.ArrayType(TASK)
    new = lambda k: F.struct(F.lit(k).alias("ID"), F.lit("n").alias("Status"), F.lit(0).cast("long").alias("Value"))
    keys = lambda e, prev: "".join(r["ID"] for r in xs.select(P.insert_keyed(F.col("xs"), kind, e, prev).alias("o")).first()["o"])
    assert (keys(new("a"), None), keys(new("c1"), F.lit("b")), keys(new("e"), F.lit("b")), keys(new("x"), F.lit("none"))) == ("abdc", "bc1dc", "bdce", "bdcx")
    m = spark.createDataFrame([({"A": 1, "b": 2},)], "m map<string,int>")
    assert m.select(canon.canonical_keys(F.col("m"), F.upper).alias("m")).first()["m"] == {"A": 1, "B": 2}
    got = []
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    apply.deliver_logs(apply.apply_static(df, ops.Patch((ops.log("m"),))), ["id"], lambda k, line: got.append((k, line)))
    assert sorted(got) == [((1,), "m"), ((2,), "m")]


def test_rows_are_inserted_and_deleted(spark):
    """Tables with nested fields round-trip whole through both ways of applying; a deleted row stays deleted."""
    schema = "id long, s string, n double, t timestamp, m map<string,int>, l array<struct<x:int>>"
    a = spark.sql("SELECT id, concat('\"a', id) s, id / 3 n, timestamp'2024-01-02 03:04:05' t, map('k', 1) m, array(named_struct('x', 1)) l FROM range(4)").to(spark.createDataFrame([], schema).schema)
    b = a.where("id > 1").selectExpr("id + 1 id", "s", "n", "t", "m", "l").unionByName(a.where("id = 1"))
    d = diff.diff(a.where("id <> 2"), b, ["id"])
    a = a.where("id <> 2")
    key = lambda df: sorted(map(str, df.select(*a.columns).collect()))
    for f in (apply.apply_writes, apply.apply_table):
        assert key(f(a, d, ["id"])) == key(b)
        assert key(f(b, ops.reverse_table(d, ["id"]), ["id"])) == key(a)
    late = spark.createDataFrame([(0, 0, "remove", "/", None), (0, 1, "add", "/s", '"x"'), (9, 0, "add", "/", '{"s":"new","n":1.5}'), (9, 1, "replace", "/n", "2.5"), (8, 0, "add", "/s", '"x"')], "id long, seq int, kind string, path string, new string")
    for f in (apply.apply_writes, apply.apply_table):
        got = {r["id"]: r for r in f(a, late, ["id"]).collect()}
        assert set(got) == {1, 3, 9} and (got[9]["s"], got[9]["n"], got[9]["status"]) == ("new", 2.5, "ok")


def test_state_segments(spark, tmp_path):
    """Segments are merged level by level; a repeated batch, or one that was cut off after merging, changes nothing."""
    from changeset.streaming import deltas

    kinds = "id long, path string, kind string, new string, hlc struct<w:long,l:int,n:string>"
    rng = random.Random(2)
    write, rows = deltas.upsert_to(str(tmp_path / "s"), ["id"]), []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(deltas, "FAN", 3)
        for batch in range(11):
            new = [(rng.randint(0, 4), rng.choice(["/a", "/b"]), "replace", str(batch), (rng.randint(0, 50), batch, "n")) for _ in range(3)]
            rows += new
            for _ in range(2 if batch in (2, 8) else 1):
                write(spark.createDataFrame(new, kinds), batch)
    left = sorted(p.name for p in (tmp_path / "s").iterdir())
    assert left == ["level0-batch10", "level0-batch9", "level2-batch8"]
    schema = spark.createDataFrame([], kinds).schema
    got = sorted(map(str, deltas.read_state(spark, str(tmp_path / "s"), ["id"], schema).collect()))
    assert got == sorted(map(str, deltas.newest_ops(spark.createDataFrame(rows, kinds), ["id"]).select(*schema.names).collect()))


def test_custom_operations(spark):
    from changeset.operators import custom

    class Twice:
        def apply(self, current):
            return current * 2

        def resolve(self, current, proposed):
            return F.least(proposed, F.lit(7))

        def to_json(self):
            return {"times": 2}

    p = ops.Patch((custom.custom("/n", Twice()),))
    df = spark.createDataFrame([(1, 3), (2, 5)], "id long, n long")
    assert {r["id"]: r["n"] for r in apply.apply_static(df, p).collect()} == {1: 6, 2: 7}
    assert str(p) == "Custom /n" and json.loads(codec.to_json_patch(p)) == [{"op": "custom", "path": "/n", "value": {"times": 2}}]
    with pytest.raises(ValueError):
        p.reverse()
    with pytest.raises(ValueError):
        p.to_table(spark)
