"""Laws over generated values; none of these needs a session."""

from hypothesis import given, settings
from hypothesis import strategies as st

from changeset.functions import conditions as C
from changeset.functions import hlc
from changeset.functions import paths as P
from changeset.operators import edit_script, ops, text
from changeset.sources import codec

tokens = st.lists(st.text(st.characters(codec="utf-8"), min_size=1, max_size=6), min_size=1, max_size=4)
scalars = st.one_of(st.integers(-5, 5), st.text(max_size=4), st.booleans())
paths = tokens.map(P.join)
leaves = st.one_of(
    st.builds(lambda f, p, v: f(p, v), st.sampled_from([C.eq, C.ne, C.gt, C.ge, C.lt, C.le]), paths, scalars),
    st.builds(C.exists, paths),
    st.builds(C.in_, paths, st.lists(scalars, max_size=3)),
    st.builds(C.type_is, paths, st.sampled_from(C.TYPES)),
)
trees = st.recursive(leaves, lambda sub: st.one_of(st.builds(C.and_, sub, sub), st.builds(C.or_, sub, sub), st.builds(lambda s: C.not_(s) if s.op != "==" else s, sub)), max_leaves=6)


@given(tokens)
def test_pointers_round_trip(ts):
    assert P.parse(P.join(ts)) == tuple(ts)


@given(trees)
def test_predicates_round_trip(c):
    assert C.from_predicate(c.to_json()) == c


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_scripts_are_short_and_right(a, b):
    s = edit_script.shortest(a, b)
    assert edit_script.run_script(a, s) == b and len(s) <= len(a) + len(b)
    assert len(edit_script.shortest(b, a)) == len(s)


op = st.one_of(
    st.builds(lambda p, o, n: ops.set_(p, n, old=o), paths, scalars, scalars), st.builds(ops.add, paths, scalars), st.builds(lambda p, o: ops.remove(p, old=o), paths, scalars), st.builds(ops.move, paths, paths), st.builds(ops.copy, paths, paths), st.builds(ops.log, st.text(max_size=5))
)


@given(st.lists(op, max_size=5), st.one_of(st.none(), trees), st.booleans())
def test_native_patches_round_trip(todo, guard, strict):
    p = ops.Patch(tuple(todo), guard, strict)
    assert codec.from_native(codec.to_native(p)) == p


@given(st.lists(st.one_of(st.builds(lambda p, o, n: ops.set_(p, n, old=o), paths, scalars, scalars), st.builds(ops.add, paths, scalars), st.builds(ops.move, paths, paths)), max_size=5))
def test_reversing_twice_changes_nothing(todo):
    p = ops.Patch(tuple(todo))
    assert p.reverse().reverse() == p


@given(st.lists(st.tuples(st.integers(0, 20), st.one_of(st.none(), st.tuples(st.integers(0, 20), st.integers(0, 5)))), max_size=20))
def test_clocks_only_go_forward(events):
    c, last = hlc.Clock("n"), hlc.Stamp()
    for phys, remote in events:
        now = c.now(phys) if remote is None else c.update(hlc.Stamp(*remote, "m"), phys)
        assert now >= hlc.Stamp(last.w, last.l, "") and (remote is None or (now.w, now.l) > remote)
        last = now


edits = st.lists(st.tuples(st.sampled_from("ab"), st.booleans(), st.integers(0, 12), st.text("xyz", min_size=1, max_size=3)), max_size=12)


@settings(max_examples=60)
@given(edits, st.integers(0, 2))
def test_text_merges_converge(todo, every):
    sites: dict[str, list] = {"a": [], "b": []}
    for k, (site, is_insert, pos, word) in enumerate(todo):
        n = len(text.render(sites[site]))
        if is_insert or not n:
            sites[site] = text.insert(sites[site], min(pos, n), word.encode(), (k + 1, 0, site))
        else:
            sites[site] = text.delete(sites[site], pos % n, len(word))
        if every and k % (every + 1) == 0:
            sites["a"] = text.merge(sites["a"], sites["b"])
    one, two = text.merge(sites["a"], sites["b"]), text.merge(sites["b"], sites["a"])
    assert text.render(one) == text.render(two) == text.render(text.merge(one, two)) == text.render(text.merge(one, sites["a"]))
