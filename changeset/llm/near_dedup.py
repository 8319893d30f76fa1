"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, chunks, digest, gram_hashes, materialize
from .graph import connected_components

#: Words of a shingle.
SHINGLE = 5
#: Hashes a sketch retains.
KEEP = 40
#: The estimate from 40 hashes deviates by 0.063 at 0.8; a pair is passed on from five and a half deviations below.
SLACK = 0.35
#: Members of a list are estimated in blocks of about so many, and compared in blocks of about so many hashes.
BLOCK_MEMBERS, BLOCK_HASHES = 400, 1 << 17
#: Rounds in which the members of a list are compared with one of them, before any two are.
STARS = 2


def _shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    words = Words([t.lower() for t in texts])
    h, at = words.hashes, words.offsets
    grams = gram_hashes(h, size).view(np.int64)
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), int(b - a))], np.uint64).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, td, n (shingles), sd (digest of the set), sketch (its smallest KEEP hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = list(_shingle_sets(texts, size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("td"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s[:KEEP] for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "td", "n", "sd", "sketch"],
            )

    own = docs.select("doc_id", digest(F.col("text")).alias("td"), "text")
    return arrow_map(own, run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, td binary, n long, sd binary, sketch array<long>")


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """sd, items: the whole set of each of the nodes (sd, td), computed from one of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            sets = [s.tobytes() for s in _shingle_sets(texts, size)]
            yield pa.RecordBatch.from_arrays([batch.column("sd"), pa.array(sets, pa.binary())], ["sd", "items"])

    texts = docs.select(digest(F.col("text")).alias("td"), "text")
    return arrow_map(texts.join(nodes.select("td", "sd"), "td").select("sd", "text"), run, "sd binary, items binary").groupBy("sd").agg(F.first("items").alias("items"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of at least 80 shared shingles among 100 of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= 80 * (len(p) + len(q) - shared))
            keep = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column("a"), keep.column("b")], ["a", "b"])

    x, y = sets.select(F.col("sd").alias("a"), F.col("items").alias("x")), sets.select(F.col("sd").alias("b"), F.col("items").alias("y"))
    return arrow_map(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y"), run, "a binary, b binary")


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sizes and union sketch allow the similarity; est is the share of the union's smallest hashes that both have."""
    a = nodes.select(F.col("sd").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = nodes.select(F.col("sd").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    met = pairs.join(a, "a").join(b, "b").where("100 * least(na, nb) >= 80 * greatest(na, nb)")
    met = met.withColumn("u", F.slice(F.array_sort(F.array_union("ka", "kb")), 1, KEEP))
    est = F.size(F.array_intersect(F.array_intersect("u", "ka"), "kb")) / F.size("u")
    return met.withColumn("est", est).where(F.col("est") >= 0.8 - SLACK).select("a", "b", "est")


def _estimates(own: np.ndarray, theirs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The estimate that _estimated makes, of one sketch with each row of theirs (sketches of given sizes, filled up)."""
    right = np.searchsorted(own, theirs, "right")
    at = np.arange(theirs.shape[1])
    both = (right > 0) & (own[np.maximum(right - 1, 0)] == theirs) & (at < sizes[:, None])
    common = np.cumsum(both, axis=1)
    seen = (both & (right + at + 1 - common <= KEEP)).sum(1)  # by its rank in the union
    return seen / np.minimum(KEEP, len(own) + sizes - common[:, -1])


def _near_members(key: int, mine: dict, theirs: dict) -> set[bytes]:
    """Members of two blocks of one list that have a partner in the other: of another component, with a size and an estimate that
    allow the similarity, and met here and in no other list, as this key is the smallest of those that both are listed under."""
    out: set[bytes] = set()
    for k, (sd, comp, n) in enumerate(zip(mine["sd"], mine["comp"], mine["n"], strict=True)):
        fits = (theirs["comp"] != comp) & (100 * np.minimum(theirs["n"], n) >= 80 * np.maximum(theirs["n"], n))
        if not fits.any():
            continue
        at = np.flatnonzero(fits)
        keys = theirs["keys"][at]
        both = np.isin(keys, mine["keys"][k][: mine["n_keys"][k]]) & (np.arange(keys.shape[1]) < theirs["n_keys"][at][:, None])
        at = at[keys[np.arange(len(at)), both.argmax(1)] == key]
        if len(at):
            at = at[_estimates(mine["sketch"][k][: mine["short"][k]], theirs["sketch"][at], theirs["short"][at]) >= 0.8 - SLACK]
        if len(at):
            out.add(sd)
            out.update(theirs["sd"][j] for j in at.tolist())
    return out


def _block_of(rows: list[dict]) -> dict:
    """Members of a block (sd, comp, n, sketch, keys), column by column; comp by a hash, keys ascending."""

    def table(name: str) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(r[name]) for r in rows])
        out = np.zeros((len(rows), max(int(sizes.max()), 1)), np.int64)
        for i, r in enumerate(rows):
            out[i, : sizes[i]] = np.sort(r[name]) if name == "keys" else r[name]
        return out, sizes

    sketch, short = table("sketch")
    keys, n_keys = table("keys")
    comp = np.array([xxhash.xxh3_64_intdigest(r["comp"]) for r in rows], np.uint64)
    return {"sd": [r["sd"] for r in rows], "comp": comp, "n": np.array([r["n"] for r in rows]), "sketch": sketch, "short": short, "keys": keys, "n_keys": n_keys}


def _linked(mine: list[tuple[bytes, bytes, np.ndarray]], theirs: list[tuple[bytes, bytes, np.ndarray]]) -> list[tuple[bytes, bytes]]:
    """Of the links between two blocks of sets (name, component, hashes), as many as join what they join: at most one
    less than there are sets."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes = np.array([len(v) for _, _, v in theirs])
    values = np.concatenate([v for _, _, v in theirs])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(theirs)), sizes)[order]
    out = []
    for name, comp, own in mine:
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(owner[at], minlength=len(theirs))
        for j in np.flatnonzero(100 * shared >= 80 * (len(own) + sizes - shared)).tolist():
            x, y = root(comp), root(theirs[j][1])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((name, theirs[j][0]))
    return out


def _in_blocks(members: DataFrame, lists: DataFrame, fields: list[str]) -> DataFrame:
    """key, i, j, x, y for each two blocks of a list (key, blocks): the members (key, sd and fields) dealt into blocks of bounded size."""
    dealt = members.join(lists, "key").withColumn("i", F.pmod(F.xxhash64("sd"), F.col("blocks")).cast("int"))
    blocks = materialize(dealt.groupBy("key", "blocks", "i").agg(F.collect_list(F.struct("sd", *fields)).alias("x")), "blocks")
    left = blocks.select("key", "i", "x", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    return left.join(blocks.select("key", F.col("i").alias("j"), F.col("x").alias("y")), ["key", "j"]).select("key", "i", "j", "x", "y")


def _block_links(now: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of one list (key, sd, n, comp) that lie in different components. A list's members are dealt
    into blocks of bounded size, and each two blocks of one list are one row. Sizes and union sketches first tell which
    members have a partner; those are then compared on full sets."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "x", "y")), strict=True):
                block = _block_of(x)
                found = sorted(_near_members(key, block, block if i == j else _block_of(y)))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found, pa.binary())], ["key", "sd"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "x", "y")), strict=True):
                blocks = [[(d["sd"], d["comp"], np.frombuffer(d["items"], np.int64)) for d in side] for side in (x, y)]
                found = _linked(blocks[0], blocks[0] if i == j else blocks[1])
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    # Two members have met already: one of them was the other's centre.
    lists = now.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("p"), F.max("comp").alias("q"), F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    lists = materialize(lists.where("c > 2 and p <> q").select("key", "blocks"), "lists")
    keys = now.groupBy("sd").agg(F.collect_list("key").alias("keys"))  # at most KEEP
    members = now.join(lists.select("key"), "key", "left_semi").join(keys.join(nodes.select("sd", "sketch"), "sd"), "sd")
    near = materialize(arrow_map(_in_blocks(members, lists, ["comp", "n", "sketch", "keys"]), estimate, "key long, sd binary").distinct(), "near")
    some = materialize(now.join(near, ["key", "sd"]), "near")
    lists = materialize(some.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_HASHES).cast("int").alias("blocks")), "lists")
    return arrow_map(_in_blocks(some.join(sets, "sd"), lists, ["comp", "items"]), compare, "a binary, b binary").distinct()


def _inverted(nodes: DataFrame) -> DataFrame:
    """key, sd, n: the inverted lists of retained values, of each set its rarest ones.

    Two sets of similarity 0.8 share at least `need` retained values: all of small sets are retained, so four fifths of
    them; of larger sets the estimate decides, so its least share of KEEP. Of these the rarest one, by number of sets and
    then by value, is among the first `kept - need + 1` of either set, and only those are listed. What stands in very
    many sets, as a common line does, is listed only for sets that consist of such values for the most part.
    """
    kept = F.least("n", F.lit(KEEP))
    need = F.when(F.ceil(F.col("n") / F.lit(0.8)) <= KEEP, F.ceil(F.col("n") * F.lit(0.8) - 1e-9)).otherwise(F.ceil(F.lit(KEEP * (0.8 - SLACK) - 1e-9))).cast("int")
    rows = nodes.where("n >= 4").select("sd", "n", F.explode("sketch").alias("key"))
    counts = materialize(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    ranked = rows.join(counts, "key").groupBy("sd", "n").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("ranked"))  # at most KEEP
    first = F.slice("ranked", F.lit(1), F.greatest(F.size("ranked") - need + 1, F.lit(0)))
    lists = materialize(ranked.select("sd", "n", F.explode(first.getField("key")).alias("key")), "lists")
    again = materialize(lists.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "counts")
    return materialize(lists.join(again, "key"), "lists")


def classes(docs: DataFrame, size: int = SHINGLE, texts: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    docs: doc_id, text. Documents with one shingle set are one class, represented once, so copies are
    never paired. Inverted lists of retained values say which classes overlap. The members of a list are first
    compared with its centre, twice; then any two of a list that still lie in different components are, in blocks.
    Union sketches choose the pairs and all links are confirmed on full sets. Null and empty texts have no
    shingles and are linked with nothing, each its own component. Very long texts count whole. A null doc_id has its group's
    smallest id, or none; repeated rows are alike. Other columns play no part. Empty table: no rows. texts: adds td (the text's
    digest) and root (which names the group), for tables that repeat an id with other texts.
    """
    sig = materialize(signatures(docs, size), "sketches")
    every = materialize(sig.where("n > 0").groupBy("sd").agg(F.min("td").alias("td"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    lists = _inverted(every)
    nodes = materialize(every.join(lists.select("sd").distinct(), "sd", "left_semi"), "nodes")
    comps = None
    if not nodes.isEmpty():
        sets = materialize(_sets_of(docs, nodes, size), "sets")
        links = None
        for step in range(STARS + 1):
            now = lists.withColumn("comp", F.col("sd")) if comps is None else lists.join(comps, lists["sd"] == comps["node"], "left").select("key", "sd", "n", F.coalesce("root", "sd").alias("comp"))
            if step < STARS:
                place = F.xxhash64("sd", F.lit(step))
                centre = materialize(now.groupBy("key").agg(F.min(F.struct(place.alias("place"), "sd", "comp")).alias("m")).select("key", F.col("m.sd").alias("a"), F.col("m.comp").alias("ca")), "centres")
                pairs = centre.join(now.select("key", F.col("sd").alias("b"), F.col("comp").alias("cb")), "key").where("ca <> cb")
                found = _verified(materialize(_estimated(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes), "pairs"), sets)
            else:
                found = _block_links(now, nodes, sets)
            links = materialize(found if links is None else links.unionByName(found), "links")
            comps = connected_components(links)
    more = ["td", "root"] if texts else []
    grouped = sig.where("n > 0").select("doc_id", "td", "n", "sd")
    rooted = grouped.withColumn("root", F.col("sd")) if comps is None else grouped.join(comps, grouped["sd"] == comps["node"], "left").select("doc_id", "td", "n", F.coalesce("root", "sd").alias("root"))
    first = materialize(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    alone = sig.where("n = 0").withColumn("root", F.col("td")).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more)
    out = rooted.join(first, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
