"""Exact substring deduplication by super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, checked_keep, chunks, digest, gram_hashes, materialize, partitions, release

#: Words of a window and of a minimiser.
WINDOW, GRAM = 35, 8
#: Most different strings that meet in one bucket. Those of a minimiser that has more are cut again by longer minimisers.
BUCKET = 500

SPANS = "array<struct<first:int,count:int>>"


def lengths_of(window: int, gram: int) -> list[int]:
    """Words of the minimisers, cut by cut. The last are whole windows, so that all strings of one are equal."""
    return sorted({gram, window - (window - gram) // 3, window})


def _least_places(g: np.ndarray, w: int) -> np.ndarray:
    """For each start, the place of the (leftmost) least of w consecutive entries; by doubling."""
    best = np.arange(len(g))
    span = 1
    while span < w:
        step = min(span, w - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        span += step
    return best


def super_kmers(h: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, start (word of the document), windows, minimiser of each run of consecutive windows whose least
    gram is the same one. h: hashes of the words of all documents; at: their offsets."""
    none = np.empty(0, np.int64)
    counts = np.maximum(np.diff(at) - window + 1, 0)
    if not counts.sum():
        return none, none, none, none
    g = gram_hashes(h, gram)
    least = _least_places(g, window - gram + 1)  # of a window by its start
    doc_of = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(doc_of)) - np.repeat(np.cumsum(counts) - counts, counts)  # within the document
    place = least[at[:-1][doc_of] + start]
    new = np.ones(len(doc_of), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc_of[1:] != doc_of[:-1])
    begins = np.flatnonzero(new)
    return doc_of[begins], start[begins], np.diff(np.append(begins, len(doc_of))), g[place[begins]].view(np.int64)


def covered_words(n: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of n words lie in a window of the spans (first start, number of starts)."""
    edge = np.zeros(n + 1, np.int64)
    first, count = np.array(spans, np.int64).reshape(-1, 2).T
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + count - 1 + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    """Ascending starts as (first, number of consecutive ones)."""
    s = np.asarray(starts)
    begins = np.flatnonzero(np.diff(s, prepend=s[0] - 2) != 1)
    return list(zip(s[begins].tolist(), np.diff(np.append(begins, len(s))).tolist(), strict=True))


def repeated_windows(pieces: DataFrame, window: int = WINDOW, lengths: list[int] | None = None, bucket: int = BUCKET) -> DataFrame:
    """id, spans: of each piece, the words at which windows start that also start anywhere else, as (first, count).

    pieces: id, text; all different texts. Their windows are cut into super-k-mers, each a packed string with
    its digest. A minimiser that starts one super-k-mer only is done: no window of it repeats. Strings that
    stand at several places repeat with all their windows, and one of them is enough for comparing them with
    others, so however often a passage occurs, one string of it travels. Where a minimiser has several different
    strings, they go to its bucket, whose windows are sorted and equal neighbours found. A minimiser with more
    than `bucket` different strings has them cut again, in the same way, by longer minimisers: what
    surrounds a frequent passage then mostly falls to minimisers of its own.
    """
    gram, *longer = lengths_of(window, GRAM) if lengths is None else lengths

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            words = Words(texts)
            doc, start, count, least = super_kmers(words.hashes, words.offsets, window, gram)
            joined, at = words.joined()
            first = words.offsets[doc] + start
            digests = [xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(at[first].tolist(), (at[first + count + window - 1] - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(least), batch.column("id").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(digests, pa.binary())], ["least", "id", "first", "count", "sd"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            words = Words(texts)
            joined, at = words.joined()
            rows = []
            for offset, wanted in zip(words.offsets.tolist(), batch.column("wanted").to_pylist(), strict=False):
                for x in wanted:
                    i = offset + x["first"]
                    rows.append((x["least"], x["crowded"], x["sd"], joined[at[i] : at[i + x["count"] + window - 1] - 1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], ["least", "crowded", "id", "text"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimiser; a bucket has at most `bucket` of them."""
        name, strings = None, []

        def done() -> pa.RecordBatch:
            found: list[tuple[bytes, int, int]] = []
            for k, (_, string) in enumerate(strings):
                ends = [i for i, b in enumerate(string) if b == 32]
                begins = [0, *(e + 1 for e in ends)]
                ends.append(len(string))
                found += [(string[begins[i] : ends[i + window - 1]], k, i) for i in range(len(begins) - window + 1)]
            found.sort()
            starts: dict[int, list[int]] = {}
            for j, (text, k, i) in enumerate(found):
                if j and text == found[j - 1][0] or j + 1 < len(found) and text == found[j + 1][0]:
                    starts.setdefault(k, []).append(i)
            spans = [[{"first": a, "count": b} for a, b in _runs(sorted(s))] for s in starts.values()]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([strings[k][0] for k in starts], pa.binary()), pa.array(spans, kind)], ["id", "spans"])

        for batch in batches:
            for least, sd, string in zip(*(batch.column(c).to_pylist() for c in ("least", "id", "text")), strict=True):
                if least != name:
                    if len(strings) > 1:
                        yield done()
                    name, strings = least, []
                strings.append((sd, string))
        if len(strings) > 1:
            yield done()

    where = materialize(arrow_map(pieces.select("id", "text"), minimisers, "least long, id binary, first int, count int, sd binary"), "minimisers")
    again = materialize(where.groupBy("least").agg(F.count("*").alias("c")).where("c > 1").select("least"), "repeated")
    shared = materialize(where.join(again, "least"), "minimisers")
    release(where, again)
    # One row for each different string, with one of its places; counted before the shuffle.
    kinds = materialize(shared.groupBy("least", "sd").agg(F.count("*").alias("c"), F.min("id").alias("id"), F.min_by("first", F.struct("id", "first")).alias("first"), F.first("count").alias("count")), "kinds")
    mixed = materialize(kinds.groupBy("least").agg(F.count("*").alias("kinds")).where("kinds > 1").select("least", (F.col("kinds") > bucket).alias("crowded")), "mixed")
    wanted = kinds.join(mixed, "least").groupBy("id").agg(F.collect_list(F.struct("first", "count", "least", "crowded", "sd")).alias("wanted"))
    strings = materialize(arrow_map(pieces.select("id", "text").join(wanted, "id"), packed, "least long, crowded boolean, id binary, text binary"), "strings")
    some = arrow_map(strings.where("not crowded").select("least", "id", "text").repartition(partitions(pieces.sparkSession), "least").sortWithinPartitions("least"), counted, f"id binary, spans {SPANS}")
    crowd = strings.where("crowded").select("id", "text")
    if longer and not crowd.isEmpty():
        some = some.unionByName(repeated_windows(crowd, window, longer, bucket))
    some = materialize(some, "spans")
    release(strings, mixed)
    # A string of one place has the windows found, at that place; one of several has all its windows, at each.
    once = kinds.where("c = 1").select("sd", F.col("id").alias("piece"), F.col("first").alias("at")).join(some, F.col("sd") == some["id"])
    once = once.select(F.col("piece").alias("id"), F.transform("spans", lambda x: F.struct((x["first"] + F.col("at")).alias("first"), x["count"].alias("count"))).alias("spans"))
    often = shared.join(kinds.where("c > 1").select("sd"), "sd").select("id", F.array(F.struct("first", "count")).alias("spans"))
    # A piece has fewer super-k-mers than words, so its spans are a bounded list.
    return once.unionByName(often).groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def dedup_substrings(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, gram: int = GRAM, bucket: int = BUCKET, text: bool = True) -> DataFrame:
    """Removes each word that a window covers whose words also start anywhere else, the same document included.

    docs: doc_id, text and the columns of keep, which are handed on. Windows are judged on the input.
    Returns doc_id, *keep, n_words, n_removed, kept_sha256 (of the kept words joined by one blank) and, with
    text, text_left: the text itself if nothing is removed, else the kept words joined by one blank.
    Null and empty texts have no words; texts of under `window` words keep all; all copies of a
    longer text that occurs again lose all its words. Very long texts are judged whole. A null doc_id is handed on;
    repeated rows count as other documents. Other columns of docs play no part, whatever their names; a name in keep that is also
    one of the result's is an error. Empty table: no rows.
    """
    keep = checked_keep(keep, ["doc_id", "n_words", "n_removed", "kept_sha256", "text_left"])
    own = docs.select(F.struct("doc_id", *keep).alias("row"), digest(F.col("text")).alias("td"))
    texts = docs.select(digest(F.col("text")).alias("id"), F.coalesce("text", F.lit("")).alias("text")).groupBy("id").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    marks = repeated_windows(texts, window, lengths_of(window, gram), bucket)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs_ in chunks(batches):
            rows = []
            for data, copies, spans in zip(docs_, batch.column("copies").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = data.split()
                n = len(words)
                left = words
                if n >= window and copies > 1:
                    left = []
                elif spans:
                    left = [w for w, c in zip(words, covered_words(n, [(x["first"], x["count"]) for x in spans], window).tolist(), strict=True) if not c]
                joined = b" ".join(left)
                rows.append((n, n - len(left), hashlib.sha256(joined).hexdigest(), (data if len(left) == n else joined) if text else b""))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made[:3], made[3].cast(pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "text_left"])

    done = arrow_map(texts.join(marks, "id", "left").select("id", "text", "copies", "spans"), cut, "id binary, n_words long, n_removed long, kept_sha256 string, text_left string")
    out = own.join(done, F.col("td") == F.col("id"))
    return out.select("row.*", "n_words", "n_removed", "kept_sha256", *(["text_left"] if text else []))
