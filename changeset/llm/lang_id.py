"""Language identification by a byte convolutional network, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTER, arrow_map, chunks, materialize

#: Bytes of a window, of the widest filter, numbers of an embedded byte, filters of each width.
WINDOW, WIDTHS, WIDE, EMBED, FILTERS = 256, (2, 3, 4), 4, 8, 10
#: The bounded sample of labelled rows: documents of each language, windows of a document, documents in all.
DOCS_PER_LANG, WINDOWS_PER_DOC, MOST_DOCS = 400, 3, 40_000
EPOCHS, BATCH, RATE = 14, 64, 4e-3
#: A-Z as a-z, digits as one; the rest as it is. 0 pads.
FOLD = np.array([b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)
#: Windows put through the network at once.
AT_ONCE = 128


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text, the last one padded; at least one."""
    n = max(1, -(-len(text) // WINDOW))
    return FOLD[np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8)].reshape(n, WINDOW)


@dataclass
class ByteNet:
    """embed 256 x EMBED, kernel (WIDE * EMBED) x filters (narrow ones zero beyond their width), out filters x languages."""

    langs: list[str]
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(langs: list[str], rng: np.random.Generator) -> ByteNet:
        n = FILTERS * len(WIDTHS)
        draw = lambda s, *shape: (rng.standard_normal(shape) * s).astype(np.float32)
        return ByteNet(langs, draw(0.5, 256, EMBED), draw(0.25, WIDE * EMBED, n) * mask(), np.zeros(n, np.float32), draw(0.2, n, len(langs)), np.zeros(len(langs), np.float32))

    def features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window and where it is; below 0 counts as 0."""
        e = self.embed[x]  # windows x WINDOW x EMBED
        s = e.strides
        places = WINDOW - WIDE + 1
        patches = np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (len(x), places, WIDE * EMBED), (s[0], s[1], s[2])))
        y = patches.reshape(-1, WIDE * EMBED) @ self.kernel
        y = y.reshape(len(x), places, -1)
        return y, patches

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(x), AT_ONCE):
            y, _ = self.features(x[i : i + AT_ONCE])
            parts.append(np.maximum(y.max(1) + self.bias, 0) @ self.out + self.out_bias)
        z = np.concatenate(parts)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


    def gradients(self, x: np.ndarray, t: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of weight times the cross-entropy of windows x whose languages are t."""
        y, patches = self.features(x)
        rows, at = np.arange(len(x)), y.argmax(1)  # windows x filters
        raw = np.take_along_axis(y, at[:, None], 1)[:, 0] + self.bias
        f = np.maximum(raw, 0)
        z = f @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[rows, t] -= 1
        p *= weight[:, None]
        df = (p @ self.out.T) * (raw > 0)
        best = patches[rows[:, None], at]  # windows x filters x (WIDE * EMBED)
        dpatch = (df[:, :, None] * self.kernel.T).reshape(len(x), -1, WIDE, EMBED)
        dembed = np.zeros_like(self.embed)
        for j in range(WIDE):
            np.add.at(dembed, x[rows[:, None], at + j].ravel(), dpatch[:, :, j].reshape(-1, EMBED))
        return {"embed": dembed, "kernel": np.einsum("nfk,nf->kf", best, df), "bias": df.sum(0), "out": f.T @ p, "out_bias": p.sum(0)}


def mask() -> np.ndarray:
    """Zero where a filter is narrower than the widest."""
    m = np.zeros((WIDE * EMBED, FILTERS * len(WIDTHS)), np.float32)
    for k, w in enumerate(WIDTHS):
        m[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    return m


def train(windows: list[bytes], langs: list[str], seed: int = 7) -> ByteNet:
    """Softmax cross-entropy with Adam; languages count alike however many windows each has."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    net = ByteNet.fresh(names, rng)
    x = np.concatenate([windows_of(w[:WINDOW]) for w in windows])
    t = np.searchsorted(names, langs)
    share = (len(t) / (len(names) * np.bincount(t, minlength=len(names)))).astype(np.float32)
    params = ["embed", "kernel", "bias", "out", "out_bias"]
    m1, m2 = ({p: np.zeros_like(getattr(net, p)) for p in params} for _ in range(2))
    keep, step = mask(), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            rows = order[i : i + BATCH]
            xb, tb, n = x[rows], t[rows], len(rows)
            grads = net.gradients(xb, tb, share[tb] / n)
            grads["kernel"] *= keep
            step += 1
            for name in params:
                g = grads[name]
                m1[name] += 0.1 * (g - m1[name])
                m2[name] += 0.001 * (g * g - m2[name])
                new = getattr(net, name) - RATE * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, new.astype(np.float32))
    return net


def is_held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by the id's checksum; a null id counts as empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> ByteNet | None:
    """Trains on a bounded sample of labelled (id, text, lang): of each language about docs_per_lang
    documents (fewer each where languages are many), those of smallest hash, with up to WINDOWS_PER_DOC
    windows of each, cut out on the executors. Where there are more languages than documents in the sample, it is drawn from all
    rows alike, and the languages it holds are learned. Rows without text or lang are left out; None if none remain."""
    rows = labelled.where("text is not null and lang is not null")
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("c")), "langs")
    n, total = counts.agg(F.count("*"), F.sum("c")).first()
    if not n:
        return None
    docs_per_lang = max(1, min(docs_per_lang, MOST_DOCS // n))
    # A hash threshold for each language gives about 1.3 * docs_per_lang rows; the rest goes below.
    order = F.xxhash64(F.col("id").cast("string"), "text")
    place = (order / F.lit(2.0**63) + 1) / 2
    if n <= MOST_DOCS:  # so many rows are broadcast at most
        rows = rows.join(F.broadcast(counts), "lang").where(place <= F.lit(1.3 * docs_per_lang) / F.col("c"))
    else:
        rows = rows.where(place <= MOST_DOCS / total)
    picked = rows.select("lang", "text", order.alias("order"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            out = []
            for lang, order, text in zip(batch.column("lang").to_pylist(), batch.column("order").to_pylist(), texts, strict=True):
                n = max(1, len(text) // WINDOW)
                for k in range(min(n, WINDOWS_PER_DOC)):
                    at = (xxhash.xxh64_intdigest(text, k) % n) * WINDOW
                    out.append((lang, order, k, text[at : at + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["lang", "order", "k", "piece"])

    found = sorted(arrow_map(picked, cut, "lang string, order long, k long, piece binary").distinct().collect())
    taken, used = {}, []
    for r in found:
        docs = taken.setdefault(r["lang"], set())
        if r["order"] in docs or len(docs) < docs_per_lang:
            docs.add(r["order"])
            used.append(r)
    return train([bytes(r["piece"]) for r in used], [r["lang"] for r in used]) if used else None


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text: log probabilities of all its windows, weighed by
    their bytes. `und` and 0 where the text is null, has no letter, or nothing could be learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            told = [i for i, t in enumerate(texts) if net and LETTER.search(t.decode("utf-8", "replace"))]
            if told:
                parts = [windows_of(texts[i]) for i in told]
                counts = [len(p) for p in parts]
                logs = net.log_probs(np.concatenate(parts)).astype(np.float64)
                weights = np.concatenate([np.minimum(len(texts[i]) - np.arange(c) * WINDOW, WINDOW) for i, c in zip(told, counts, strict=True)])
                begins = np.cumsum([0, *counts[:-1]])
                means = np.add.reduceat(logs * weights[:, None], begins) / np.add.reduceat(weights, begins)[:, None]
                probs = np.exp(means - means.max(1, keepdims=True))
                probs /= probs.sum(1, keepdims=True)
                for i, k, row in zip(told, probs.argmax(1), probs, strict=True):
                    langs[i], scores[i] = net.langs[k], float(row[k])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return arrow_map(own, run, f"doc_id {own.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the labelled documents that are not held out and predicts all.

    docs: doc_id, text, lang. Returns doc_id, held_out, lang_pred, score. Very long texts are read whole. A null id is
    handed on and held out; repeated rows are each predicted; other columns play no part; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    net = fit(own.where(~is_held_out(F.col("id"))))
    said = predict(docs.select("doc_id", "text"), net)
    return said.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
