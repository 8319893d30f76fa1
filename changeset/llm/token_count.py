"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, shared_dir, texts_of

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
#: Texts encoded at once; a batch of the library holds all their tokens.
ENCODE_BYTES = 1 << 20


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


#: Fixed value: a pre-tokenizer pattern none of whose pieces holds white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker remembers with their counts.
MEMO_WORDS = 800_000
_MEMO: dict[str, dict[bytes, int]] = {}


def by_words(path: str) -> bool:
    """Whether a tokenizer's count of a text is the sum over its words: a .json one that lower-cases, takes white space
    as blanks, keeps the pieces of PIECES and drops all else, and adds nothing of its own around a text."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(Path(path).read_text())
    steps = lambda x, key: (x or {}).get(key) or ([x] if x else [])
    normal = [(s["type"], (s.get("pattern") or {}).get("Regex"), s.get("content")) for s in steps(spec.get("normalizer"), "normalizers")]
    cut = (steps(spec.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
    split = cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") and cut.get("pattern", {}).get("Regex") == PIECES
    return bool(split) and normal == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]


def normalised(text: Column, path: str) -> Column:
    """The content that a digest stands for: where only words count, line ends and tabs are blanks and those at the ends go; else the text as it is."""
    text = F.coalesce(text, F.lit(""))
    if not by_words(path):
        return text
    for mark in "\n\t\r":
        text = F.replace(text, F.lit(mark), F.lit(" "))
    return F.trim(text)


def _encoder(path: str, version: str):
    """Texts as bytes -> their numbers of tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in piece.encode([t.decode() for t in texts], num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    special = [t.content.encode() for t in model.get_added_tokens_decoder().values()]

    def whole(texts: list[bytes]) -> list[int]:
        return [len(x.ids) for x in model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    if not by_words(path):
        return whole
    memo = _MEMO.setdefault(version, {})

    def count(texts: list[bytes]) -> list[int]:
        # ASCII words in lower case first, as the tokenizer does in the end; others as they are, since it composes characters
        # before that. Not where lower case might make a special string, nor where there is one.
        low = [t.lower() for t in texts]
        odd = [i for i, (t, x) in enumerate(zip(texts, low, strict=True)) if any(s in t or s in x for s in special)]
        words = [x.split() if x.isascii() else [w.lower() if w.isascii() else w for w in t.split()] for t, x in zip(texts, low, strict=True)]
        for i in odd:
            words[i] = []
        if len(memo) > MEMO_WORDS:
            memo.clear()
        new = list({w for ws in words for w in ws if w not in memo})
        memo.update(zip(new, whole(new), strict=True))
        out = [sum(map(memo.__getitem__, ws)) for ws in words]
        for i, n in zip(odd, whole([texts[i] for i in odd]), strict=True):
            out[i] = n
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, without begin, end or added special tokens.

    The cache is a Parquet table (tokenizer version digest, content digest, n_tokens) at cache_path,
    a folder that all executors see; by default a new one in the shared folder. Contents that it has
    are not encoded again; of the others each distinct one is encoded once and appended, so a second
    call encodes nothing. Copies meet in a partially aggregated group before the shuffle. Appends are
    committed as a whole: a lost job leaves the cache as it was; should two calls add the same
    content, both rows agree and one is read. Of the cache only the contents of this call are aggregated. Returns doc_id, n_bytes
    (UTF-8, of the text as it is), n_tokens. Null texts count as empty: 0 and 0. Very long texts count whole, a null id is
    handed on, repeated rows are encoded once and counted each, other columns play no part, and an empty table gives no rows.
    The tokenizer file must be at the same path on every executor.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache_path = cache_path or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    content = normalised(F.col(text_col), tokenizer_path)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("content"))
    distinct = docs.select(content.alias("text")).select(F.unhex(F.sha2("text", 256)).alias("content"), "text").groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(tokenizer_path, version)
        for batch in batches:
            texts, out, held, size = texts_of(batch.column("text")), [], [], 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size >= ENCODE_BYTES:
                    out += count(held)
                    held, size = [], 0
            out += count(held) if held else []
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(out), pa.string()), batch.column("content"), pa.array(out, pa.int64())], ["tokenizer", "content", "n_tokens"])

    arrow_map(misses, encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    counts = materialize(stored.join(keyed.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return keyed.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")
