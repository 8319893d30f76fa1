"""Quality rules, line first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, checked_keep, chunks

SPACE = b" \t\n\x0b\x0c\r"
#: Last characters of a line that is a sentence.
ENDS = tuple(x.encode() for x in ".!?:;,\"')]…”’»。！？")
#: Signs that part the entries of a navigation bar; a line with one of them among so many words is one.
BARS, BAR_EVERY = (b"|", "»".encode(), "›".encode(), "•".encode()), 5
#: Wording that pages repeat around their content.
BOILERPLATE = (b"all rights reserved", b"cookie policy", b"privacy policy", b"terms of use", b"terms of service", b"enable javascript", b"subscribe to our newsletter", b"click here to")
#: A document that loses more than this share of its words with failing lines is rejected.
MOST_LOST = 0.5
#: Base rules of a document.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
SYMBOLS = b"#*$%&|<>"
#: A line with more symbols than this for ten words is no sentence.
SYMBOLS_IN_TEN = 3


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails a rule: punctuation (no sentence end, too many symbols), navigation, boilerplate."""
    if not line.rstrip(SPACE).endswith(ENDS) or 10 * sum(line.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))) > SYMBOLS_IN_TEN * len(words):
        return True
    if len(words) >= 3 and BAR_EVERY * sum(words.count(x) for x in BARS) >= len(words):
        return True
    low = line.lower()
    return any(x in low for x in BOILERPLATE)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found at least twice; exact, by word numbers."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(numbers)
    pairs = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # a product of three numbers would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * n + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[j : j + len(keys)] |= twice
    return int(covered.sum())


def judge_text(text: bytes) -> tuple[int, int, int, int, int, bool, bool, int, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words left, text left."""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(SPACE[i : i + 1]) for i in range(6))
    symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    repeats = repeated_words(words)
    seen: set[bytes] = set()
    left, lost, dup = [], 0, 0
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            if line_fails(line, own):
                lost += len(own)
                continue
        left.append(line)
    failed = n < LEAST_WORDS or repeats > MOST_REPEATED * n
    return n, chars, symbols, dup, repeats, failed, not failed and lost <= MOST_LOST * n, n - lost, b"\n".join(left) if lost else text


def judge_documents(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Line-first cleaning of every whole text; the columns of keep are handed on.

    Lines that fail a rule go; a document that fails a base rule or loses over half its words is
    rejected. Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, words_left, text_left (the text without its failing lines; unchanged if none
    fails). Null and empty texts have no words, so they fail; lines without a word are left alone.
    Very long texts are judged whole. Repeated rows are judged alike; other columns play no part; a name in keep that is also
    one of the result's is an error; an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left", "text_left"]
    keep = checked_keep(keep, names)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, text_col):
            rows = [judge_text(t) for t in texts]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made], [*keep, *names])

    own = docs.select(*keep, text_col)
    given = "".join(f"`{k}` {own.schema[k].dataType.simpleString()}, " for k in keep)
    return arrow_map(own, run, f"{given}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, words_left long, text_left string")
