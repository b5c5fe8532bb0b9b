"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
_NOT_POINTS = bytes(range(128, 192)) + SPACE  # continuation bytes and white space
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_PUNCT = bytes(i for i in range(33, 127) if not bytes([i]).isalnum())
_HIGH = bytes(range(192, 256))

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_high", "n_distinct", "n_exclaim", "n_long"]


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in three-word windows that the text holds twice or more, and the number of distinct words."""
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    n, v = len(ids), max(1, len(names))
    if n < 4:
        return 0, len(names)
    pair = ids[:-2] * v + ids[1:-1]
    if v > 2_000_000:
        _, pair = np.unique(pair, return_inverse=True)
    _, inv, times = np.unique(pair * v + ids[2:], return_inverse=True, return_counts=True)
    hit = times[inv] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= hit
    return int(cover.sum()), len(names)


def count_text(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    count = lambda chars: len(text) - len(text.translate(None, chars))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated, distinct = repeat_words(words)
    return (
        len(words), len(text) - count(_NOT_POINTS), count(SYMBOLS), dup, repeated, lines,
        count(_UPPER), count(_DIGITS), count(_PUNCT), count(_HIGH), distinct, text.count(b"!"), sum(len(w) > 24 for w in words),
    )


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The keep columns and the counts of COLUMNS (long) of column `text`; null texts count as empty."""
    schema = docs.select(*keep).schema
    for c in COLUMNS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = np.array([count_text(t) for t in b.column(b.num_columns - 1).to_pylist()], np.int64).reshape(-1, len(COLUMNS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(table[:, i]) for i in range(len(COLUMNS))]], names=[*b.schema.names[:-1], *COLUMNS])

    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(run, schema)
