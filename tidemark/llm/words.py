"""Shared text expressions (JVM side) and byte-level words (Python side)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII blanks that separate words.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[ \t-\r]"


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of maximal runs of non-blank characters; empty for empty text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANK_CLASS + "+")).otherwise(
        F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain_names(df: DataFrame, *needed: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with own ones."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


class WordHashes(dict):
    """64-bit hash of each distinct word (bytes), computed once a task.

    The table is emptied when it holds ``limit`` words, which bounds memory and
    changes no result.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value


def mixed(x):
    """Spread 64-bit values evenly (splitmix finalizer on a NumPy array)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words, k: int):
    """Hash of every run of ``k`` consecutive word hashes (NumPy uint64)."""
    import numpy as np

    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for i in range(k):
            total = total * factor + words[i:i + n]
        return mixed(total)
