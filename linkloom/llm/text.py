"""Words and word shingles as column expressions.

A word is a run of characters other than space and U+0009 to U+000D, in every operator of this subpackage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Java's ``\t-\r`` is U+0009 to U+000D.
SPLIT = "[ \\t-\\r]+"
SHINGLE = 5


def pinned(column: Column) -> Column:
    """``column``, computed once per row where it stands.

    Catalyst copies the definition of a column into filters above it, and from there into lambdas, which would compute it
    again for every element. It leaves alone what is not deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null and for text without words."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPLIT))


def window_hashes(word: Column, width: int = SHINGLE) -> Column:
    """64-bit hash of each run of ``width`` words, in order; empty when there are fewer words.

    ``word`` has to be a plain column, or each hash would split the text again.
    """
    starts = F.slice(word, 1, F.greatest(F.size(word) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(word, i + k) for k in range(1, width)]))


def shingle_set(word: Column, width: int = SHINGLE) -> Column:
    """Distinct shingle hashes; with fewer words than ``width``, the whole sequence as one; else empty."""
    return (
        F.when(F.size(word) >= width, F.array_distinct(window_hashes(word, width)))
        .when(F.size(word) > 0, F.array(F.xxhash64(F.array_join(word, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )
