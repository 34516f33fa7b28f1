"""Word columns shared by the operators that stay in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """Words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def shingle_hash(words: Column, at: Column, width: int) -> Column:
    """A 64-bit hash of the ``width`` words from ``at`` on."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(width)])
