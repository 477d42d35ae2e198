"""Word columns that several operators share. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS_AND_DIGITS = r"[\p{L}\p{M}\p{N}]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words of a text, in order. A word is a run
    of letters, marks and digits; a null text has no words."""
    words = F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(LETTERS_AND_DIGITS), F.lit(0)
    )
    return F.transform(words, lambda word: F.xxhash64(word))
