"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters other than these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def words(text: Column) -> Column:
    """Array of the lower-cased words; null and blank texts give an array without words."""
    t = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TRIM))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def seeded(seed: int, *cols: Column) -> Column:
    """A uniform, non-negative 63-bit hash; the same for the same values on every run."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
