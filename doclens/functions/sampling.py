"""Repeatable random numbers: a hash of a seed and a key, never ``rand`` after a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_hex(seed: int | str, *keys: Column) -> Column:
    """32 hex digits that depend on nothing but the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[key.cast("string") for key in keys]))


def hash_unit(seed: int | str, *keys: Column) -> Column:
    """A number in [0, 1) with 52 random bits."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 13), 16, 10).cast("double") / float(2**52)
