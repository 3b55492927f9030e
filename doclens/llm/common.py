"""Small pieces the training-data operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a whole table."""
    return spark.read.parquet(f"{sf}/{table}.parquet").select(*columns)


def ships(module: str) -> None:
    """Send a module's functions, and what they hold, to Python workers by value: executors need no copy
    of it. Spark broadcasts a function that is large, such as one that holds a fitted model."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(-1))
