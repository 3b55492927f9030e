"""Log-factorial, which Spark SQL lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 8


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 1 + 8, brought back by the product of the eight steps."""
    z = n.cast("double") + 1.0
    high = z + float(_SHIFT)
    square = high * high
    series = F.lit(1 / 1188.0)
    for term in (1 / 1680.0, 1 / 1260.0, 1 / 360.0, 1 / 12.0):
        series = term - series / square
    series = series / high
    stirling = (high - 0.5) * F.log(high) - high + 0.5 * math.log(2 * math.pi) + series
    product = z
    for step in range(1, _SHIFT):
        product = product * (z + float(step))
    return stirling - F.log(product)
