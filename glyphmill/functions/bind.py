"""Names for values within column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for each row, however often use has it."""
    return F.transform(F.array(value), use)[0]
