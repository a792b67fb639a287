"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Query = tuple[Callable, str | None]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles at six decimals and integers as longs, so that results compare across engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(out)
