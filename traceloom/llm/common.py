"""Pieces the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space in the sense of Unicode, the no-break spaces and separators included.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def folded(text: Column) -> Column:
    """Each run of white space one space, none at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def folded_values(values: Column) -> Column:
    """The folded, non-blank elements of an array; null for a null array."""
    return F.filter(F.transform(values, folded), lambda x: x.isNotNull() & (x != ""))


def once(df: DataFrame, key: str, *columns: str, order: str = "loaded_at") -> DataFrame:
    """Each key once, as delivered first: (key, *columns). Rows with a null key are left out."""
    picked = F.struct(*[F.col(c) for c in columns])
    g = df.filter(F.col(key).isNotNull()).groupBy(F.col(key))
    # an order that may be null sorts first in a struct; a real date wins over none
    first = g.agg(F.min_by(picked, F.struct(F.col(order).isNull(), F.col(order))).alias("__first"))
    return first.select(key, "__first.*")
