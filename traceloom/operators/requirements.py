"""Requirement nodes and artifacts as DataFrames, and the filters over them.

A node is one clause of a standard, an artifact one work product; ``std`` names the standard
both belong to, and every comparison stays inside it, so nothing is ever joined across standards.
Columns ``node_ord`` and ``art_ord`` carry the order that first-match and last-wins rules need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from traceloom.functions import text as T


def first_delivery(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """Each key once, as delivered first."""
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min_by(row, F.struct(F.col(order).isNull(), F.col(order))).alias("__row"))
    return first.select("__row.*")


def few_repeats(df: DataFrame, key: str, order: str = "loaded_at", most: int = 1_000_000) -> DataFrame:
    """The same as ``first_delivery``. Where few keys come again, which a job over the keys finds out, only
    their rows travel, and the others stay where they are read."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col(key).isNotNull() & (F.col("__n") > 1)).select(key)
    if repeated.limit(most + 1).count() > most:
        return first_delivery(df, key, order)
    repeated = F.broadcast(repeated)
    once = df.filter(F.col(key).isNotNull()).join(repeated, key, "left_anti")
    return once.unionByName(first_delivery(df.join(repeated, key, "left_semi"), key, order))


def nodes(*clauses: DataFrame, first: Callable[..., DataFrame] = first_delivery) -> DataFrame:
    out = None
    for c in clauses:
        one = first(c.select("clause_key", "standard_id", "part", "section", "title", "type", "text", "tags", "notes", "asil_level", "cross_references", "loaded_at"), "clause_key").select(
            F.col("standard_id").alias("std"), F.concat(F.lit("part_"), "part").alias("group_key"), F.col("clause_key").alias("node_ord"), F.col("section").alias("node_id"),
            "title", F.col("type").alias("node_type"), "text", "tags", "notes", F.coalesce("asil_level", F.lit("all")).alias("risk"), F.col("cross_references").alias("refs"),
        )
        out = one if out is None else out.unionAll(one)
    return out.withColumn("node_text", T.node_text(F.col("text"), F.col("title"), F.col("notes"), F.col("tags")))


def artifacts(products: DataFrame, first: Callable[..., DataFrame] = first_delivery) -> DataFrame:
    columns = ("wp_key", "id", "project_id", "standard_id", "title", "mapped_sections", "status", "content", "tags_addressed", "methods_used", "traceability_links", "loaded_at")
    return first(products.select(*columns), "wp_key").select(
        F.col("standard_id").alias("std"), F.col("wp_key").alias("art_ord"), F.col("id").alias("art_id"), "project_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("full_text"),
        F.coalesce("status", F.lit("")).alias("status"), F.col("tags_addressed").alias("tags"), F.col("methods_used").alias("methods"), F.col("mapped_sections").alias("mapped"), F.col("traceability_links").alias("links"),
    )


def applicable(node_rows: DataFrame, target: str | None, scale: Sequence[str], groups: Sequence[str] | None = None) -> DataFrame:
    """Requirements (not guidelines) in scope at the target level."""
    x = node_rows.filter(T.is_requirement(F.col("node_type"), F.col("text")))
    if groups:
        x = x.filter(F.col("group_key").isin(*groups))
    return x.filter(T.risk_applies(F.col("risk"), target, scale))


def claims(arts: DataFrame) -> DataFrame:
    """(std, node_id, art_ord, status) of the sections artifacts say they map to."""
    return arts.select("std", "art_ord", "status", F.explode("mapped").alias("node_id")).filter(F.col("node_id").isNotNull())


def first_claim(arts: DataFrame) -> DataFrame:
    """(std, node_id, status) of the first artifact that claims a section."""
    return claims(arts).groupBy("std", "node_id").agg(F.min_by("status", "art_ord").alias("status"))


def numbered(df: DataFrame, group: str, order: str, bits: int = 16) -> DataFrame:
    """The rows with ``n``, their number from 1 in the order of a distinct integer inside a group (null is
    one). A group is numbered piece by piece, a piece holding at most 2 ** bits integers, and pieces follow
    each other by their sizes: no task gets a whole group."""
    x = df.withColumn("__piece", F.shiftright(order, bits))
    sizes = x.groupBy(group, "__piece").agg(F.count(F.lit(1)).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    start = sizes.select(F.col(group).alias("__group"), F.col("__piece").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy(group, "__piece").orderBy(order)))
    x = x.join(start, x[group].eqNullSafe(start["__group"]) & (x["__piece"] == start["__p"]))
    return x.withColumn("n", F.col("__n") + F.col("__before")).drop("__piece", "__n", "__group", "__p", "__before")


def tag_rows(df: DataFrame, key: str) -> DataFrame:
    """(std, key, tag) of valid concepts, lower case and trimmed."""
    return df.select("std", key, F.explode("tags").alias("t")).filter(T.is_concept(F.col("t"))).select("std", key, F.lower(F.trim("t")).alias("tag"))


def discovered_scale(node_rows: DataFrame) -> DataFrame:
    """(level) that occur as single letters in plain levels and ranges: the risk scale."""
    plain = F.transform(F.split(F.col("risk"), "-"), lambda x: F.trim(x))
    x = node_rows.select(F.explode(plain).alias("level")).distinct()
    return x.filter(~F.lower("level").isin("all", "n/a", ""))


def sorted_levels(levels: Column) -> Column:
    """Levels in order: as numbers if all are, else as text."""
    numbers = F.transform(levels, lambda x: x.try_cast("int"))
    return F.when(F.exists(numbers, lambda x: x.isNull()), F.array_sort(levels)).otherwise(F.transform(F.array_sort(numbers), lambda x: x.cast("string")))
