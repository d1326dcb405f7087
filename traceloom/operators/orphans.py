"""References to records that are missing, deleted or come later.

Parent keys become integers in small blocks: a section number is the integer of its last level
in the block of the levels before it, an id is its number in a block of 64. In each block the
sorted integers are compressed into contiguous runs; a run carries, by offset, when each of its
keys was loaded and whether it is deleted. A reference is matched as of the preceding run start
of its block: beyond the run's end it is an orphan, otherwise the offset gives its state.

Blocks hold at most ``BLOCK`` integers, so no group grows with the data. The match is an
equi-join on the block; a block that many references name is split by adaptive execution, whose
other side, the compressed runs, is small.

Defined results
* null arrays and elements, blank texts and texts without a section number: no reference;
  null elements still count for the position;
* a source or parent delivered several times counts once, with its earliest loaded_at;
* several parents of one number: present if one is, deleted only if all are;
* a source without a standard: its references to sections are missing; a parent without one or
  without a part is never meant;
* numbers beyond 64 bits are no key: a reference to one is missing, a record with one is never meant;
* loaded_at equal to the source's isn't late; a null loaded_at of a parent is never late;
* empty tables: no rows (no parents at all: every reference is missing);
* columns beside those named below are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BLOCK = 64
SECTION = r"(?<![\d.])(\d+(?:\.\d+)+)(?!\d)"
PART = r"(?i)part[\s_ ]*(\d+)"
ID_NUMBER = r"(?i)(?<![\p{L}\d])WP[\s_\- ]*(\d+)"


def section_code(standard: Column, part: Column, section: Column) -> tuple[Column, Column]:
    """(block, integer) of a section number of two or more levels."""
    levels = F.transform(F.split(section, r"\."), lambda x: x.try_cast("bigint"))
    # a level beyond 64 bits: no block, so nothing is found there
    last = F.when(F.forall(levels, lambda x: x.isNotNull()), F.element_at(levels, -1))
    head = F.array_join(F.slice(levels, 1, F.size(levels) - 1).cast("array<string>"), ".")
    bar = F.lit("|")
    return F.concat(standard, bar, part, bar, head, bar, F.shiftright(last, 6).cast("string")), last


def number_code(number: Column) -> tuple[Column, Column]:
    """(block, integer) of an id's number."""
    return F.concat(F.lit("#"), F.shiftright(number, 6).cast("string")), number


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint")


def clause_parents(*clauses: DataFrame) -> DataFrame:
    """(block, n, loaded, deleted) of clauses by (standard_id, part, section)."""
    out = None
    for c in clauses:
        section = F.regexp_extract("section", SECTION, 1)
        block, n = section_code(F.col("standard_id"), F.trim("part"), section)
        one = c.filter(section != "").select(block.alias("block"), n.alias("n"), F.col("loaded_at").alias("loaded"), F.col("deleted_at").isNotNull().alias("deleted"))
        out = one if out is None else out.unionAll(one)
    return out


def product_parents(products: DataFrame) -> DataFrame:
    """(block, n, loaded, deleted) of work products by the number of their id."""
    num = _number(F.col("id"), ID_NUMBER)
    block, n = number_code(num)
    return products.filter(num.isNotNull()).select(block.alias("block"), n.alias("n"), F.col("loaded_at").alias("loaded"), F.col("deleted_at").isNotNull().alias("deleted"))


def compress_runs(parents: DataFrame) -> DataFrame:
    """(block, run_start, run_end, loaded[], deleted[]): gaps and islands inside each block."""
    keys = parents.filter(F.col("block").isNotNull()).repartition("block").groupBy("block", "n").agg(F.min("loaded").alias("loaded"), F.min("deleted").alias("deleted"))
    island = F.col("n") - F.row_number().over(Window.partitionBy("block").orderBy("n"))
    runs = keys.withColumn("island", island).groupBy("block", "island")
    return runs.agg(F.min("n").alias("run_start"), F.max("n").alias("run_end"), F.sort_array(F.collect_list(F.struct("n", "loaded", "deleted"))).alias("keys")).select(
        "block", "run_start", "run_end", F.col("keys.loaded").alias("loaded"), F.col("keys.deleted").alias("deleted")
    )


def block_index(runs: DataFrame) -> DataFrame:
    """One row for each block with its runs in order (at most BLOCK / 2 of them)."""
    return runs.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("run_start", "run_end", "loaded", "deleted"))).alias("runs"))


def clause_references(clauses: DataFrame) -> DataFrame:
    """cross_references as (field_name, source_key, pos, block, n, source_loaded)."""
    ref = F.col("ref")
    x = clauses.select("clause_key", "standard_id", "part", "loaded_at", F.posexplode("cross_references").alias("p", "ref")).filter(ref.isNotNull())
    part = F.coalesce(F.nullif(F.regexp_extract(ref, PART, 1), F.lit("")), F.trim("part"))
    section = F.regexp_extract(F.regexp_replace(ref, PART + r"\s*:?", " "), SECTION, 1)
    x = x.withColumn("target_part", part).withColumn("section", section).filter((F.col("section") != "") & F.col("target_part").isin("3", "4"))
    block, n = section_code(F.col("standard_id"), F.col("target_part"), F.col("section"))
    return _refs(x, "cross_references", "clause_key", block, n)


def section_references(products: DataFrame) -> DataFrame:
    """mapped_sections in the same form."""
    ref = F.col("ref")
    part = F.regexp_extract("mapped_part", r"(\d+)", 1)
    x = products.filter(part.isin("3", "4")).select("wp_key", "standard_id", part.alias("target_part"), "loaded_at", F.posexplode("mapped_sections").alias("p", "ref")).filter(ref.isNotNull())
    x = x.withColumn("section", F.regexp_extract(ref, SECTION, 1)).filter(F.col("section") != "")
    block, n = section_code(F.col("standard_id"), F.col("target_part"), F.col("section"))
    return _refs(x, "mapped_sections", "wp_key", block, n)


def link_references(products: DataFrame) -> DataFrame:
    """traceability_links.to in the same form."""
    x = products.select("wp_key", "loaded_at", F.posexplode(F.col("traceability_links.to")).alias("p", "ref"))
    x = x.withColumn("num", _number(F.col("ref"), ID_NUMBER)).filter(F.regexp_extract("ref", ID_NUMBER, 1) != "")
    block, n = number_code(F.col("num"))
    return _refs(x, "traceability_links.to", "wp_key", block, n)


def _refs(x: DataFrame, name: str, key: str, block: Column, n: Column) -> DataFrame:
    return x.select(F.lit(name).alias("field_name"), F.col(key).alias("source_key"), (F.col("p") + 1).alias("pos"), block.alias("block"), n.alias("n"), F.col("loaded_at").alias("source_loaded"))


def find_orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """(field_name, source_key, pos, reason, load_month) of references that are missing, deleted or late."""
    once = references.groupBy("field_name", "source_key", "pos", "block", "n").agg(F.min("source_loaded").alias("source_loaded"))
    index = block_index(compress_runs(parents))
    m = once.join(index, "block", "left")
    # as of: the last run that starts at or before the key
    run = F.try_element_at(F.filter("runs", lambda r: r.run_start <= F.col("n")), F.lit(-1))
    m = m.withColumn("run", run).withColumn("at", (F.col("n") - F.col("run.run_start")).cast("int"))
    inside = F.col("run").isNotNull() & (F.col("n") <= F.col("run.run_end"))
    reason = (
        F.when(~F.coalesce(inside, F.lit(False)), "missing")
        .when(F.get(F.col("run.deleted"), F.col("at")), "deleted")
        .when(F.get(F.col("run.loaded"), F.col("at")) > F.col("source_loaded"), "late")
    )
    return m.select("field_name", "source_key", F.col("pos").cast("int").alias("pos"), reason.alias("reason"), F.date_format("source_loaded", "yyyy-MM").alias("load_month")).filter(F.col("reason").isNotNull())


def orphan_references(part_3: DataFrame, part_4: DataFrame, products: DataFrame) -> DataFrame:
    """All orphans of cross_references, mapped_sections and traceability_links.to."""
    references = clause_references(part_3).unionAll(section_references(products)).unionAll(link_references(products))
    parents = clause_parents(part_3, part_4).unionAll(product_parents(products))
    return find_orphans(references, parents)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per field, month and reason."""
    return orphans.groupBy("field_name", "load_month", "reason").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("source_key").alias("n_sources"))
