"""Parts of JSON standards beside their clauses: method tables, guidance, trace rules, references.

Each takes rows (file_name, text) with a whole JSON document in ``text`` and binds a schema to the
members it needs; members that are missing or shaped otherwise give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import text as T

_METHOD = "struct<method:string,name:string,technique:string,ASIL:array<string>,level:array<string>>"
_TABLE = f"struct<activity:string,title:string,methods:array<{_METHOD}>>"
# Members that a reference to another record is put together from, in this order.
REFERENCE_MEMBERS = ("section", "clause", "process", "control")


def _member(name: str, schema: str) -> Column:
    return F.from_json(F.get_json_object("text", f"$.{name}"), schema)


def method_tables(docs: DataFrame) -> DataFrame:
    """(file_name, activity, method, levels): methods of tables at the top, in annexes and in their tables."""
    tops = F.flatten(F.array_compact(F.array(*[_member(n, f"array<{_TABLE}>") for n in ("methods", "techniques", "practices", "methods_tables")])))
    annexes = _member("annexes", f"array<struct<methods:array<{_TABLE}>,tables:array<{_TABLE}>>>")
    deep = F.flatten(F.transform(annexes, lambda a: F.concat(F.coalesce(a["methods"], F.array().cast(f"array<{_TABLE}>")), F.coalesce(a["tables"], F.array().cast(f"array<{_TABLE}>")))))
    every = F.concat(tops, F.coalesce(deep, F.array().cast(f"array<{_TABLE}>")))
    x = docs.select("file_name", F.explode(every).alias("t")).select("file_name", F.coalesce("t.activity", "t.title").alias("activity"), F.explode("t.methods").alias("m"))
    return x.select("file_name", "activity", F.coalesce("m.method", "m.name", "m.technique", F.lit("")).alias("method"), F.coalesce("m.ASIL", "m.level").alias("levels"))


def methods_for(tables: DataFrame, target: str | None) -> DataFrame:
    """Methods whose list of levels names the target, or that have none."""
    return tables if target is None else tables.filter(F.col("levels").isNull() | F.array_contains("levels", target))


def guidance(docs: DataFrame) -> DataFrame:
    """(file_name, place, title, text) of informative examples."""
    rows = F.from_json(F.get_json_object("text", "$.informative_guidance.examples"), "array<struct<title:string,text:string,description:string>>")
    return docs.select("file_name", F.posexplode(rows).alias("place", "g")).select("file_name", "place", "g.title", F.coalesce("g.text", "g.description").alias("text"))


def trace_rules(docs: DataFrame) -> DataFrame:
    """(file_name, place, from_item, to_item) of the traceability model, then of links between parts."""
    pair = "array<struct<`from`:string,`to`:string>>"
    one = lambda n: F.coalesce(F.from_json(F.get_json_object("text", f"$.{n}.mapping"), pair), F.array().cast(pair))
    x = docs.select("file_name", F.posexplode(F.concat(one("traceability_model"), one("cross_part_links"))).alias("place", "r"))
    return x.select("file_name", "place", F.col("r.from").alias("from_item"), F.col("r.to").alias("to_item"))


def reference_edges(docs: DataFrame, clause_array: str = "clauses") -> DataFrame:
    """(file_name, src, target, context) of references that are objects; texts make no edge."""
    schema = "array<struct<section:string,id:string,cross_references:array<string>>>"
    c = docs.select("file_name", F.concat(F.lit("part_"), F.get_json_object("text", "$.part")).alias("group_key"), F.explode(_member(clause_array, schema)).alias("c"))
    ref = F.from_json("r", "struct<part:string,section:string,clause:string,process:string,control:string,context:string>")
    x = c.select("file_name", F.concat_ws(":", "group_key", F.coalesce("c.section", "c.id")).alias("src"), F.explode("c.cross_references").alias("r")).filter(F.col("r").startswith("{")).withColumn("x", ref)
    blank = lambda c: F.nullif(c, F.lit(""))
    target = F.concat_ws(":", F.concat(F.lit("part_"), blank(F.col("x.part"))), *[blank(F.col(f"x.{m}")) for m in REFERENCE_MEMBERS])
    return x.select("file_name", "src", target.alias("target"), "x.context")


def keyword_evidence(arts: DataFrame, checks: dict[str, tuple[str, ...]]) -> DataFrame:
    """(std, check_name, n_artifacts): how many texts of a standard hold any keyword of a check."""
    low = F.lower("full_text")
    hits = F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(low, F.lit(k)) for k in (*ks, ks[0])]), F.lit(name)) for name, ks in checks.items()]))
    return arts.select("std", F.explode(hits).alias("check_name")).groupBy("std", "check_name").agg(F.count(F.lit(1)).alias("n_artifacts"))


def corrective_actions(lines: DataFrame) -> DataFrame:
    """(std, place, priority, action, state) of recommendation lines: the tag becomes a column."""
    return lines.select("std", "place", T.priority_of(F.col("line")).alias("priority"), T.without_priority(F.col("line")).alias("action"), F.lit("OPEN").alias("state"))


def part_coverage(registry: DataFrame, by_part: DataFrame) -> DataFrame:
    """A list of parts with the findings of each, zero where there are none."""
    return registry.join(by_part, registry.part_id == by_part.group_key, "left").select("part_id", "title", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_critical", F.lit(0)).alias("n_critical"), F.coalesce("health", F.lit("green")).alias("health"))
