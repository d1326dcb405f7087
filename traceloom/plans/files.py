"""From files to a report: a standard's folder or file and artifacts of any kind, checked as one standard.

Names of fields are found in the files themselves; a settings file may name them, the scale of
levels and further trace rules. The few names, levels and rules of a standard are read by the driver;
clauses, artifacts and references stay frames.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import text as T
from traceloom.functions import vocabulary as V
from traceloom.operators import discovery, requirements, sections, structure
from traceloom.operators import layers as L
from traceloom.plans.compliance import Model
from traceloom.sources import readers

STD = "standard"
# Names a notes field goes by; kinds of files that are read as documents.
NOTES = ("notes", "remarks", "comments", "annotations")
DOCUMENTS = (".docx", ".pdf", ".md", ".txt", ".xlsx", ".xls", ".csv", ".odt")
_MAP = "array<map<string,string>>"


@dataclass
class Fields:
    """What the fields of a standard are called; None where there is no such field."""

    text: str | None = None
    id: str | None = None
    title: str | None = None
    risk: str | None = None
    tag: str | None = None
    type: str | None = None
    notes: str | None = None
    methods: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)


def find_fields(docs: DataFrame, hints: dict[str, str] | None = None) -> Fields:
    """Fields by the names that occur at least twice, under the hints of a settings file. Where that
    names the text field, it is taken to name all."""
    found = Fields(**{k.removesuffix("_field"): v for k, v in (hints or {}).items() if k.removesuffix("_field") in ("text", "id", "title", "risk", "tag", "type")})
    if found.text:
        return found
    names = discovery.key_frequency(discovery.walk(docs, "file_ord", "text"), "file_ord").cache()
    roles = V.FIELD_ROLES | {"notes": NOTES}
    for r in discovery.field_roles(names, {k: v for k, v in roles.items() if k not in ("method", "xref")}).collect():
        if getattr(found, r.role) is None:
            setattr(found, r.role, r.name)
    for role, name in (("method", "methods"), ("xref", "references")):
        rows = names.filter(F.lower("name").isin(*roles[role])).orderBy("first_key", "first_ord").select("name").collect()
        setattr(found, name, [r.name for r in rows])
    return found


def _member(name: str | None) -> Column:
    return F.try_element_at("m", F.lit(name)) if name else F.lit(None).cast("string")


def _list(c: Column) -> Column:
    """A member as a list of texts: a list's elements, or the one value."""
    return F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c))


def json_nodes(docs: DataFrame, f: Fields) -> DataFrame:
    """Clause rows of JSON standards, with their members in the map ``m``."""
    group = F.coalesce(*[F.concat(F.lit(f"{k}_"), F.get_json_object("text", f"$.{k}")) for k in readers.GROUP_FIELDS], F.regexp_replace("file_name", r"\.[^.]*$", ""))
    arrays = F.array(*[F.struct(F.lit(i).alias("array_no"), F.from_json(F.get_json_object("text", f"$.{k}"), _MAP).alias("rows")) for i, k in enumerate(readers.CLAUSE_FIELDS)])
    x = docs.filter(F.get_json_object("text", "$.glossary").isNull()).select("file_ord", group.alias("group_key"), F.explode(arrays).alias("a")).select("file_ord", "group_key", "a.array_no", F.posexplode("a.rows").alias("place", "m")).filter("m is not null")
    ident = F.coalesce(*([_member(f.id)] if f.id else []), *[_member(n) for n in ("section", "id", "title")], F.lit("unknown"))
    tags, notes = _list(_member(f.tag)), _list(_member(f.notes))
    return x.select(
        F.lit(STD).alias("std"), "group_key", (F.col("file_ord").cast("bigint") * 10**9 + F.col("array_no").cast("bigint") * 10**8 + F.col("place")).alias("node_ord"), ident.alias("node_id"), _member(f.title or "title").alias("title"), _member(f.type or "type").alias("node_type"),
        _member(f.text or "text").alias("text"), _list(_member(f.tag or "tags")).alias("tags"), notes.alias("notes"), F.coalesce(_member(f.risk), F.lit("all")).alias("risk"),
        T.node_text(_member(f.text), _member(f.title), notes, tags).alias("node_text"), F.array_compact(F.flatten(F.array(*[F.coalesce(_list(_member(r)), F.array().cast("array<string>")) for r in (*f.references, "cross_references")]))).alias("refs"),
    )


def markdown_nodes(spark: SparkSession, path: str, after: int) -> DataFrame:
    """The same of markdown standards. References are objects there; the title's first number is the part."""
    c = readers.markdown_standard(spark, path)
    refs = F.transform("cross_references", lambda r: F.to_json(F.struct(r.part.alias("part"), F.nullif(r.section, F.lit("")).alias("section"), r.context.alias("context"))))
    part = F.coalesce(F.col("part"), F.lit("1"))
    return c.select(
        F.lit(STD).alias("std"), F.concat(F.lit("part_"), part).alias("group_key"), (F.lit(after).cast("bigint") * 10**9 + F.coalesce(part.try_cast("bigint"), F.lit(0)) * 10**6 + F.col("section_no")).cast("bigint").alias("node_ord"), F.col("section").alias("node_id"), "title", F.col("type").alias("node_type"), "text", "tags", "notes",
        F.when(F.col("asil_level") == "", "all").otherwise(F.col("asil_level")).alias("risk"), T.node_text(F.col("text"), F.col("title"), F.col("notes"), F.col("tags")).alias("node_text"), refs.alias("refs"),
    )


def reference_edges(nodes: DataFrame) -> DataFrame:
    """(std, node_ord, edge_ord, src, target) of references that are objects; texts make no edge."""
    x = nodes.select("std", "group_key", "node_ord", "node_id", F.posexplode("refs").alias("edge_ord", "r")).filter(F.col("r").startswith("{"))
    m = F.from_json("r", "struct<part:string,section:string,clause:string,process:string,control:string>")
    x = x.withColumn("x", m)
    target = F.concat_ws(":", F.concat(F.lit("part_"), F.col("x.part")), *[F.col(f"x.{n}") for n in structure.REFERENCE_MEMBERS])
    return x.select("std", "node_ord", "edge_ord", F.concat_ws(":", "group_key", "node_id").alias("src"), F.when(target == "", F.col("r")).otherwise(target).alias("target"))


def required_methods(docs: DataFrame, f: Fields, target: str | None) -> DataFrame:
    """(std, activity, method) of the tables in the method fields of documents and annexes, for the target."""
    if not f.methods:
        return docs.limit(0).select(F.lit(STD).alias("std"), F.lit("").alias("activity"), F.lit("").alias("method"))
    table = F.from_json(F.col("t"), "map<string,string>")
    tops = F.flatten(F.array(*[F.coalesce(F.from_json(F.get_json_object("text", f"$.{n}"), "array<string>"), F.array().cast("array<string>")) for n in f.methods]))
    annexes = F.coalesce(F.from_json(F.get_json_object("text", "$.annexes"), _MAP), F.array().cast(_MAP))
    deep = F.flatten(F.transform(annexes, lambda a: F.flatten(F.array(*[F.coalesce(F.from_json(a[n], "array<string>"), F.array().cast("array<string>")) for n in (*f.methods, "tables")]))))
    x = docs.select(F.explode(F.concat(tops, deep)).alias("t")).filter(F.col("t").startswith("{")).select(table.alias("m"))
    lists = F.flatten(F.array(*[F.coalesce(F.from_json(_member(n), _MAP), F.array().cast(_MAP)) for n in dict.fromkeys((*f.methods, "methods"))]))
    x = x.select(F.coalesce(_member("activity"), _member(f.title or "title"), F.lit("")).alias("activity"), F.explode(lists).alias("m"))
    levels = F.coalesce(_member("ASIL"), _member("level"), _member("asil"))
    x = x.select("activity", F.coalesce(_member("method"), _member("name"), _member("technique"), F.lit("")).alias("method"), levels.alias("levels"))
    if target:
        x = x.filter(F.coalesce(~F.col("levels").startswith("["), F.lit(True)) | F.array_contains(F.coalesce(F.from_json("levels", "array<string>"), F.array().cast("array<string>")), target))
    return x.select(F.lit(STD).alias("std"), "activity", "method")


def found_scale(nodes: DataFrame) -> list[str]:
    """The levels that occur, ranges and lists taken apart, as numbers if all are; a handful of values."""
    plain = F.when(F.col("risk").startswith("["), F.from_json("risk", "array<string>")).when(F.contains("risk", F.lit("-")) & (F.length("risk") <= 5), F.split("risk", "-")).when(~F.lower("risk").isin("all", "n/a", "none", ""), F.array("risk"))
    levels = nodes.select(F.explode(plain).alias("v")).distinct().agg(F.collect_list("v").alias("v"))
    return list(levels.select(requirements.sorted_levels(F.col("v")).alias("v")).first().v or [])


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of a file or folder: structured JSON by its fields, documents by what their text shows.
    Where documents can't be read at all, what is JSON is taken."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if os.path.isdir(path) or ext in DOCUMENTS:
        x = readers.document_files(spark, path)
        none = F.lit(None).cast("string")
        link = lambda a, b: F.struct(a.alias("from"), b.alias("to"), none.alias("type"))
        ends = F.concat(F.transform("derived_from", lambda v: link(v, none)), F.transform("traced_to", lambda v: link(none, v)))
        x = x.withColumns({"links": ends, "metadata": F.lit(None).cast("map<string,string>")})
    else:
        x = readers.json_artifacts(spark, path)
    return x.select(F.lit(STD).alias("std"), "art_ord", F.col("id").alias("art_id"), F.lit(None).cast("string").alias("project_id"), "title", "full_text", "status", "tags", "methods", "mapped", "links", "metadata")


class FileModel(Model):
    """The model of one standard and its artifacts, from files."""

    def __init__(self, spark: SparkSession, standard: str, artifact: str, settings: str | None = None):
        self.spark, self.fuzzy, self.made = spark, True, {}
        meta = readers.settings(settings or readers.own_settings(standard) or "")
        docs = readers.standard_documents(spark, standard).cache()
        self.fields = find_fields(docs, meta.get("field_mappings"))
        self.nodes = json_nodes(docs, self.fields)
        if readers.has_markdown(standard):
            self.nodes = self.nodes.unionByName(markdown_nodes(spark, standard, 10**6))
        self.arts = artifacts(spark, artifact).cache()
        self.target, self.groups = readers.target_and_scope(self.arts)
        self.scale = [str(v) for v in meta.get("risk_scale") or (found_scale(self.nodes) if self.fields.risk else [])]
        rules = [(r.from_item, r.to_item) for r in structure.trace_rules(docs).orderBy("file_name", "place").collect()]
        rules += [(r.get("from"), r.get("to")) for r in meta.get("traceability_paths", []) if isinstance(r, dict)]
        self.rules = [(i, a or "", b or "") for i, (a, b) in enumerate(rules, 1)]
        self.tables = required_methods(docs, self.fields, self.target)
        self.unread = readers.unread(readers.extracted(readers.binary_files(spark, artifact)))

    def edges(self) -> DataFrame:
        return L.reference_states(reference_edges(self.nodes), self.arts)

    def required(self) -> DataFrame:
        return self.tables


def report_sections(m: Model) -> dict[str, DataFrame]:
    """The data sets of a report, each in its order."""
    scores, findings, gaps = m.scores(), m.findings(), m.gaps()
    lines = L.recommendations(gaps)
    unread = {"unread": m.unread.orderBy("path")} if isinstance(m, FileModel) else {}
    return unread | {
        "scores": L.weighted_scores(scores).orderBy("std", "layer_ord"), "overall": L.overall(scores).orderBy("std"), "decision": L.decision(L.overall(scores), findings).orderBy("std"), "severities": L.severity_histogram(findings), "layers": L.layer_stats(findings).orderBy("layer"),
        "gaps": gaps.orderBy("std", F.desc("weighted_risk"), "layer_ord", "finding_ord", "gap_key"), "recommendations": lines.orderBy("std", "place"), "advice": L.gap_advice(gaps, lines).orderBy("std", "gap_key"), "heat_map": L.gap_heat_map(findings, gaps).orderBy("std", "place"), "actions": structure.corrective_actions(lines).orderBy("std", "place"),
        "matrix": L.compliance_matrix(m.layers()["node_coverage"], m.layers()["content_alignment"]).orderBy("std", "place"), "matrix_summary": L.matrix_summary(m.layers()["node_coverage"]).orderBy("std"), "register": L.register(m.arts, findings).orderBy("std", "art_ord"), "traces": L.trace_matrix(m.arts).orderBy("std", "art_ord", "node_id"),
        "trace_coverage": L.trace_coverage(m.reqs, m.arts).orderBy("std"), "orphan_requirements": L.orphan_requirements(m.reqs, m.arts).orderBy("std", "node_id"), "appendix": L.appendix(findings).orderBy("std", "place"), "findings": findings.orderBy("std", "layer_ord", "finding_ord"),
    }


def report_head(standard: str, now: str) -> dict:
    """What a report begins with; the time stays out of everything that is compared."""
    names = {"26262": "ISO 26262", "21434": "ISO/SAE 21434", "sotif": "ISO 21448", "aspice": "Automotive SPICE"}
    return {"generated_at": now, "standard": next((v for k, v in names.items() if k in standard.lower()), os.path.basename(standard.rstrip("/")))}
