"""Files to DataFrames. A file that can't be read becomes a row with its error, never a failure."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from traceloom.functions import text as T
from traceloom.functions import vocabulary as V
from traceloom.operators import sections
from traceloom.session import ship
from traceloom.sources.extract import EXTENSIONS, decode, extract

FILES = "path string, file_name string, title string, text string, error string"

# Names that an artifact's fields go by.
ARTIFACT_FIELDS = {
    "id": ("id", "wp_id", "artifact_id", "document_id", "ref", "number"),
    "title": ("title", "name", "heading", "subject", "label"),
    "text": ("content", "text", "body", "description", "full_text"),
    "sections": ("sections", "chapters", "parts", "blocks", "paragraphs"),
    "tags": ("tags_addressed", "tags", "topics", "concepts", "keywords", "categories"),
    "methods": ("methods_used", "methods", "techniques", "practices", "tools_used"),
    "mapped": ("mapped_sections", "mapped_clauses", "addresses", "covers", "mapped_requirements", "applicable_clauses"),
    "links": ("traceability_links", "traces", "links", "dependencies"),
    "status": ("status", "state", "completion", "maturity"),
}
# Names that arrays of artifacts, and of clauses, go by; names of level and scope.
ARRAY_FIELDS = ("work_products", "artifacts", "documents", "deliverables", "items", "records")
CLAUSE_FIELDS = ("clauses", "sections", "requirements", "controls", "processes", "practices", "objectives", "entries")
GROUP_FIELDS = ("part", "chapter", "module", "process", "domain", "section", "volume", "area")
LEVEL_FIELDS = ("target_asil", "asil", "target_risk", "risk_level", "sil", "cal", "target_level", "capability_level")
SCOPE_FIELDS = ("parts_in_scope", "scope", "applicable_parts", "in_scope", "modules")
ARTIFACT = "art_ord bigint, id string, title string, full_text string, status string, tags array<string>, methods array<string>, mapped array<string>, links array<struct<from:string,to:string,type:string>>, metadata map<string,string>"


def binary_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of files of known kinds."""
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return binary_files(spark, path).drop("content").filter(kind.isin(*EXTENSIONS))


def extracted(files: DataFrame) -> DataFrame:
    """FILES of binary files: what they say, or why they couldn't be read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = path.rpartition("/")[2]
                try:
                    rows.append((path, name, *extract(name, data), None))
                except Exception as e:  # one bad file must not end the job
                    rows.append((path, name, None, None, f"{type(e).__name__}: {e}"[:500]))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "file_name", "title", "text", "error"])

    return files.select("path", "content").mapInArrow(run, FILES)


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a known kind as an artifact, numbered by path, with what its text shows."""
    kind = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    x = extracted(binary_files(spark, path).filter(kind.isin(*EXTENSIONS))).filter("error is null")
    text = F.col("text")
    a, b = T.traces_in_text(text)
    # numbering files needs one order over their names; only names and titles pass through it
    ids = x.select("path").withColumn("art_ord", F.row_number().over(Window.orderBy("path")))
    return x.join(ids, "path").select(
        F.col("art_ord").cast("bigint").alias("art_ord"), F.concat(F.lit("WP-"), F.lpad("art_ord", 3, "0")).alias("id"), "title", text.alias("full_text"), F.lit("complete").alias("status"),
        T.terms_in_text(text, V.CONCEPT_TERMS).alias("tags"), T.terms_in_text(text, V.METHOD_TERMS).alias("methods"), T.clauses_in_text(text).alias("mapped"), a.alias("derived_from"), b.alias("traced_to"),
    )


def _first(item: dict, names: tuple[str, ...]):
    return next((item[n] for n in names if n in item), None)


def _section_texts(item: dict) -> list[str]:
    out = []
    for n in ARTIFACT_FIELDS["sections"]:
        for s in item[n] if isinstance(item.get(n), list) else ():
            if isinstance(s, dict):
                out.append(f"{s.get('title', s.get('heading', ''))} {s.get('content', s.get('text', s.get('body', '')))}")
            elif isinstance(s, str):
                out.append(s)
    return out


def _texts(item: dict, names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        v = item.get(n)
        out += [str(x) for x in v if x is not None] if isinstance(v, list) else [str(v)] if isinstance(v, str) and v else []
    return list(dict.fromkeys(out))


def artifact_rows(text: str) -> list[tuple]:
    """Artifacts of one JSON text: under one of the array names, a list, or a single object."""
    data = json.loads(text)
    project = data.get("project") if isinstance(data, dict) else None
    project = project if isinstance(project, dict) else {}
    items = data if isinstance(data, list) else next((data[n] for n in ARRAY_FIELDS if isinstance(data.get(n), list)), [data])
    known = {n for names in ARTIFACT_FIELDS.values() for n in names}
    rows = []
    for item in (i for i in items if isinstance(i, dict)):
        f = ARTIFACT_FIELDS
        links = [(x.get("from"), x.get("to"), x.get("type")) for n in f["links"] for x in (item.get(n) if isinstance(item.get(n), list) else ()) if isinstance(x, dict)]
        status = next((str(item[n]).lower() for n in reversed(f["status"]) if n in item), "")
        more = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in {**{k: v for k, v in item.items() if k not in known}, **project}.items() if v is not None}
        rows.append((str(_first(item, f["id"]) or ""), str(_first(item, f["title"]) or ""), " ".join([*(item[n] for n in f["text"] if isinstance(item.get(n), str)), *_section_texts(item)]), status, [t.lower() for t in _texts(item, f["tags"])], [t.lower() for t in _texts(item, f["methods"])], _texts(item, f["mapped"]), links, more))
    return rows


def json_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """ARTIFACT rows of structured JSON files, in the order of paths and places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link = pa.struct([("from", pa.string()), ("to", pa.string()), ("type", pa.string())])
        schema = pa.schema([("path", pa.string()), ("place", pa.int32()), ("id", pa.string()), ("title", pa.string()), ("full_text", pa.string()), ("status", pa.string()), ("tags", pa.list_(pa.string())), ("methods", pa.list_(pa.string())), ("mapped", pa.list_(pa.string())), ("links", pa.list_(link)), ("metadata", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(p, i, *r) for i, r in enumerate(artifact_rows(decode(data)))]
                except ValueError:
                    continue
            cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in schema]
            cols[9] = [[dict(zip(("from", "to", "type"), x)) for x in v] for v in cols[9]]
            cols[10] = [list(v.items()) for v in cols[10]]
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    raw = binary_files(spark, path, "*.json").select("path", "content").mapInArrow(run, "path string, place int, " + ARTIFACT.split(", ", 1)[1])
    order = raw.select("path", "place").withColumn("art_ord", F.row_number().over(Window.orderBy("path", "place")).cast("bigint"))
    return raw.join(order, ["path", "place"]).drop("path", "place")


def target_and_scope(artifacts: DataFrame) -> tuple[str | None, list[str] | None]:
    """Level and groups from the first artifact's metadata: one row for the driver."""
    first = artifacts.orderBy("art_ord").select("metadata").limit(1).collect()
    meta = (first[0].metadata or {}) if first else {}
    level = next((meta[k] for k in LEVEL_FIELDS if k in meta), None)
    for k in SCOPE_FIELDS:
        if k in meta:
            try:
                value = json.loads(meta[k])
            except ValueError:
                continue
            if isinstance(value, list):
                return level, [f"part_{p}" for p in value]
    return level, None


def standard_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of markdown standards; readme, changelog and license files are left out."""
    x = extracted(binary_files(spark, path, "*.md", recursive=False)).filter("error is null")
    return x.filter(~F.lower("file_name").rlike("^(readme|changelog|license)")).select("file_name", "text")


def markdown_standard(spark: SparkSession, path: str) -> DataFrame:
    """Clause rows of markdown standards with their part; of files of one part the last by name
    counts, files without a part are left out."""
    x = standard_texts(spark, path)
    part = T.part_number(F.substring("text", 1, 2000), F.col("file_name"))
    last = x.withColumn("part", F.when(part == "", None).otherwise(part)).filter("part is not null").groupBy("part").agg(F.max(F.struct("file_name", "text")).alias("f"))
    return sections.clauses(last.select(F.col("part").alias("doc_id"), F.col("f.text").alias("text"))).withColumnRenamed("doc_id", "part")


#: JSON files of a standard's folder that are no part of it, by their names.
NOT_STANDARDS = r"compliance_report|^compliance_meta\.json$"


def json_standard(spark: SparkSession, path: str, skip: str = NOT_STANDARDS) -> DataFrame:
    """Clause rows of JSON standards: the arrays under 'clauses', 'sections' and the like, with group
    and file; glossary-only files give none, and neither do reports and the settings file, known by their names."""
    schema = "array<struct<section:string,id:string,title:string,type:string,text:string,tags:array<string>,asil_level:string,notes:array<string>,cross_references:array<string>>>"
    x = extracted_json(spark, path).filter(~F.col("file_name").rlike(skip))
    arrays = [F.from_json(F.get_json_object("text", f"$.{n}"), schema) for n in CLAUSE_FIELDS]
    rows = F.flatten(F.array_compact(F.array(*arrays)))
    group = F.coalesce(*[F.concat(F.lit(f"{k}_"), F.get_json_object("text", f"$.{k}")) for k in GROUP_FIELDS], F.regexp_replace("file_name", r"\.json$", ""))
    c = x.filter(F.get_json_object("text", "$.glossary").isNull()).select("file_name", group.alias("group_key"), F.get_json_object("text", "$.title").alias("group_title"), F.posexplode(rows).alias("place", "c"))
    return c.select("file_name", "group_key", "group_title", "place", F.coalesce("c.section", "c.id", "c.title", F.lit("unknown")).alias("node_id"), "c.title", F.col("c.type").alias("node_type"), "c.text", "c.tags", "c.notes", F.coalesce("c.asil_level", F.lit("all")).alias("risk"), F.col("c.cross_references").alias("refs"))


def extracted_json(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of JSON files, as written."""
    x = binary_files(spark, path, "*.json", recursive=False)
    return x.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.decode("content", "UTF-8").alias("text"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, term, definition, source) of glossary files."""
    rows = F.from_json(F.get_json_object("text", "$.glossary"), "array<struct<term:string,definition:string,source:string>>")
    return extracted_json(spark, path).select("file_name", F.explode(rows).alias("g")).select("file_name", "g.*")


# How a standard's folder names its settings, and the reports left there.
SETTINGS_NAME, REPORT_NAME = "compliance_meta.json", "compliance_report"


def own_settings(path: str) -> str | None:
    """The settings file in a standard's folder, if it has one."""
    inside = os.path.join(path, SETTINGS_NAME)
    return inside if os.path.isdir(path) and os.path.exists(inside) else None


def settings(path: str) -> dict:
    """A settings file, read by the driver: field_mappings, risk_scale, traceability_paths; empty if there is none."""
    if not path or not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return {k: data[k] for k in ("field_mappings", "risk_scale", "traceability_paths") if k in data}


def has_markdown(path: str) -> bool:
    return path.lower().endswith(".md") or os.path.isdir(path) and any(n.lower().endswith(".md") for n in os.listdir(path))


def standard_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file_ord, file_name, text) of a standard's JSON files, by name; settings and reports are left out.
    A markdown file or a converted PDF has none."""
    if os.path.isdir(path):
        x = extracted_json(spark, path).filter((F.col("file_name") != SETTINGS_NAME) & ~F.contains("file_name", F.lit(REPORT_NAME)))
    elif path.lower().endswith(".json"):
        x = extracted_json(spark, path)
    elif path.lower().endswith(".md"):
        return spark.createDataFrame([], "file_ord int, file_name string, text string")
    else:
        raise ValueError(f"neither .json nor .md: {path}")
    # a standard is a handful of files; only their names are numbered
    order = x.select("file_name").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy("file_name")))
    return x.join(F.broadcast(order), "file_name").select("file_ord", "file_name", "text")


def unread(files: DataFrame) -> DataFrame:
    """(path, error) of the files that couldn't be read."""
    return files.filter("error is not null").select("path", "error")


def newest_file(spark: SparkSession, path: str, glob: str = "*") -> str | None:
    """The path of the file that was changed last; of equal times the last by name."""
    row = binary_files(spark, path, glob).agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()
    return row.m.path if row.m else None


def saved_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def standard(spark: SparkSession, path: str) -> DataFrame:
    """Clause rows of one file or a folder, JSON or markdown."""
    if path.lower().endswith(".md"):
        return markdown_standard(spark, path)
    if path.lower().endswith(".json"):
        return json_standard(spark, path)
    if "." in path.rstrip("/").rpartition("/")[2]:
        raise ValueError(f"neither .json nor .md: {path}")
    return json_standard(spark, path)
