"""Queries over texts, tags, references and files' content; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from traceloom.functions import text as T
from traceloom.functions import vocabulary as V
from traceloom.operators import discovery, requirements, sections
from traceloom.plans.compliance import _IS_REQ, BASE, RULES, Model, _list
from traceloom.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
N = lambda: F.count(F.lit(1))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements.first_delivery(table(spark, sf_dir, "part_3_concept"), "clause_key")


_C = "WITH c AS (SELECT * FROM part_3_concept QUALIFY row_number() OVER (PARTITION BY clause_key ORDER BY loaded_at) = 1), "
_LINES = "WITH l AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)), "

# ---- lines, headings, sections


@query(_LINES + "x AS (SELECT doc_id, line_no, line, length(regexp_extract(line, '^(#+)', 1)) AS level FROM l) SELECT doc_id, line_no, CAST(level AS INTEGER) AS level, trim(regexp_replace(line, '^#+[ \\t]*', '')) AS heading FROM x WHERE level > 0")
def heading_levels(spark, sf_dir):
    x = sections.lines(_docs(spark, sf_dir)).withColumn("level", T.heading_level(F.col("line"))).filter("level > 0")
    return x.select("doc_id", "line_no", "level", F.trim(F.regexp_replace("line", r"^#+[ \t]*", "")).alias("heading"))


@query(_LINES + r"x AS (SELECT doc_id, line_no, regexp_extract(trim(regexp_replace(line, '[*_`]', '', 'g')), '^([A-Z][0-9A-Z.]*|[0-9][0-9.]*)[ \t]+(.*)$', 1) AS section FROM l) SELECT doc_id, line_no, section, CAST(len(string_split(section, '.')) + 1 AS INTEGER) AS level FROM x WHERE section <> ''")
def section_ids(spark, sf_dir):
    x = sections.lines(_docs(spark, sf_dir)).withColumn("section", F.regexp_extract(F.trim(F.regexp_replace("line", r"[*_`]", "")), r"^([A-Z][0-9A-Z.]*|[0-9][0-9.]*)[ \t]+(.*)$", 1))
    return x.filter("section <> ''").select("doc_id", "line_no", "section", T.section_level(F.col("section")).alias("level"))


@query(_LINES + """x AS (SELECT *, length(regexp_extract(line, '^(#+)', 1)) AS level FROM l), s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM x)
SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, CAST(max(level) AS INTEGER) AS level, count(*) - 1 AS n_lines FROM s WHERE section_no > 0 GROUP BY doc_id, section_no""")  # fmt: skip
def section_segments(spark, sf_dir):
    x = sections.lines(_docs(spark, sf_dir)).withColumn("level", T.heading_level(F.col("line")))
    x = x.withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no"))).filter("section_no > 0")
    return x.groupBy("doc_id", F.col("section_no").cast("int").alias("section_no")).agg(F.max("level").alias("level"), (N() - 1).alias("n_lines"))


@query(_LINES + r"""x AS (SELECT *, length(regexp_extract(line, '^(#+)', 1)) AS level FROM l), s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM x)
SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, CAST(max(level) AS INTEGER) AS level, max(CASE WHEN level > 0 THEN regexp_replace(line, '^#+\s*', '') END) AS heading, regexp_replace(coalesce(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY line_no), ''), '^\s+|\s+$', '', 'g') AS body FROM s WHERE section_no > 0 GROUP BY doc_id, section_no""".replace("\\\\", "\\"))
def markdown_sections(spark, sf_dir):
    return sections.markdown_sections(_docs(spark, sf_dir))


_WHOLE = "title IS NOT NULL AND trim(title) <> '' AND text IS NOT NULL"


@query(BASE + f"""x AS (SELECT std || '/' || group_key || '/' || split_part(node_id, '.', 1) AS doc_id, node_id AS section, trim(title) AS title, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text FROM nodes WHERE {_WHOLE})
SELECT doc_id, section, title, CASE WHEN text = '' THEN 'overview' WHEN {'regexp_matches(text, ' + repr('(?i)(^|[^A-Za-z0-9_])shall($|[^A-Za-z0-9_])') + ')'} THEN 'requirement' WHEN {'regexp_matches(text, ' + repr('(?i)(^|[^A-Za-z0-9_])should($|[^A-Za-z0-9_])') + ')'} THEN 'recommendation'
WHEN {'regexp_matches(text, ' + repr('(?i)(^|[^A-Za-z0-9_])may($|[^A-Za-z0-9_])') + ')'} THEN 'permission' WHEN regexp_matches(text, '(?m)^\\s*(NOTE|EXAMPLE)') THEN 'guideline' ELSE 'overview' END AS type FROM x""")
def parse_clauses(spark, sf_dir):
    """Chapters of the standards written as markdown and parsed again."""
    n = Model(spark, sf_dir).nodes.filter(_WHOLE).withColumn("doc_id", F.concat_ws("/", "std", "group_key", F.element_at(F.split("node_id", r"\."), 1)))
    piece = F.concat(F.lit("## "), "node_id", F.lit(" "), F.trim("title"), F.lit("\n"), "text")
    docs = n.groupBy("doc_id").agg(F.concat(F.lit("# Chapter\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", piece.alias("piece")))), lambda x: x["piece"]), "\n")).alias("text"))
    return sections.clauses(docs).select("doc_id", "section", "title", "type")


@query(_LINES + r"x AS (SELECT doc_id, line_no, trim(line) AS b FROM l) SELECT doc_id, line_no FROM x WHERE starts_with(b, '#') OR regexp_matches(b, '^[0-9]+\.[0-9.]*[ \t]+[A-Za-z0-9_]') OR (upper(b) = b AND regexp_matches(b, '[A-Z]') AND length(b) BETWEEN 4 AND 79)")
def text_sections(spark, sf_dir):
    return sections.text_sections(_docs(spark, sf_dir)).select("doc_id", "line_no")


@query(_LINES + r"x AS (SELECT trim(line) AS b FROM l) SELECT count(*) AS n_lines, count(*) FILTER (b <> '' AND regexp_matches(b, '^[0-9]+$|All rights reserved|DRAFT INTERNATIONAL STANDARD|COPYRIGHT PROTECTED DOCUMENT|KdNr\.[0-9]+')) AS n_noise FROM x")
def noise_lines(spark, sf_dir):
    x = sections.lines(_docs(spark, sf_dir))
    return x.agg(N().alias("n_lines"), F.count_if(T.is_noise_line(F.col("line"))).alias("n_noise"))


# ---- what clause texts hold


def _word(w: str) -> str:
    return f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])')"


@query(_C + f"""x AS (SELECT clause_key, CASE WHEN coalesce(text, '') = '' THEN 'overview' WHEN {_word('shall')} THEN 'requirement' WHEN {_word('should')} THEN 'recommendation' WHEN {_word('may')} THEN 'permission'
WHEN regexp_matches(text, '(?m)^\\s*(NOTE|EXAMPLE)') THEN 'guideline' ELSE 'overview' END AS type FROM c) SELECT * FROM x""")
def classify_clauses(spark, sf_dir):
    return _clauses(spark, sf_dir).select("clause_key", T.clause_class(F.col("text")).alias("type"))


@query(_C + "x AS (SELECT clause_key, n FROM (SELECT clause_key, unnest(notes) AS n FROM c)) SELECT clause_key, count(*) AS n_notes FROM x WHERE regexp_matches(n, '^(NOTE|EXAMPLE)[ ]') GROUP BY 1")
def extract_notes(spark, sf_dir):
    x = _clauses(spark, sf_dir).select("clause_key", F.explode("notes").alias("n")).filter(F.col("n").rlike("^(NOTE|EXAMPLE)[ ]"))
    return x.filter(F.size(T.notes_in_text(F.col("n"))) > 0).groupBy("clause_key").agg(N().alias("n_notes"))


_REF = "(?i)(?:see|in accordance with|according to|per)\\s+([^.;:]+)"


@query(BASE + f"""x AS (SELECT node_ord, unnest(regexp_extract_all(node_text, '{_REF}', 1)) AS c FROM nodes)
SELECT node_ord, regexp_extract(c, 'Part\\s+(\\d+)', 1) AS part, regexp_extract(c, '(?:Clause|Section)?\\s+(\\d+\\.\\d+(?:\\.\\d+)?)', 1) AS section, substring(trim(c), 1, 100) AS context FROM x WHERE regexp_extract(c, 'Part\\s+(\\d+)', 1) <> ''""")
def extract_refs(spark, sf_dir):
    return Model(spark, sf_dir).nodes.select("node_ord", F.explode(T.references_in_text(F.col("node_text"))).alias("r")).select("node_ord", "r.*")


_NUM = "([0-9]+(?:\\.[0-9]+)*)"


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?i)(?:ISO|IEC)\\s+\\d+(?:-\\d+)?\\s+{_NUM}', 1), list_concat(regexp_extract_all(text, '(?i)(?:clause|section|per|subsection|sub-section)\\s+{_NUM}', 1),
regexp_extract_all(text, '(?i)(?:requires?|satisfies?|per|derived?\\s+from|traced?\\s+to|mapped?\\s+to)\\s+{_NUM}', 1))))), ';') AS clauses FROM documents WHERE text IS NOT NULL""")
def detect_clauses(spark, sf_dir):
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.array_join(T.clauses_in_text(F.col("text")), ";").alias("clauses"))


def _marked(x: str) -> str:
    """A text with marks around its words, so that a term is bounded where the marked one is contained."""
    return f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_]+)', chr(1) || '\\1' || chr(2), 'g')"


def _terms_sql(terms) -> str:
    return f"WITH d AS (SELECT doc_id, {_marked('lower(text)')} AS t FROM documents WHERE text IS NOT NULL), v AS (SELECT term, {_marked('term')} AS m FROM (SELECT DISTINCT unnest({_list(sorted(set(terms)))}) AS term)) SELECT doc_id, term FROM d JOIN v ON contains(t, m)"


@query(_terms_sql(V.CONCEPT_TERMS))
def detect_vocabulary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.terms_in_text(F.col("text"), V.CONCEPT_TERMS)).alias("term"))


@query(_terms_sql(V.METHOD_TERMS))
def detect_methods(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.terms_in_text(F.col("text"), V.METHOD_TERMS)).alias("term"))


@query(f"WITH d AS (SELECT doc_id, {_marked('lower(text)')} AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, name AS term FROM d JOIN (SELECT name, {_marked('name')} AS m FROM (SELECT DISTINCT lower(name) AS name FROM term_catalog WHERE name <> '')) ON contains(t, m)")
def detect_catalog_terms(spark, sf_dir):
    # the list of terms is a fixed table
    terms = [r.name.lower() for r in table(spark, sf_dir, "term_catalog").select("name").distinct().collect() if r.name]
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.explode(T.terms_in_text(F.col("text"), terms)).alias("term"))


_TAIL = "\\s+([A-Za-z0-9\\s\\-_]+?)(?:[.,;\\n]|$)"


def _traces(*patterns: str) -> str:
    every = "[]"
    for p in patterns:
        every = f"list_concat({every}, regexp_extract_all(full_text, '(?i){p}{_TAIL}', 1))"
    return f"list_distinct(list_filter(list_transform({every}, lambda v: trim(v)), lambda v: v <> '' AND length(v) < 200))"


@query(BASE + f"""x AS (SELECT art_ord, list_sort({_traces('(?:derives?|derived)' + chr(92) + 's+from')}) AS f, list_sort({_traces('(?:traced?|traces)' + chr(92) + 's+to', 'satisfies?', 'verified?' + chr(92) + 's+by')}) AS t FROM arts) SELECT art_ord, array_to_string(f, ';') AS derived_from, array_to_string(t, ';') AS traced_to FROM x WHERE len(f) + len(t) > 0""")
def detect_trace(spark, sf_dir):
    a, b = T.traces_in_text(F.col("full_text"))
    x = Model(spark, sf_dir).arts.select("art_ord", F.array_sort(a).alias("a"), F.array_sort(b).alias("b")).filter(F.size("a") + F.size("b") > 0)
    return x.select("art_ord", F.array_join("a", ";").alias("derived_from"), F.array_join("b", ";").alias("traced_to"))


@query(f"""WITH d AS (SELECT doc_id, text, {_marked('lower(text)')} AS t FROM documents WHERE text IS NOT NULL), k AS (SELECT unnest({_list(V.TAG_KEYWORDS)}) AS kw),
m AS (SELECT doc_id, upper(trim(unnest(regexp_extract_all(text, '[*_]{{1,2}}([A-Za-z\\s]+?)[*_]{{1,2}}', 1)))) AS tag FROM d), u AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b([A-Z][A-Z0-9]{{2,}})\\b', 1)) AS tag FROM d)
SELECT DISTINCT doc_id, tag FROM (SELECT * FROM m WHERE tag IN ({', '.join(repr(x) for x in (*V.TAG_ACRONYMS, *V.EMPHASISED_ACRONYMS))}) UNION ALL SELECT * FROM u WHERE tag IN ({', '.join(repr(x) for x in V.TAG_ACRONYMS)}) UNION ALL SELECT doc_id, upper(kw[1]) || kw[2:] FROM d JOIN k ON contains(t, chr(1) || kw || chr(2)))""")
def extract_tags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.tags_in_text(F.col("text"))).alias("tag"))


@query(BASE + r"""x AS (SELECT node_ord, regexp_replace(regexp_replace(trim(regexp_extract(node_text || coalesce(' ASIL ' || risk, ''), '(?i)ASIL\s*[:(]?\s*([A-D][\s,A-D\-&/]*[A-D]?)', 1)), '\s+', ' ', 'g'), '[()\[\]]', '', 'g') AS level FROM nodes) SELECT node_ord, level FROM x WHERE level <> ''""".replace("\\\\", "\\"))
def levels_in_text(spark, sf_dir):
    """Levels that a clause's text, followed by its field, names."""
    text = F.concat("node_text", F.coalesce(F.concat(F.lit(" ASIL "), "risk"), F.lit("")))
    return Model(spark, sf_dir).nodes.select("node_ord", T.level_in_text(text).alias("level")).filter("level <> ''")


@query(BASE + r"""x AS (SELECT node_ord, coalesce(nullif(regexp_extract(group_key || '_' || node_id || '.md', '(?i)part[_\s-]*(\d+)', 1), ''), '') AS part FROM nodes) SELECT node_ord, part FROM x""".replace("\\\\", "\\"))
def part_numbers(spark, sf_dir):
    """The part that a file named after a clause would tell."""
    return Model(spark, sf_dir).nodes.select("node_ord", T.part_number(F.coalesce("text", F.lit("")), F.concat_ws("_", "group_key", F.concat("node_id", F.lit(".md")))).alias("part"))


@query(None)
def layout_sections(spark, sf_dir):
    return sections.layout_sections(_docs(spark, sf_dir))


@query("SELECT doc_id, coalesce(len(list_filter(string_split(text, chr(10))[1:100], lambda l: starts_with(l, '#'))) = 0 AND len(list_filter(string_split(text, chr(10))[1:100], lambda l: length(l) > 40 AND length(l) - length(ltrim(l, ' ')) > 30)) > 10, false) AS is_layout FROM documents")
def layout_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(sections.is_layout_text(F.col("text")), F.lit(False)).alias("is_layout"))


@query("SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'supplier', ''))) // 8 AS n_hits FROM documents WHERE contains(lower(text), 'supplier')")
def search_count(spark, sf_dir):
    low = F.lower("text")
    return _docs(spark, sf_dir).filter(F.contains(low, F.lit("supplier"))).select("doc_id", F.regexp_count(low, F.lit("supplier")).cast("bigint").alias("n_hits"))


# ---- clause tables


@query(BASE + "x AS (SELECT 1) SELECT group_key, count(*) AS n_clauses, count(*) FILTER (lower(node_type) = 'requirement') AS n_requirements FROM nodes GROUP BY 1")
def clauses_per_part(spark, sf_dir):
    return Model(spark, sf_dir).nodes.groupBy("group_key").agg(N().alias("n_clauses"), F.count_if(F.lower("node_type") == "requirement").alias("n_requirements"))


@query(BASE + "x AS (SELECT lower(trim(t)) AS tag, node_ord, node_type FROM (SELECT node_ord, node_type, unnest(tags) AS t FROM nodes) WHERE trim(t) <> '') SELECT tag, count(DISTINCT node_ord) AS n_clauses, count(DISTINCT CASE WHEN lower(node_type) = 'requirement' THEN node_ord END) AS n_requirements FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def tag_clusters(spark, sf_dir):
    x = Model(spark, sf_dir).nodes.select("node_ord", "node_type", F.explode("tags").alias("t")).filter(F.trim("t") != "").select("node_ord", "node_type", F.lower(F.trim("t")).alias("tag")).distinct()
    return x.groupBy("tag").agg(N().alias("n_clauses"), F.count_if(F.lower("node_type") == "requirement").alias("n_requirements")).orderBy(F.desc("n_clauses"), "tag").limit(10)


@query(BASE + "x AS (SELECT std, node_id, trim(r) AS target FROM (SELECT std, node_id, unnest(refs) AS r FROM nodes) WHERE trim(r) <> '') SELECT std, target, count(*) AS n_sources, array_to_string(list_sort(list_distinct(list(node_id))), ';') AS sources FROM x GROUP BY 1, 2")
def reverse_references(spark, sf_dir):
    x = Model(spark, sf_dir).nodes.select("std", "node_id", F.explode("refs").alias("r")).filter(F.trim("r") != "")
    return x.groupBy("std", F.trim("r").alias("target")).agg(N().alias("n_sources"), F.array_join(F.array_sort(F.collect_set("node_id")), ";").alias("sources"))


@query(BASE + "v AS (SELECT unnest(['A', 'B', 'C', 'D']) AS level) SELECT level, count(*) AS n FROM nodes JOIN v ON contains(risk, level) WHERE lower(node_type) = 'requirement' GROUP BY 1")
def requirements_by_level(spark, sf_dir):
    level = F.explode(F.filter(F.array(*[F.lit(x) for x in "ABCD"]), lambda x: F.contains(F.col("risk"), x))).alias("level")
    return Model(spark, sf_dir).nodes.filter(F.lower("node_type") == "requirement").select(level).groupBy("level").agg(N().alias("n"))


@query(BASE + """x AS (SELECT node_ord, 'no title' AS issue FROM nodes WHERE coalesce(trim(title), '') = '' UNION ALL SELECT node_ord, 'no type' FROM nodes WHERE coalesce(trim(node_type), '') = '' UNION ALL SELECT node_ord, 'no tags' FROM nodes WHERE coalesce(len(tags), 0) = 0
UNION ALL SELECT DISTINCT node_ord, 'reference without number' FROM (SELECT node_ord, unnest(refs) AS r FROM nodes) WHERE r IS NOT NULL AND NOT regexp_matches(r, '[0-9]')) SELECT node_ord, issue FROM x""")  # fmt: skip
def validation_issues(spark, sf_dir):
    n = Model(spark, sf_dir).nodes
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    tests = {"no title": blank("title"), "no type": blank("node_type"), "no tags": F.coalesce(F.size("tags"), F.lit(0)) == 0, "reference without number": F.coalesce(F.exists("refs", lambda r: r.isNotNull() & ~r.rlike("[0-9]")), F.lit(False))}
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return n.select("node_ord", F.explode(found).alias("issue"))


@query(BASE + "x AS (SELECT std, title, min(art_ord) AS art_ord FROM arts WHERE title <> '' GROUP BY 1, 2) SELECT std, title, art_ord FROM x")
def keep_first_dedup(spark, sf_dir):
    return Model(spark, sf_dir).arts.filter("title <> ''").groupBy("std", "title").agg(F.min("art_ord").alias("art_ord"))


@query(BASE + "x AS (SELECT project_id, art_ord, row_number() OVER (PARTITION BY project_id ORDER BY art_ord) AS n FROM arts) SELECT project_id, art_ord, 'WP-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS seq_id FROM x")
def sequence_ids(spark, sf_dir):
    x = requirements.numbered(Model(spark, sf_dir).arts.select("project_id", "art_ord"), "project_id", "art_ord")
    return x.select("project_id", "art_ord", F.concat(F.lit("WP-"), F.when(F.col("n") < 1000, F.lpad(F.col("n").cast("string"), 3, "0")).otherwise(F.col("n").cast("string"))).alias("seq_id"))


@query(BASE + "x AS (SELECT DISTINCT trim(p) AS level FROM (SELECT unnest(string_split(risk, '-')) AS p FROM nodes)) SELECT level FROM x WHERE lower(level) NOT IN ('all', 'n/a', '')")
def risk_scale(spark, sf_dir):
    return requirements.discovered_scale(Model(spark, sf_dir).nodes)


@query(BASE + "x AS (SELECT lower(trim(status)) AS s FROM arts) SELECT s AS status, count(*) AS n FROM x WHERE contains(s, 'comp') OR contains(s, 'appr') GROUP BY 1")
def status_filter(spark, sf_dir):
    x = Model(spark, sf_dir).arts.select(F.lower(F.trim("status")).alias("status"))
    return x.filter(F.contains("status", F.lit("comp")) | F.contains("status", F.lit("appr"))).groupBy("status").agg(N().alias("n"))


@query(BASE + "x AS (SELECT node_ord, risk, title, try_cast(risk AS DOUBLE) AS num FROM nodes) SELECT node_ord, risk, title FROM x ORDER BY num NULLS LAST, risk, title NULLS LAST, node_ord LIMIT 50")
def table_sort_topn(spark, sf_dir):
    n = Model(spark, sf_dir).nodes
    return n.select("node_ord", "risk", "title").orderBy(F.asc_nulls_last(F.col("risk").try_cast("double")), "risk", F.asc_nulls_last("title"), "node_ord").limit(50)


@query(BASE + "x AS (SELECT 1) SELECT node_id AS \"Section\", coalesce(title, '') AS \"Title\", coalesce(node_type, '') AS \"Type\", risk AS \"Level\", coalesce(array_to_string(list_filter(tags, lambda t: t IS NOT NULL), '; '), '') AS \"Tags\" FROM nodes")
def csv_trace_export(spark, sf_dir):
    from traceloom.sources.sinks import trace_export

    return trace_export(Model(spark, sf_dir).nodes)


@query(BASE + """m AS (SELECT count(*) AS n_methods FROM term_catalog WHERE kind = 'method') SELECT count(*) AS n_nodes, count(DISTINCT std) AS n_standards, count(DISTINCT group_key) AS n_groups, count(DISTINCT node_type) AS n_types, count(*) FILTER (title IS NULL) AS n_untitled,
CAST(sum(coalesce(len(refs), 0)) AS BIGINT) AS n_refs, CAST(sum(coalesce(len(tags), 0)) AS BIGINT) AS n_tags, CAST(sum(coalesce(len(notes), 0)) AS BIGINT) AS n_notes, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM nodes)) AS n_distinct_tags,
count(*) FILTER (""" + _IS_REQ + """) AS n_requirements, count(*) FILTER (NOT """ + _IS_REQ + """) AS n_guidelines, count(DISTINCT risk) AS n_levels, max(m.n_methods) AS n_methods, CAST(""" + str(len(RULES)) + """ AS BIGINT) AS n_rules FROM nodes, m""")  # fmt: skip
def schema_summary(spark, sf_dir):
    m = Model(spark, sf_dir)
    size = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0))).cast("bigint")
    req = T.is_requirement(F.col("node_type"), F.col("text"))
    one = m.nodes.agg(N().alias("n_nodes"), F.countDistinct("std").alias("n_standards"), F.countDistinct("group_key").alias("n_groups"), F.countDistinct("node_type").alias("n_types"), F.count_if(F.col("title").isNull()).alias("n_untitled"), size("refs").alias("n_refs"), size("tags").alias("n_tags"), size("notes").alias("n_notes"), F.count_if(req).alias("n_requirements"), F.count_if(~req).alias("n_guidelines"), F.countDistinct("risk").alias("n_levels"))
    tags = m.nodes.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("n_distinct_tags"))
    methods = m.catalog.filter("kind = 'method'").agg(N().alias("n_methods"))
    return one.crossJoin(tags).crossJoin(methods).withColumn("n_rules", F.lit(len(RULES)).cast("bigint"))  # one row each


@query(BASE + "x AS (SELECT DISTINCT trim(p) AS level FROM (SELECT unnest(string_split(risk, '-')) AS p FROM nodes)), y AS (SELECT list(level) AS ls FROM x WHERE lower(level) NOT IN ('all', 'n/a', '')) SELECT array_to_string(CASE WHEN len(list_filter(ls, lambda v: try_cast(v AS INTEGER) IS NULL)) > 0 THEN list_sort(ls) ELSE list_transform(list_sort(list_transform(ls, lambda v: CAST(v AS INTEGER))), lambda v: CAST(v AS VARCHAR)) END, ',') AS scale FROM y")
def sorted_scale(spark, sf_dir):
    """The risk scale in order, in one row: a standard has a handful of levels."""
    levels = requirements.discovered_scale(Model(spark, sf_dir).nodes).agg(F.collect_list("level").alias("levels"))
    return levels.select(F.array_join(requirements.sorted_levels(F.col("levels")), ",").alias("scale"))


# ---- projects, metadata, JSON, spreadsheets


@query("""WITH p AS (SELECT DISTINCT * FROM projects), w AS (SELECT * FROM sample_user_doc_v2 QUALIFY row_number() OVER (PARTITION BY wp_key ORDER BY loaded_at) = 1), m AS (SELECT project_id, min(target_asil) AS target, min(name) AS name FROM p WHERE project_id IS NOT NULL GROUP BY 1)
SELECT wp_key, coalesce(target, 'all') AS target_level, coalesce(name, w.project_id) AS project_name FROM w LEFT JOIN m USING (project_id)""")  # fmt: skip
def metadata_merge(spark, sf_dir):
    p = table(spark, sf_dir, "projects").filter("project_id is not null").groupBy("project_id").agg(F.min("target_asil").alias("target"), F.min("name").alias("name"))
    w = requirements.first_delivery(table(spark, sf_dir, "sample_user_doc_v2").select("wp_key", "project_id", "loaded_at"), "wp_key")
    return w.join(p, "project_id", "left").select("wp_key", F.coalesce("target", F.lit("all")).alias("target_level"), F.coalesce("name", "project_id").alias("project_name"))


@query("SELECT project_id, trim(p) AS part FROM (SELECT DISTINCT project_id, unnest(parts_in_scope) AS p FROM projects) WHERE trim(p) <> ''")
def project_scope(spark, sf_dir):
    return table(spark, sf_dir, "projects").select("project_id", F.explode("parts_in_scope").alias("p")).filter(F.trim("p") != "").distinct().select("project_id", F.trim("p").alias("part"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k is not null")


@query(None)
def json_leaves(spark, sf_dir):
    members = discovery.walk(table(spark, sf_dir, "raw_user_docs"), "file_id", "payload")
    return discovery.leaf_text(members, "file_id")


@query(None)
def key_frequency(spark, sf_dir):
    return discovery.key_frequency(discovery.walk(table(spark, sf_dir, "raw_user_docs"), "file_id", "payload"), "file_id")


@query(None)
def field_roles(spark, sf_dir):
    return discovery.field_roles(key_frequency(spark, sf_dir))


@query("""WITH v AS (SELECT c_nationkey AS sheet, c_custkey AS row_no, [c_name, c_mktsegment, CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END] AS cells FROM customer),
h AS (SELECT sheet, arg_min(cells, row_no) AS head, min(row_no) AS first FROM v GROUP BY 1)
SELECT sheet, row_no, CASE WHEN row_no > first AND len(list_filter(head, lambda c: trim(c) = '')) = 0 THEN concat_ws(' | ', CASE WHEN trim(cells[1]) <> '' THEN head[1] || ': ' || cells[1] END, CASE WHEN trim(cells[2]) <> '' THEN head[2] || ': ' || cells[2] END, CASE WHEN trim(cells[3]) <> '' THEN head[3] || ': ' || cells[3] END)
ELSE array_to_string(cells, chr(9)) END AS line FROM v JOIN h USING (sheet)""")  # fmt: skip
def spreadsheet_rows_to_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    money = F.when(F.col("c_acctbal") < 0, "").otherwise(F.floor("c_acctbal").cast("string"))
    rows = c.select(F.col("c_nationkey").alias("sheet"), F.col("c_custkey").alias("row_no"), F.array("c_name", "c_mktsegment", money).alias("cells"))
    return sections.row_texts(rows)


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    """The windowed aggregation of the stream, over the table at once."""
    from traceloom.streaming.watch import late_counts

    x = late_counts(table(spark, sf_dir, "events"))
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
