"""Queries over requirements and artifacts: filters, likeness, layers, gaps, reports; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import text as T
from traceloom.functions import vocabulary as V
from traceloom.operators import layers as L
from traceloom.operators import requirements as R
from traceloom.operators import similarity as S
from traceloom.session import stored, table

SCALE = ("A", "B", "C", "D")
TARGET = "B"
GROUPS = ("part_3", "part_4")
#: Links that work products of a standard should have (a list of the caller's).
RULES = ((1, "Safety goals", "Functional concept"), (2, "Hazard review", "Item definition"), (3, "Technical concept", "Integration record"), (4, "Test report", "Confirmation report"), (5, "Safety plan", "Tool qualification"))

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


BASE = """WITH cl AS (
  SELECT * FROM (SELECT * FROM part_3_concept QUALIFY row_number() OVER (PARTITION BY clause_key ORDER BY loaded_at) = 1
    UNION ALL BY NAME SELECT * FROM part_4_system QUALIFY row_number() OVER (PARTITION BY clause_key ORDER BY loaded_at) = 1)),
nodes AS (
  SELECT standard_id AS std, 'part_' || part AS group_key, clause_key AS node_ord, section AS node_id, title, type AS node_type, text, tags, notes,
         coalesce(asil_level, 'all') AS risk, cross_references AS refs,
         concat_ws(' ', text, title, nullif(array_to_string(list_filter(notes, lambda x: x IS NOT NULL), ' '), ''), nullif(array_to_string(list_filter(tags, lambda x: x IS NOT NULL), ' '), '')) AS node_text
  FROM cl),
arts AS (
  SELECT standard_id AS std, wp_key AS art_ord, id AS art_id, project_id, coalesce(title, '') AS title, coalesce(content, '') AS full_text, coalesce(status, '') AS status,
         tags_addressed AS tags, methods_used AS methods, mapped_sections AS mapped, traceability_links AS links
  FROM sample_user_doc_v2 QUALIFY row_number() OVER (PARTITION BY wp_key ORDER BY loaded_at) = 1),
"""


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z][a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({_list(V.STOPWORDS)}, t))"


_IS_REQ = f"(coalesce(lower(node_type) IN ({', '.join(repr(t) for t in V.REQUIREMENT_TYPES)}), false) OR coalesce(contains(lower(text), 'shall'), false))"


def _applies(level: str = "risk", target: str = TARGET) -> str:
    scale = _list(SCALE)
    first, last = f"coalesce(list_position({scale}, trim(split_part({level}, '-', 1))), 0)", f"coalesce(list_position({scale}, trim(list_last(string_split({level}, '-')))), 0)"
    at = SCALE.index(target) + 1
    return f"""(CASE WHEN lower({level}) IN ('all', 'n/a', '') THEN true WHEN contains({level}, '{target}') THEN true
      WHEN contains({level}, '-') THEN ({first} = 0 OR {last} = 0 OR ({first} <= {at} AND {at} <= {last})) ELSE false END)"""


_CONCEPT = f"""(length(trim(t)) >= 2 AND NOT contains(trim(t), '  ') AND NOT regexp_matches(trim(t), '[\\r\\n]') AND NOT regexp_matches(replace(trim(t), ' ', ''), '^[0-9]+$')
  AND NOT (length(trim(t)) <= 3 AND lower(trim(t)) = trim(t) AND regexp_matches(trim(t), '[a-z]') AND trim(t) NOT IN ({', '.join(repr(x) for x in V.SHORT_CONCEPTS)})))"""

REQS = BASE + f"reqs AS (SELECT * FROM nodes WHERE {_IS_REQ} AND group_key IN ('part_3', 'part_4') AND {_applies()}),\n"
_CLAIMS = "claims AS (SELECT std, art_ord, status, methods, node_id FROM (SELECT std, art_ord, status, methods, unnest(mapped) AS node_id FROM arts) WHERE node_id IS NOT NULL),\n"
_SIMS = f"""atok AS (SELECT std, art_ord, len(ts) AS n_all, unnest(ts) AS term FROM (SELECT std, art_ord, {_tokens('full_text')} AS ts FROM arts)),
ac AS (SELECT std, art_ord, term, n_all, count(*) AS n FROM atok GROUP BY ALL),
nd AS (SELECT std, count(*) AS n_docs FROM arts GROUP BY 1),
idf AS (SELECT std, term, ln(n_docs / (1 + count(*))) AS idf FROM ac JOIN nd USING (std) GROUP BY std, term, n_docs),
aw AS (SELECT std, art_ord, term, n / n_all * idf AS w FROM ac JOIN idf USING (std, term)),
nt AS (SELECT std, node_ord, len(ts) AS n_all, unnest(ts) AS term FROM (SELECT std, node_ord, {_tokens('node_text')} AS ts FROM reqs)),
nc AS (SELECT std, node_ord, term, n_all, count(*) AS n FROM nt GROUP BY ALL),
nw AS (SELECT std, node_ord, term, n / n_all * coalesce(idf, 1.0) AS w FROM nc LEFT JOIN idf USING (std, term)),
an AS (SELECT std, art_ord, sqrt(sum(w * w)) AS na FROM aw GROUP BY 1, 2),
nn AS (SELECT std, node_ord, sqrt(sum(w * w)) AS nn FROM nw GROUP BY 1, 2),
dots AS (SELECT nw.std, node_ord, art_ord, sum(nw.w * aw.w) AS dot FROM nw JOIN aw ON nw.std = aw.std AND nw.term = aw.term GROUP BY 1, 2, 3),
best AS (SELECT std, node_ord, max(CASE WHEN na * nn = 0 THEN 0.0 ELSE dot / (na * nn) END) AS best FROM dots JOIN an USING (std, art_ord) JOIN nn USING (std, node_ord) GROUP BY 1, 2),
sims AS (SELECT std, node_ord, greatest(coalesce(best, 0.0), 0.0) AS sim FROM reqs LEFT JOIN best USING (std, node_ord)),
"""
_SHARE = f"""terms AS (SELECT DISTINCT std, node_ord, term FROM nt),
words AS (SELECT DISTINCT std, unnest(regexp_extract_all(lower(full_text), '[a-z0-9]+')) AS word FROM arts),
hits AS (SELECT DISTINCT t.std, t.term FROM (SELECT DISTINCT std, term FROM terms) t JOIN words w ON t.std = w.std AND contains(w.word, t.term)),
shares AS (SELECT std, node_ord, count(h.term) / count(*) AS share FROM terms LEFT JOIN hits h USING (std, term) GROUP BY 1, 2),
"""
_STATES = f"""first_claim AS (SELECT std, node_id, arg_min(status, art_ord) AS status FROM claims GROUP BY 1, 2),
states AS (
  SELECT r.std, r.node_ord, r.node_id, r.group_key, r.title,
         CASE WHEN c.node_id IS NOT NULL THEN CASE WHEN lower(c.status) IN ({', '.join(repr(x) for x in V.FINISHED)}) THEN 'full' ELSE 'partial' END
              WHEN share > 0.5 THEN 'partial' ELSE 'missing' END AS state
  FROM reqs r LEFT JOIN first_claim c USING (std, node_id) LEFT JOIN shares s ON s.std = r.std AND s.node_ord = r.node_ord),
"""
_EDGES = """edges AS (
  SELECT std, node_ord, CAST(pos - 1 AS INTEGER) AS edge_ord, group_key || ':' || node_id AS src, trim(ref) AS target FROM (
    SELECT std, group_key, node_ord, node_id, generate_subscripts(refs, 1) AS pos, unnest(refs) AS ref FROM nodes) WHERE trim(ref) <> ''),
covered AS (SELECT DISTINCT std, node_id FROM claims),
edge_states AS (
  SELECT e.std, node_ord, edge_ord, src, target, a.node_id IS NOT NULL AS src_ok, b.node_id IS NOT NULL AS target_ok
  FROM edges e LEFT JOIN covered a ON a.std = e.std AND a.node_id = list_last(string_split(src, ':')) LEFT JOIN covered b ON b.std = e.std AND b.node_id = list_last(string_split(target, ':'))),
"""
_CONCEPTS = f"""need AS (SELECT DISTINCT std, lower(trim(t)) AS concept FROM (SELECT std, unnest(tags) AS t FROM reqs) WHERE {_CONCEPT}),
tagged AS (SELECT DISTINCT std, lower(trim(t)) AS concept FROM (SELECT std, unnest(tags) AS t FROM arts) WHERE {_CONCEPT}),
spoken AS (SELECT DISTINCT n.std, n.concept FROM need n JOIN arts a ON a.std = n.std AND length(n.concept) >= 3 AND contains(lower(a.full_text), n.concept)),
concepts AS (SELECT n.std, n.concept, (t.concept IS NOT NULL OR s.concept IS NOT NULL) AS covered FROM need n LEFT JOIN tagged t USING (std, concept) LEFT JOIN spoken s ON s.std = n.std AND s.concept = n.concept),
"""
_METHODS = """required AS (
  SELECT DISTINCT std, list_last(string_split(name, ' ')) AS activity, name AS method FROM (SELECT DISTINCT std FROM nodes) s
  CROSS JOIN (SELECT * FROM term_catalog WHERE kind = 'method') c),
used AS (SELECT DISTINCT std, lower(u) AS u FROM (SELECT std, unnest(methods) AS u FROM arts) WHERE u IS NOT NULL),
method_states AS (
  SELECT r.std, activity, method, (u.u IS NOT NULL OR EXISTS (SELECT 1 FROM arts a WHERE a.std = r.std AND contains(lower(a.full_text), lower(r.method)))) AS found
  FROM required r LEFT JOIN used u ON u.std = r.std AND u.u = lower(r.method)),
"""
_RULES = f"""rules AS (SELECT * FROM (VALUES {', '.join(f"({n}, '{f}', '{t}')" for n, f, t in RULES)}) v(rule_ord, from_item, to_item)),
link_words AS (SELECT DISTINCT std, unnest(regexp_extract_all(lower(concat_ws(' ', l."from", l."to", l."type")), '[a-z0-9]+')) AS word FROM (SELECT std, unnest(links) AS l FROM arts) WHERE l IS NOT NULL),
ends AS (SELECT rule_ord, 'f' AS side, unnest({_tokens('from_item')}) AS term FROM rules UNION ALL SELECT rule_ord, 't', unnest({_tokens('to_item')}) FROM rules),
met AS (SELECT std, rule_ord, bool_or(side = 'f') AND bool_or(side = 't') AS ok FROM link_words JOIN ends ON contains(word, term) GROUP BY 1, 2),
rule_states AS (SELECT s.std, r.rule_ord, from_item, to_item, coalesce(ok, false) AS satisfied FROM (SELECT DISTINCT std FROM arts) s CROSS JOIN rules r LEFT JOIN met m ON m.std = s.std AND m.rule_ord = r.rule_ord),
"""
_FINDINGS = """unmatched AS (SELECT std, activity, count(*) AS n_missing, array_to_string(list_slice(list_sort(list(method)), 1, 5), '; ') AS methods, CASE WHEN count(*) < 3 THEN 'WARNING' ELSE 'MAJOR' END AS severity FROM method_states WHERE NOT found GROUP BY 1, 2),
findings AS (
  SELECT 'node_coverage' AS layer, 1 AS layer_ord, std, node_ord AS finding_ord, CASE state WHEN 'missing' THEN 'MISSING_COVERAGE' ELSE 'PARTIAL_COVERAGE' END AS type, CASE state WHEN 'missing' THEN 'CRITICAL' ELSE 'WARNING' END AS severity, node_id, group_key, title, NULL AS activity FROM states WHERE state <> 'full'
  UNION ALL SELECT 'content_alignment', 2, std, node_ord, 'LOW_CONTENT_ALIGNMENT', CASE WHEN sim < 0.05 THEN 'MAJOR' ELSE 'WARNING' END, node_id, group_key, title, NULL FROM reqs JOIN sims USING (std, node_ord) WHERE sim < 0.15
  UNION ALL SELECT 'concept_coverage', 4, std, 0, 'MISSING_CONCEPTS', 'WARNING', NULL, NULL, array_to_string(list_slice(list_sort(list(concept)), 1, 30), '; '), NULL FROM concepts WHERE NOT covered GROUP BY std
  UNION ALL SELECT 'reference_integrity', 5, std, node_ord * 1000 + edge_ord, 'BROKEN_REFERENCE', 'MAJOR', list_last(string_split(src, ':')), split_part(src, ':', 1), target, NULL FROM edge_states WHERE NOT (src_ok AND target_ok)
  UNION ALL SELECT 'method_audit', 6, std, 0, 'MISSING_METHOD', severity, NULL, NULL, methods, activity FROM unmatched
  UNION ALL SELECT 'traceability_chain', 7, std, rule_ord, 'MISSING_TRACE_LINK', 'MAJOR', NULL, NULL, from_item || ' -> ' || to_item, NULL FROM rule_states WHERE NOT satisfied),
gaps AS (
  SELECT std, coalesce(node_id, activity, layer) AS gap_key, count(*) AS n_findings,
         CAST(sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'MAJOR' THEN 5 WHEN 'WARNING' THEN 2 ELSE 1 END) AS BIGINT) AS base_risk,
         min(CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'MAJOR' THEN 2 WHEN 'WARNING' THEN 3 ELSE 4 END) AS rank, min(layer_ord * 1000000000000000 + finding_ord) AS seen, list(DISTINCT type) AS types
  FROM findings GROUP BY 1, 2),
ranked AS (SELECT *, CAST(base_risk * 2 AS DOUBLE) AS weighted_risk, row_number() OVER (PARTITION BY std ORDER BY base_risk DESC, seen, gap_key) AS place FROM gaps),
"""
_SCORES = """raw_scores AS (
  SELECT std, 'node_coverage' AS layer, round(100.0 * (count(*) FILTER (state = 'full') + 0.5 * count(*) FILTER (state = 'partial')) / count(*), 1) AS score FROM states GROUP BY 1
  UNION ALL SELECT std, 'content_alignment', round(100 * avg(sim), 1) FROM sims GROUP BY 1
  UNION ALL SELECT std, 'concept_coverage', round(100.0 * count(*) FILTER (covered) / count(*), 1) FROM concepts GROUP BY 1
  UNION ALL SELECT n.std, 'reference_integrity', round(100.0 * count(*) FILTER (src_ok AND target_ok) / greatest(count(e.std), 1), 1) FROM (SELECT DISTINCT std FROM nodes) n LEFT JOIN edge_states e USING (std) GROUP BY 1
  UNION ALL SELECT std, 'method_audit', round(100.0 * count(*) FILTER (found) / count(*), 1) FROM method_states GROUP BY 1
  UNION ALL SELECT std, 'traceability_chain', round(100.0 * count(*) FILTER (satisfied) / count(*), 1) FROM rule_states GROUP BY 1),
scores AS (SELECT s.std, l.layer, coalesce(r.score, CASE l.layer WHEN 'method_audit' THEN 100.0 ELSE 0.0 END) AS score FROM (SELECT DISTINCT std FROM nodes) s CROSS JOIN (SELECT DISTINCT layer FROM raw_scores) l LEFT JOIN raw_scores r ON r.std = s.std AND r.layer = l.layer),
weights AS (SELECT * FROM (VALUES ('node_coverage', 0.20, 1), ('content_alignment', 0.15, 2), ('semantic_matching', 0.10, 3), ('concept_coverage', 0.10, 4), ('reference_integrity', 0.15, 5), ('method_audit', 0.10, 6), ('traceability_chain', 0.20, 7)) w(layer, weight, layer_ord)),
weighted AS (SELECT std, layer, layer_ord, score, CAST(weight AS DOUBLE) AS weight, score * CAST(weight AS DOUBLE) AS contribution FROM scores JOIN weights USING (layer)),
"""
_ALL = REQS + _CLAIMS + _SIMS + _SHARE + _STATES + _EDGES + _CONCEPTS + _METHODS + _RULES + _FINDINGS


class Model:
    """The frames that queries share, built lazily. Without ``fuzzy`` it is the part that SQL can say:
    no fuzzy ratios, so no layer 3, no alike titles in layer 1 and no alike method names in layer 6."""

    #: The tables that nodes and artifacts are made from, until they are shared.
    delivered: tuple | None = None
    #: Whether nodes and artifacts are shared or written.
    kept: bool = False

    def __init__(self, spark: SparkSession, sf_dir: str, fuzzy: bool = True):
        self.spark, self.fuzzy = spark, fuzzy
        self.delivered = (table(spark, sf_dir, "part_3_concept"), table(spark, sf_dir, "part_4_system")), table(spark, sf_dir, "sample_user_doc_v2")
        self.nodes, self.arts = R.nodes(*self.delivered[0]), R.artifacts(self.delivered[1])
        self.catalog = table(spark, sf_dir, "term_catalog")
        self.rules, self.target, self.scale, self.groups = RULES, TARGET, SCALE, GROUPS
        self.made: dict[str, DataFrame] = {}
        self.whole_ratios = False

    @property
    def reqs(self) -> DataFrame:
        return R.applicable(self.nodes, self.target, self.scale, self.groups)

    def few_travel(self) -> None:
        if self.delivered:
            clauses, products = self.delivered
            self.nodes, self.arts, self.delivered = R.nodes(*clauses, first=R.few_repeats), R.artifacts(products, first=R.few_repeats), None

    def shared(self) -> Model:
        """Nodes and artifacts deduplicated once for all layers; kept as far as memory goes, then on
        disk, and computed again where an executor is lost."""
        if not self.kept:
            self.few_travel()
            self.nodes, self.arts, self.kept = self.nodes.persist(), self.arts.persist(), True
        return self

    def written(self) -> Model:
        """The same, written to tables, for queries over all layers: they read nodes and artifacts in dozens of
        places, each of which would carry the whole plan of a kept frame through the driver."""
        if not self.kept:
            self.few_travel()
            self.nodes, self.arts, self.kept = stored(self.nodes, "nodes"), stored(self.arts, "artifacts"), True
        return self

    def states(self) -> DataFrame:
        return L.coverage(self.reqs, self.arts, self.fuzzy)

    def sims(self) -> DataFrame:
        self.shared()  # read several times: for counts, for documents of a standard, for the weights
        return S.alignment(self.reqs, self.arts)

    def ratios(self, enough: float | None = None) -> DataFrame:
        return S.best_ratio(self.reqs, self.arts, enough=enough)

    def concepts(self) -> DataFrame:
        return L.concepts(self.reqs, self.arts)

    def stds(self) -> DataFrame:
        return self.nodes.select("std").distinct()

    def edges(self) -> DataFrame:
        return L.reference_states(L.reference_edges(self.nodes), self.arts)

    def required(self) -> DataFrame:
        """Every method of the catalog, of every standard. The catalog is a fixed table."""
        methods = self.catalog.filter("kind = 'method'").select(F.element_at(F.split("name", " "), -1).alias("activity"), F.col("name").alias("method"))
        return self.stds().crossJoin(F.broadcast(methods))

    def methods(self) -> DataFrame:
        return L.method_states(self.required(), self.arts, self.fuzzy)

    def traces(self) -> DataFrame:
        return L.trace_states(self.rules, self.arts)

    def layers(self, whole: bool = True) -> dict[str, DataFrame]:
        """The rows of each layer, by its name: narrow tables, written once, from which scores and
        findings are made. They are written one after another: side by side, their plans and broadcasts
        would fill the driver's memory, and all their shuffles the disk. Not ``whole``: of the fuzzy ratios
        of layer 3, only those are the best that are low enough for a finding; scores need all of them."""
        if not self.made:
            m = self.written()
            made = {"node_coverage": m.states, "content_alignment": m.sims, "semantic_matching": lambda: m.ratios(None if whole else L.LOW_RATIO), "concept_coverage": m.concepts, "reference_integrity": m.edges, "method_audit": m.methods, "traceability_chain": m.traces}
            if not m.fuzzy:
                del made["semantic_matching"]
            self.made = {name: stored(rows(), f"layer-{name}") for name, rows in made.items()}
            self.whole_ratios = whole
        elif whole and self.fuzzy and not self.whole_ratios:
            self.made["semantic_matching"], self.whole_ratios = stored(self.ratios(), "layer-semantic_matching"), True
        return self.made

    def findings(self) -> DataFrame:
        t, reqs = self.layers(whole=False), self.reqs
        traces = L.trace_findings(t["traceability_chain"]) if self.rules else L.trace_default_findings(self.arts)
        parts = [L.coverage_findings(t["node_coverage"]), L.alignment_findings(reqs, t["content_alignment"]), L.concept_findings(t["concept_coverage"]), L.reference_findings(t["reference_integrity"]), L.method_findings(t["method_audit"]), traces]
        if self.fuzzy:
            parts.insert(2, L.semantic_findings(reqs, t["semantic_matching"]))
        return L.united(*parts)

    def scores(self) -> DataFrame:
        t = self.layers()
        rows = lambda name, points: t[name].select("std", points.cast("double").alias("points"))
        traces = rows("traceability_chain", F.col("satisfied")) if self.rules else L.trace_default(self.arts).select("std", (F.col("score") / 100).alias("points"))
        points = {"node_coverage": L.coverage_points(t["node_coverage"]), "content_alignment": rows("content_alignment", F.col("sim")), "concept_coverage": rows("concept_coverage", F.col("covered")), "reference_integrity": rows("reference_integrity", F.col("src_ok") & F.col("target_ok")), "method_audit": rows("method_audit", F.col("found")), "traceability_chain": traces}
        if self.fuzzy:
            points["semantic_matching"] = rows("semantic_matching", F.col("ratio"))
        return L.layer_scores(self.stds(), points)

    def gaps(self) -> DataFrame:
        return L.gap_groups(self.findings(), L.level_multiplier(self.target, self.scale))


def query(sql: str | None = None, fuzzy: bool = False):
    """Register a function of the model, and its SQL. ``fuzzy``: the query depends on fuzzy ratios, which
    SQL can't compute; it is whole and has no SQL, and NAME_exact, without the ratios, has it."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(Model(spark, sf_dir))
        name = f.__name__
        if fuzzy:
            name += "_exact"
            QUERIES[name] = lambda spark, sf_dir, f=f: f(Model(spark, sf_dir, fuzzy=False))
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- filters and text


@query(BASE + f"x AS (SELECT 1) SELECT node_ord, {_IS_REQ} AS is_requirement FROM nodes")
def classify_requirements(m):
    return m.nodes.select("node_ord", T.is_requirement(F.col("node_type"), F.col("text")).alias("is_requirement"))


@query(BASE + f"x AS (SELECT 1) SELECT risk, {_applies()} AS applies, count(*) AS n FROM nodes GROUP BY ALL")
def risk_applicable(m):
    return m.nodes.select("risk", T.risk_applies(F.col("risk"), TARGET, SCALE).alias("applies")).groupBy("risk", "applies").agg(F.count(F.lit(1)).alias("n"))


@query(REQS + "x AS (SELECT 1) SELECT std, group_key, count(*) AS n FROM reqs GROUP BY ALL")
def scope_filter(m):
    return m.reqs.groupBy("std", "group_key").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + f"x AS (SELECT DISTINCT unnest(tags) AS t FROM nodes) SELECT t AS tag, coalesce({_CONCEPT}, false) AS valid FROM x WHERE t IS NOT NULL")
def valid_concepts(m):
    t = m.nodes.select(F.explode("tags").alias("tag")).filter("tag is not null").distinct()
    return t.select("tag", T.is_concept(F.col("tag")).alias("valid"))


def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("ts"))
    return ts.select("doc_id", F.size("ts").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("ts")).cast("bigint").alias("n_distinct"))


QUERIES["tokenize_documents"] = tokenize_documents
ORACLE["tokenize_documents"] = f"SELECT doc_id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_distinct FROM (SELECT doc_id, coalesce({_tokens('text')}, []) AS ts FROM documents)"


@query(REQS + _SIMS + "x AS (SELECT 1) SELECT std, art_ord, term, round(n / n_all, 6) AS tf FROM ac")
def term_frequency(m):
    return S.term_frequency(m.arts, "art_ord", "full_text").select("std", "art_ord", "term", F.round("tf", 6).alias("tf"))


@query(REQS + _SIMS + "x AS (SELECT 1) SELECT std, term, round(idf, 6) AS idf FROM idf")
def inverse_document_frequency(m):
    return S.inverse_document_frequency(m.arts, S.term_counts(m.arts, "art_ord", "full_text")).select("std", "term", F.round("idf", 6).alias("idf"))


# ---- layers


@query(REQS + _SIMS + "x AS (SELECT 1) SELECT std, node_ord, round(sim, 6) AS sim FROM sims")
def content_alignment(m):
    return m.sims().select("std", "node_ord", F.round("sim", 6).alias("sim"))


@query(_ALL + "x AS (SELECT 1) SELECT severity, count(*) AS n FROM findings WHERE layer = 'content_alignment' GROUP BY 1")
def alignment_findings(m):
    return L.alignment_findings(m.reqs, m.sims()).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def semantic_matching(m):
    return m.ratios()


@query(None)
def title_fuzzy_match(m):
    return S.title_matches(m.reqs, m.arts)


@query(REQS + _SIMS + _SHARE + "x AS (SELECT 1) SELECT std, node_ord, round(share, 6) AS share FROM shares")
def term_containment(m):
    return S.containment(m.reqs, m.arts).select("std", "node_ord", F.round("share", 6).alias("share"))


@query(_ALL + "x AS (SELECT 1) SELECT std, node_ord, node_id, state FROM states", fuzzy=True)
def claim_coverage(m):
    return m.states().select("std", "node_ord", "node_id", "state")


@query(None)
def node_coverage(m):
    return m.states()


@query(_ALL + "x AS (SELECT 1) SELECT std, count(*) AS n_requirements, CAST(count(*) FILTER (state = 'full') + 0.5 * count(*) FILTER (state = 'partial') AS DOUBLE) AS covered, round(100.0 * (count(*) FILTER (state = 'full') + 0.5 * count(*) FILTER (state = 'partial')) / count(*), 1) AS score FROM states GROUP BY 1", fuzzy=True)
def coverage_score(m):
    return L.coverage_score(m.states()).withColumn("score", F.col("score").cast("double"))


@query(_ALL + "x AS (SELECT 1) SELECT std, concept FROM concepts")
def concept_required(m):
    return m.concepts().select("std", "concept")


@query(_ALL + "x AS (SELECT 1) SELECT std, concept FROM concepts WHERE covered")
def concept_covered(m):
    return m.concepts().filter("covered").select("std", "concept")


@query(_ALL + "x AS (SELECT 1) SELECT std, concept FROM concepts WHERE NOT covered")
def concept_missing(m):
    return m.concepts().filter("not covered").select("std", "concept")


@query(_ALL + "x AS (SELECT 1) SELECT n.std, count(e.std) AS n_edges, count(*) FILTER (src_ok AND target_ok) AS n_satisfied, round(100.0 * count(*) FILTER (src_ok AND target_ok) / greatest(count(e.std), 1), 1) AS score FROM (SELECT DISTINCT std FROM nodes) n LEFT JOIN edge_states e USING (std) GROUP BY 1")
def reference_integrity(m):
    return L.reference_score(m.edges(), m.stds())


@query(_ALL + "x AS (SELECT 1) SELECT std, node_ord, edge_ord, src, target, src_ok, target_ok FROM edge_states WHERE NOT (src_ok AND target_ok)")
def broken_references(m):
    return m.edges().filter(~(F.col("src_ok") & F.col("target_ok")))


@query(_ALL + "x AS (SELECT 1) SELECT std, activity, method, found FROM method_states", fuzzy=True)
def method_hits(m):
    return m.methods()


@query(_ALL + "x AS (SELECT 1) SELECT std, count(*) AS n_required, count(*) FILTER (found) AS n_found, round(100.0 * count(*) FILTER (found) / count(*), 1) AS score FROM method_states GROUP BY 1", fuzzy=True)
def method_audit(m):
    return L.method_score(m.methods(), m.stds())


@query(_ALL + "x AS (SELECT 1) SELECT std, activity, n_missing, methods, severity FROM unmatched", fuzzy=True)
def unmatched_methods_by_activity(m):
    return L.unmatched_by_activity(m.methods())


@query(_ALL + "x AS (SELECT 1) SELECT std, rule_ord, from_item, to_item, satisfied FROM rule_states")
def traceability_chain(m):
    return m.traces()


# ---- traceability tables


@query(REQS + _CLAIMS + "x AS (SELECT 1) SELECT DISTINCT std, art_ord, node_id, coalesce(len(methods), 0) > 0 AS verified, coalesce(array_to_string(methods[1:5], '; '), '') AS verified_by FROM claims")
def trace_matrix(m):
    return L.trace_matrix(m.arts)


@query(REQS + _CLAIMS + "x AS (SELECT DISTINCT std, node_id FROM claims) SELECT DISTINCT std, node_id FROM reqs ANTI JOIN x USING (std, node_id)")
def orphan_requirements(m):
    return L.orphan_requirements(m.reqs, m.arts)


@query(REQS + _CLAIMS + "x AS (SELECT DISTINCT std, art_ord FROM claims) SELECT std, art_ord, art_id FROM arts ANTI JOIN x USING (std, art_ord)")
def orphan_artifacts(m):
    return L.orphan_artifacts(m.arts)


@query(REQS + _CLAIMS + """n AS (SELECT std, count(*) AS n_requirements FROM reqs GROUP BY 1), t AS (SELECT std, count(DISTINCT node_id) AS n_traced, count(DISTINCT art_ord) AS n_with FROM claims GROUP BY 1), a AS (SELECT std, count(*) AS n_artifacts FROM arts GROUP BY 1),
o AS (SELECT std, count(*) AS n_orphans FROM (SELECT DISTINCT std, node_id FROM reqs ANTI JOIN claims USING (std, node_id)) GROUP BY 1),
c AS (SELECT std, count(*) AS n_chains, count(*) FILTER (verified) AS n_verified FROM (SELECT DISTINCT std, art_ord, node_id, coalesce(len(methods), 0) > 0 AS verified FROM claims) GROUP BY 1)
SELECT std, n_requirements, coalesce(n_traced, 0) AS n_traced, coalesce(n_artifacts, 0) AS n_artifacts, coalesce(n_with, 0) AS n_with_traces, coalesce(n_chains, 0) AS n_chains, coalesce(n_verified, 0) AS n_verified, coalesce(n_orphans, 0) AS n_orphan_requirements, coalesce(n_artifacts, 0) - coalesce(n_with, 0) AS n_orphan_artifacts,
least(100.0, round(100.0 * coalesce(n_traced, 0) / greatest(n_requirements, 1), 1)) AS coverage FROM n LEFT JOIN t USING (std) LEFT JOIN a USING (std) LEFT JOIN c USING (std) LEFT JOIN o USING (std)""")  # fmt: skip
def trace_coverage(m):
    return L.trace_coverage(m.reqs, m.arts).withColumn("coverage", F.col("coverage").cast("double"))


@query(BASE + """x AS (SELECT art_ord, len(list_filter(links, lambda l: l IS NOT NULL)) AS n, len(list_filter(links, lambda l: l."to" IS NOT NULL AND l."from" IS NOT NULL)) AS whole FROM arts WHERE links IS NOT NULL AND len(links) > 0) SELECT art_ord, n AS n_links, whole AS n_whole, round(100.0 * whole / greatest(n, 1), 1) AS percent FROM x""")
def trace_chains_by_artifact(m):
    n, whole = F.size(F.filter("links", lambda l: l.isNotNull())), F.size(F.filter("links", lambda l: l["to"].isNotNull() & l["from"].isNotNull()))
    return m.arts.filter("size(links) > 0").select("art_ord", n.cast("bigint").alias("n_links"), whole.cast("bigint").alias("n_whole"), L.share(whole, n).cast("double").alias("percent"))


# ---- findings and gaps


@query(_ALL + "x AS (SELECT 1) SELECT layer, type, severity, count(*) AS n, count(DISTINCT std) AS n_standards FROM findings GROUP BY ALL", fuzzy=True)
def findings_union(m):
    return m.findings().groupBy("layer", "type", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("std").alias("n_standards"))


@query(_ALL + "x AS (SELECT severity, count(*) AS n FROM findings GROUP BY 1) SELECT severity, n, round(100.0 * n / sum(n) OVER (), 1) AS share FROM x", fuzzy=True)
def severity_histogram(m):
    return L.severity_histogram(m.findings()).withColumn("share", F.col("share").cast("double"))


_GAP = "std, gap_key, n_findings, base_risk, weighted_risk, ['CRITICAL', 'MAJOR', 'WARNING', 'INFO'][rank] AS worst, CASE WHEN weighted_risk >= 80 THEN 'HIGH' WHEN weighted_risk >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS priority"


@query(_ALL + f"x AS (SELECT 1) SELECT {_GAP} FROM ranked", fuzzy=True)
def gap_groups(m):
    return m.gaps().select("std", "gap_key", "n_findings", "base_risk", "weighted_risk", "worst", "priority")


@query(_ALL + "x AS (SELECT 1) SELECT std, place, gap_key, weighted_risk FROM ranked WHERE place <= 10", fuzzy=True)
def gap_topk(m):
    return L.top_gaps(m.gaps()).select("std", F.col("place").cast("bigint").alias("place"), "gap_key", "weighted_risk")


_LINE = """'[' || CASE WHEN weighted_risk >= 80 THEN 'HIGH' WHEN weighted_risk >= 20 THEN 'MEDIUM' ELSE 'LOW' END || '] ' || gap_key || ': ' || concat_ws(' ', CASE WHEN list_has_any(types, ['MISSING_COVERAGE', 'PARTIAL_COVERAGE']) THEN 'Add or finish a work product.' END,
CASE WHEN list_has_any(types, ['LOW_CONTENT_ALIGNMENT', 'LOW_SEMANTIC_MATCH']) THEN 'Say what the clause asks for.' END, CASE WHEN list_contains(types, 'MISSING_METHOD') THEN 'Apply the missing methods.' END, CASE WHEN list_has_any(types, ['BROKEN_REFERENCE', 'MISSING_TRACE_LINK']) THEN 'Complete the links.' END, CASE WHEN list_contains(types, 'MISSING_CONCEPTS') THEN 'Address the missing concepts.' END)"""


@query(_ALL + f"x AS (SELECT 1) SELECT std, place, gap_key, {_LINE} AS line FROM ranked WHERE place <= 10", fuzzy=True)
def gap_recommendations(m):
    return L.recommendations(m.gaps()).withColumn("place", F.col("place").cast("bigint"))


@query(_ALL + f"l AS (SELECT std, gap_key, substring({_LINE}, 1) AS line FROM ranked WHERE place <= 10) SELECT r.std, r.gap_key, coalesce(substring(line, position(r.gap_key || ': ' IN line) + length(r.gap_key) + 2), 'Review and close this gap.') AS advice FROM ranked r LEFT JOIN l USING (std, gap_key)", fuzzy=True)
def gap_advice(m):
    gaps = m.gaps()
    return L.gap_advice(gaps, L.recommendations(gaps))


@query(_ALL + """k AS (SELECT std, coalesce(node_id, activity, layer) AS gap_key, severity FROM findings) SELECT std, place, gap_key, count(*) FILTER (severity = 'CRITICAL') AS CRITICAL, count(*) FILTER (severity = 'MAJOR') AS MAJOR, count(*) FILTER (severity = 'WARNING') AS WARNING, count(*) FILTER (severity = 'INFO') AS INFO FROM k JOIN ranked USING (std, gap_key) WHERE place <= 10 GROUP BY 1, 2, 3""", fuzzy=True)
def gap_heatmap(m):
    return L.gap_heat_map(m.findings(), m.gaps()).withColumn("place", F.col("place").cast("bigint"))


@query(_ALL + """p AS (SELECT *, row_number() OVER (PARTITION BY std ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'MAJOR' THEN 2 WHEN 'WARNING' THEN 3 ELSE 4 END, layer_ord, finding_ord, coalesce(activity, '')) AS place FROM findings) SELECT std, place, severity, layer, type, coalesce(node_id, activity, layer) AS about FROM p WHERE place <= 100""", fuzzy=True)
def findings_appendix(m):
    """The appendix of findings: the limit of 100 is the report's."""
    return L.appendix(m.findings()).withColumn("place", F.col("place").cast("bigint"))


@query(_ALL + "x AS (SELECT 1) SELECT layer, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'MAJOR') AS n_major FROM findings GROUP BY 1", fuzzy=True)
def layer_stats(m):
    return L.layer_stats(m.findings())


@query(_ALL + "x AS (SELECT 1) SELECT std, node_id, finding_ord, severity FROM findings WHERE type = 'MISSING_COVERAGE'", fuzzy=True)
def missing_coverage(m):
    """The findings of one kind that other sections of a report are made from."""
    return m.findings().filter("type = 'MISSING_COVERAGE'").select("std", "node_id", "finding_ord", "severity")


@query(_ALL + "x AS (SELECT 1) SELECT std, CAST(round(sum(weighted_risk), 1) AS DOUBLE) AS total_risk FROM ranked GROUP BY 1", fuzzy=True)
def total_risk(m):
    return m.gaps().groupBy("std").agg(F.round(F.sum("weighted_risk"), 1).alias("total_risk"))


@query(_ALL + "x AS (SELECT 1) SELECT CASE WHEN weighted_risk >= 80 THEN 'HIGH' WHEN weighted_risk >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS priority, count(*) AS n FROM ranked GROUP BY 1", fuzzy=True)
def priority_banding(m):
    return m.gaps().groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


@query(_ALL + "x AS (SELECT 1) SELECT ['CRITICAL', 'MAJOR', 'WARNING', 'INFO'][rank] AS worst, count(*) AS n FROM ranked GROUP BY 1", fuzzy=True)
def worst_severity(m):
    return m.gaps().groupBy("worst").agg(F.count(F.lit(1)).alias("n"))


@query(_ALL + _SCORES + "x AS (SELECT 1) SELECT std, layer, score, weight, round(contribution, 6) AS contribution FROM weighted", fuzzy=True)
def layer_scores_weighted(m):
    return L.weighted_scores(m.scores()).select("std", "layer", "score", "weight", F.round("contribution", 6).alias("contribution"))


@query(_ALL + _SCORES + "x AS (SELECT 1) SELECT std, layer, round(sum(contribution) OVER (PARTITION BY std ORDER BY layer_ord ROWS UNBOUNDED PRECEDING), 6) AS running FROM weighted", fuzzy=True)
def waterfall(m):
    return L.weighted_scores(m.scores()).select("std", "layer", F.round("running", 6).alias("running"))


_OVERALL = "o AS (SELECT std, round(sum(contribution), 6) AS raw FROM weighted GROUP BY 1), v AS (SELECT *, round(raw, 1) AS score, CASE WHEN raw >= 90 THEN 'A' WHEN raw >= 75 THEN 'B' WHEN raw >= 60 THEN 'C' WHEN raw >= 40 THEN 'D' ELSE 'F' END AS grade FROM o)"


@query(_ALL + _SCORES + _OVERALL + " SELECT * FROM v", fuzzy=True)
def overall_score(m):
    return L.overall(m.scores())


@query(_ALL + _SCORES + "x AS (SELECT std, layer, score FROM scores) SELECT std, layer, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM x", fuzzy=True)
def grade_banding(m):
    return m.scores().select("std", "layer", L.grade(F.col("score")).alias("grade"))


@query(_ALL + """h AS (SELECT group_key, severity FROM findings) SELECT coalesce(group_key, 'unknown') AS group_key, count(*) FILTER (severity = 'CRITICAL') AS CRITICAL, count(*) FILTER (severity = 'MAJOR') AS MAJOR, count(*) FILTER (severity = 'WARNING') AS WARNING, count(*) FILTER (severity = 'INFO') AS INFO FROM h GROUP BY 1""", fuzzy=True)
def severity_heatmap(m):
    return L.heat_map(m.findings())


@query(_ALL + """h AS (SELECT coalesce(group_key, 'unknown') AS group_key, severity, std, node_id FROM findings) SELECT group_key, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(DISTINCT CASE WHEN node_id IS NOT NULL THEN std || '/' || node_id END) AS n_nodes, CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'red' ELSE 'amber' END AS health FROM h GROUP BY 1""", fuzzy=True)
def findings_by_part(m):
    return L.findings_by_part(m.findings())


_REGISTER = _ALL + """fnum AS MATERIALIZED (SELECT *, row_number() OVER () AS fid FROM findings WHERE node_id IS NOT NULL),
fids AS (SELECT fid, std, severity, CASE WHEN layer = 'reference_integrity' THEN group_key || ':' || node_id ELSE node_id END AS id FROM fnum UNION ALL SELECT fid, std, severity, title FROM fnum WHERE layer = 'reference_integrity' AND title IS NOT NULL),
cnt AS (SELECT std, art_ord, count(*) AS f, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'MAJOR') AS j FROM (SELECT DISTINCT c.std, c.art_ord, f.fid, f.severity FROM (SELECT DISTINCT std, art_ord, trim(node_id) AS part FROM claims) c JOIN fids f ON c.std = f.std AND c.part <> '' AND contains(f.id, c.part)) GROUP BY 1, 2),
reg AS (SELECT std, art_ord, art_id, title, coalesce(f, 0) AS n_findings, coalesce(c, 0) AS n_critical, coalesce(j, 0) AS n_major, CAST(coalesce(len(mapped), 0) AS INTEGER) AS n_mapped, coalesce(array_to_string(list_filter(mapped[1:50], lambda x: x IS NOT NULL), '; '), '') AS mapped, CAST(coalesce(len(tags), 0) AS INTEGER) AS n_tags, CAST(coalesce(len(methods), 0) AS INTEGER) AS n_methods, CAST(length(full_text) AS INTEGER) AS n_chars,
CASE WHEN trim(full_text) = '' THEN 'Missing' WHEN coalesce(c, 0) > 0 THEN 'Not Compliant' WHEN coalesce(j, 0) > 0 THEN 'Partially Compliant' WHEN coalesce(len(mapped), 0) > 0 THEN 'Compliant' ELSE 'N/A' END AS state, coalesce(c, 0) || 'C / ' || coalesce(j, 0) || 'M' AS counts
FROM arts LEFT JOIN cnt USING (std, art_ord))"""  # fmt: skip


@query(_REGISTER + " SELECT * FROM reg", fuzzy=True)
def register(m):
    return L.register(m.written().arts, m.findings())


@query(_REGISTER + " SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY std, art_id ORDER BY art_ord) = 1", fuzzy=True)
def register_by_id(m):
    return L.register_by_id(L.register(m.written().arts, m.findings()))


@query(_ALL + "l AS (SELECT std, node_id, round(100 * arg_max(sim, node_ord), 1) AS score FROM reqs JOIN sims USING (std, node_ord) GROUP BY 1, 2), g AS (SELECT DISTINCT std, group_key FROM nodes) SELECT l.std, node_id, group_key FROM l JOIN g ON l.std = g.std AND score > 40 AND (contains(node_id, group_key) OR starts_with(node_id, replace(group_key, 'part_', '')))")
def inferred_groups(m):
    m.shared()
    return L.inferred_groups(L.last_scores(m.reqs, m.sims()), m.nodes)


@query(_ALL + "d AS (SELECT std, count(DISTINCT CASE WHEN state = 'missing' THEN node_id END) AS n_missing, count(DISTINCT CASE WHEN state = 'partial' THEN node_id END) AS n_partial, count(*) AS n FROM states GROUP BY 1) SELECT std, n_missing, n_partial, greatest(0, n - n_missing - n_partial) AS n_compliant FROM d", fuzzy=True)
def matrix_summary(m):
    return L.matrix_summary(m.states())


@query(_ALL + "x AS (SELECT std, list_sort(list(concept)) AS cs FROM concepts WHERE NOT covered GROUP BY 1) SELECT std, len(cs) AS n_missing, array_to_string(cs[1:30], '; ') AS concepts FROM x")
def missing_concepts(m):
    return L.missing_concepts(m.concepts())


@query(_ALL + "p AS (SELECT *, row_number() OVER (PARTITION BY std ORDER BY group_key, node_id, node_ord) AS place FROM states) SELECT std, place, group_key, node_id, state, round(100 * sim, 1) AS alignment FROM p JOIN sims USING (std, node_ord)", fuzzy=True)
def compliance_matrix(m):
    m.written()
    return L.compliance_matrix(stored(m.states(), "layer-node_coverage"), stored(m.sims(), "layer-content_alignment")).withColumn("place", F.col("place").cast("bigint"))


@query(_ALL + "x AS (SELECT 1) SELECT std, node_id, round(100 * arg_max(sim, node_ord), 1) AS score FROM reqs JOIN sims USING (std, node_ord) GROUP BY 1, 2")
def last_wins(m):
    return L.last_scores(m.reqs, m.sims())


@query(REQS + _CLAIMS + "x AS (SELECT 1) SELECT std, node_id, arg_min(status, art_ord) AS status FROM claims GROUP BY 1, 2")
def first_match(m):
    return R.first_claim(m.arts)


@query(_ALL + _SCORES + _OVERALL + """, h AS (SELECT std, count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'MAJOR') AS n_major FROM findings GROUP BY 1), d AS (SELECT std, score, raw, grade, coalesce(n_critical, 0) AS n_critical, coalesce(n_major, 0) AS n_major FROM v LEFT JOIN h USING (std))
SELECT std, score, grade, n_critical, n_major, CASE WHEN raw >= 85 AND n_critical = 0 AND n_major <= 2 THEN 'COMPLIANT' WHEN raw >= 60 AND n_critical <= 2 THEN 'CONDITIONALLY COMPLIANT' ELSE 'NOT COMPLIANT' END AS verdict FROM d""", fuzzy=True)
def assessment_decision(m):
    return L.decision(L.overall(m.scores()), m.findings())


CHECKS = {"plan": ("sequence for safe shutdown", "plan for"), "measure": ("vibration", "climate chamber"), "level": ("level c", "level d")}
PARTS = (("part_2", "Management"), ("part_3", "Concept"), ("part_4", "System"), ("unknown", "Without a part"))


@query(BASE + "v AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}')" for n, ks in CHECKS.items() for k in ks) + ") v(check_name, kw)) SELECT std, check_name, count(DISTINCT art_ord) AS n_artifacts FROM arts JOIN v ON contains(lower(full_text), kw) GROUP BY 1, 2")
def keyword_evidence(m):
    from traceloom.operators.structure import keyword_evidence as evidence

    return evidence(m.arts, CHECKS)


@query(_ALL + f"""h AS (SELECT coalesce(group_key, 'unknown') AS group_key, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS n_critical FROM findings GROUP BY 1), v AS (SELECT * FROM (VALUES {', '.join(f"('{p}', '{t}')" for p, t in PARTS)}) v(part_id, title))
SELECT part_id, title, coalesce(n, 0) AS n, coalesce(n_critical, 0) AS n_critical, CASE WHEN coalesce(n, 0) = 0 THEN 'green' WHEN n_critical > 0 THEN 'red' ELSE 'amber' END AS health FROM v LEFT JOIN h ON part_id = group_key""", fuzzy=True)
def part_coverage(m):
    from traceloom.operators.structure import part_coverage as coverage

    return coverage(m.spark.createDataFrame(PARTS, "part_id string, title string"), L.findings_by_part(m.findings()))


@query(_ALL + f"l AS (SELECT std, place, {_LINE} AS line FROM ranked WHERE place <= 10) SELECT std, place, CASE WHEN contains(line, '[HIGH]') THEN 'HIGH' WHEN contains(line, '[MEDIUM]') THEN 'MEDIUM' ELSE 'LOW' END AS priority, trim(regexp_replace(line, '\\[(HIGH|MEDIUM|LOW)\\]', '', 'g')) AS action, 'OPEN' AS state FROM l", fuzzy=True)
def corrective_actions(m):
    from traceloom.operators.structure import corrective_actions as actions

    return actions(L.recommendations(m.gaps())).withColumn("place", F.col("place").cast("bigint"))


@query(_ALL + _SCORES + "x AS (SELECT 1) SELECT std, layer, repeat('#', CAST(floor(score / 5) AS INTEGER)) AS bar, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS letter, CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS class, least(100.0, greatest(0.0, 100.0 - score)) AS risk_percent FROM scores", fuzzy=True)
def score_bands(m):
    s = F.col("score")
    return m.scores().select("std", "layer", T.text_bar(s).alias("bar"), T.dashboard_letter(s).alias("letter"), T.score_class(s).alias("class"), T.inverse_percent(s).alias("risk_percent"))
