"""The seven scoring layers and what is made of their findings.

Every layer yields findings (layer, layer_ord, std, finding_ord, type, severity, node_id,
group_key, title, activity, score) and a score for each standard. Findings are united by name,
grouped into gaps, weighted, ranked and turned into registers, matrices and reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from traceloom.functions import text as T
from traceloom.functions import vocabulary as V
from traceloom.operators import requirements as R
from traceloom.operators import similarity as S

# Weight of each layer, in their order; of each severity; the bands.
LAYERS = (("node_coverage", 0.20), ("content_alignment", 0.15), ("semantic_matching", 0.10), ("concept_coverage", 0.10), ("reference_integrity", 0.15), ("method_audit", 0.10), ("traceability_chain", 0.20))
SEVERITY_WEIGHT = (("CRITICAL", 10), ("MAJOR", 5), ("WARNING", 2), ("INFO", 1))
SEVERITY_ORDER = ("CRITICAL", "MAJOR", "WARNING", "INFO")
#: A best fuzzy ratio below it is a finding.
LOW_RATIO = 0.2

_FINDING = {"node_id": "string", "group_key": "string", "title": "string", "activity": "string", "score": "double"}


def share(part: Column, whole: Column) -> Column:
    """A percentage of one decimal, 0 of nothing."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), 1)


def findings(df: DataFrame, layer: str, kind: Column, severity: Column, order: Column, **columns: Column) -> DataFrame:
    at = [n for n, _ in LAYERS].index(layer) + 1
    rest = [(columns.get(n, F.lit(None)).cast(t)).alias(n) for n, t in _FINDING.items()]
    return df.select(F.lit(layer).alias("layer"), F.lit(at).alias("layer_ord"), "std", order.cast("bigint").alias("finding_ord"), kind.alias("type"), severity.alias("severity"), *rest)


# ---- layer 1


def coverage(reqs: DataFrame, arts: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(std, node_ord, node_id, group_key, title, state): full, partial or missing. A claimed
    section is full or partial by its first artifact's status; the others are partial if a title
    is alike or more than half of their terms occur."""
    x = reqs.select("std", "node_ord", "node_id", "group_key", "title").join(R.first_claim(arts), ["std", "node_id"], "left")
    unclaimed = reqs.join(R.first_claim(arts), ["std", "node_id"], "left_anti")
    near = S.containment(unclaimed, arts).filter("share > 0.5").select("std", "node_ord")
    if fuzzy:
        near = near.unionAll(S.title_matches(unclaimed, arts))
    x = x.join(near.distinct().withColumn("near", F.lit(True)), ["std", "node_ord"], "left")
    state = F.when(F.col("status").isNotNull(), F.when(F.lower("status").isin(*V.FINISHED), "full").otherwise("partial")).when(F.col("near"), "partial").otherwise("missing")
    return x.select("std", "node_ord", "node_id", "group_key", "title", state.alias("state"))


def coverage_score(states: DataFrame) -> DataFrame:
    covered = F.count_if(F.col("state") == "full") + 0.5 * F.count_if(F.col("state") == "partial")
    return states.groupBy("std").agg(F.count(F.lit(1)).alias("n_requirements"), covered.cast("double").alias("covered"), share(covered, F.count(F.lit(1))).alias("score"))


def coverage_findings(states: DataFrame) -> DataFrame:
    missing = F.col("state") == "missing"
    return findings(states.filter("state <> 'full'"), "node_coverage", F.when(missing, "MISSING_COVERAGE").otherwise("PARTIAL_COVERAGE"), F.when(missing, "CRITICAL").otherwise("WARNING"), F.col("node_ord"), node_id=F.col("node_id"), group_key=F.col("group_key"), title=F.col("title"))


# ---- layers 2 and 3


def alignment_findings(reqs: DataFrame, sims: DataFrame) -> DataFrame:
    x = reqs.join(sims, ["std", "node_ord"]).filter("sim < 0.15")
    return findings(x, "content_alignment", F.lit("LOW_CONTENT_ALIGNMENT"), F.when(F.col("sim") < 0.05, "MAJOR").otherwise("WARNING"), F.col("node_ord"), node_id=F.col("node_id"), group_key=F.col("group_key"), title=F.col("title"), score=F.round(100 * F.col("sim"), 1))


def semantic_findings(reqs: DataFrame, ratios: DataFrame) -> DataFrame:
    x = reqs.join(ratios, ["std", "node_ord"]).filter(F.col("ratio") < LOW_RATIO)
    return findings(x, "semantic_matching", F.lit("LOW_SEMANTIC_MATCH"), F.lit("WARNING"), F.col("node_ord"), node_id=F.col("node_id"), group_key=F.col("group_key"), title=F.col("title"), score=F.round(100 * F.col("ratio"), 1))


def mean_score(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("std").agg(F.round(100 * F.avg(column), 1).alias("score"))


# ---- layer 4


def concepts(reqs: DataFrame, arts: DataFrame) -> DataFrame:
    """(std, concept, covered): required concepts, covered by a tag or by a text that holds them."""
    required = R.tag_rows(reqs, "node_ord").select("std", F.col("tag").alias("concept")).distinct()
    tagged = R.tag_rows(arts, "art_ord").select("std", F.col("tag").alias("concept")).distinct()
    spoken = text_hits(required.filter(F.length("concept") >= 3), arts, "concept")
    covered = tagged.union(spoken).distinct().withColumn("covered", F.lit(True))
    return required.join(covered, ["std", "concept"], "left").select("std", "concept", F.coalesce("covered", F.lit(False)).alias("covered"))


def text_hits(phrases: DataFrame, arts: DataFrame, column: str) -> DataFrame:
    """(std, phrase) of phrases that occur, as substrings, in a text of their standard. The phrases of a
    standard are gathered in one row, which meets its texts; so a text travels once, without its words.
    What a row gives is distinct before it travels again."""
    p = phrases.select("std", F.col(column).alias("__phrase"), F.lower(column).alias("__low")).filter("__low <> ''")
    wanted = p.groupBy("std").agg(F.collect_set(F.struct("__low", "__phrase")).alias("__wanted"))
    texts = arts.select("std", F.lower("full_text").alias("__text")).filter("__text <> ''")
    found = texts.join(wanted, "std").select("std", F.explode(F.filter("__wanted", lambda w: F.contains(F.col("__text"), w["__low"]))).alias("w"))
    return found.select("std", F.col("w.__phrase").alias(column)).distinct()


def concept_score(c: DataFrame) -> DataFrame:
    return c.groupBy("std").agg(F.count(F.lit(1)).alias("n_required"), F.count_if("covered").alias("n_covered"), share(F.count_if("covered"), F.count(F.lit(1))).alias("score"))


def concept_findings(c: DataFrame) -> DataFrame:
    return findings(first_missing(c), "concept_coverage", F.lit("MISSING_CONCEPTS"), F.lit("WARNING"), F.lit(0), title=F.col("concepts"))


def missing_concepts(c: DataFrame, shown: int = 30) -> DataFrame:
    """(std, n_missing, concepts): how many concepts of a standard are missing, and the first of them
    in order, as many as a finding shows."""
    return c.filter("not covered").groupBy("std").agg(F.count(F.lit(1)).alias("n_missing")).join(first_missing(c, shown), "std")


def first_missing(c: DataFrame, shown: int = 30) -> DataFrame:
    """(std, concepts): the first missing concepts of a standard, in order."""
    top = c.filter("not covered").withColumn("place", F.row_number().over(Window.partitionBy("std").orderBy("concept"))).filter(F.col("place") <= shown)
    return top.groupBy("std").agg(F.array_join(F.array_sort(F.collect_list("concept")), "; ").alias("concepts"))


# ---- layer 5


def reference_edges(node_rows: DataFrame) -> DataFrame:
    """(std, node_ord, edge_ord, src, target) of textual references: 'part:section' or 'section'."""
    x = node_rows.select("std", "group_key", "node_ord", "node_id", F.posexplode("refs").alias("edge_ord", "ref")).filter(F.trim("ref") != "")
    return x.select("std", "node_ord", "edge_ord", F.concat_ws(":", "group_key", "node_id").alias("src"), F.trim("ref").alias("target"))


def reference_states(edges: DataFrame, arts: DataFrame) -> DataFrame:
    """Edges with whether their ends, by what follows the last colon, are claimed."""
    covered = R.claims(arts).select("std", "node_id").distinct().withColumn("yes", F.lit(True))
    last = lambda c: F.element_at(F.split(c, ":"), -1)
    x = edges.withColumn("s", last(F.col("src"))).withColumn("t", last(F.col("target")))
    x = x.join(covered.select("std", F.col("node_id").alias("s"), F.col("yes").alias("src_ok")), ["std", "s"], "left")
    x = x.join(covered.select("std", F.col("node_id").alias("t"), F.col("yes").alias("target_ok")), ["std", "t"], "left")
    return x.select("std", "node_ord", "edge_ord", "src", "target", F.coalesce("src_ok", F.lit(False)).alias("src_ok"), F.coalesce("target_ok", F.lit(False)).alias("target_ok"))


def scored(stds: DataFrame | None, scores: DataFrame, default: float) -> DataFrame:
    """Scores with a row for each standard: one that a layer has nothing to measure in gets the default."""
    if stds is None:
        return scores
    x = stds.select("std").distinct().join(scores, "std", "left")
    return x.na.fill(0, [n for n, t in scores.dtypes if t == "bigint"]).withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(default)))


def reference_score(states: DataFrame, stds: DataFrame | None = None) -> DataFrame:
    """Satisfied references by all; with the standards given, 0.0 for one without references."""
    ok = F.count_if(F.col("src_ok") & F.col("target_ok"))
    return scored(stds, _reference_score(states, ok), 0.0)


def _reference_score(states: DataFrame, ok: Column) -> DataFrame:
    return states.groupBy("std").agg(F.count(F.lit(1)).alias("n_edges"), ok.alias("n_satisfied"), share(ok, F.count(F.lit(1))).alias("score"))


def reference_findings(states: DataFrame) -> DataFrame:
    broken = states.filter(~(F.col("src_ok") & F.col("target_ok")))
    return findings(broken, "reference_integrity", F.lit("BROKEN_REFERENCE"), F.lit("MAJOR"), F.col("node_ord") * 1000 + F.col("edge_ord"), node_id=F.element_at(F.split("src", ":"), -1), group_key=F.element_at(F.split("src", ":"), 1), title=F.col("target"))


# ---- layer 6


def method_states(required: DataFrame, arts: DataFrame, fuzzy: bool = True, least: float = 0.5) -> DataFrame:
    """(std, activity, method, found): required (std, activity, method) against what artifacts of
    the standard say they used, or write about."""
    r = required.select("std", "activity", "method", F.lower("method").alias("m")).distinct()
    used = arts.select("std", F.explode(F.transform("methods", F.lower)).alias("u")).filter(F.col("u").isNotNull()).distinct()
    names = r.select("std", "m").distinct()
    hits = names.join(used.withColumnRenamed("u", "m"), ["std", "m"], "left_semi")
    hits = hits.union(text_hits(names, arts, "m"))
    if fuzzy:
        # the same names are used in many standards: each pair of names is rated once
        one = F.lit("").alias("one")
        pairs = S.alike(r.select(one, F.col("m").alias("a")), used.select(one, F.col("u").alias("b")), least, key="one").select(F.col("a").alias("m"), F.col("b").alias("u"))
        hits = hits.union(used.join(pairs, "u").select("std", "m"))
    return r.join(hits.distinct().withColumn("hit", F.lit(True)), ["std", "m"], "left").select("std", "activity", "method", F.coalesce("hit", F.lit(False)).alias("found"))


def method_score(states: DataFrame, stds: DataFrame | None = None) -> DataFrame:
    """Methods found by all; with the standards given, 100.0 for one that requires none."""
    return scored(stds, _method_score(states), 100.0)


def _method_score(states: DataFrame) -> DataFrame:
    return states.groupBy("std").agg(F.count(F.lit(1)).alias("n_required"), F.count_if("found").alias("n_found"), share(F.count_if("found"), F.count(F.lit(1))).alias("score"))


def unmatched_by_activity(states: DataFrame, shown: int = 5) -> DataFrame:
    x = states.filter("not found").groupBy("std", "activity")
    return x.agg(F.count(F.lit(1)).alias("n_missing"), F.array_join(F.slice(F.array_sort(F.collect_list("method")), 1, shown), "; ").alias("methods")).withColumn("severity", F.when(F.col("n_missing") < 3, "WARNING").otherwise("MAJOR"))


def method_findings(states: DataFrame) -> DataFrame:
    return findings(unmatched_by_activity(states), "method_audit", F.lit("MISSING_METHOD"), F.col("severity"), F.lit(0), activity=F.col("activity"), title=F.col("methods"))


# ---- layer 7


def trace_states(rules: Sequence[tuple[int, str, str]], arts: DataFrame) -> DataFrame:
    """(std, rule_ord, from_item, to_item, satisfied): some term of either end occurs in the words
    of the standard's links. The rules are a short list; each distinct link word meets them once. No
    rules: no rows (see ``trace_default``)."""
    if not rules:
        return arts.limit(0).select("std", F.lit(0).alias("rule_ord"), F.lit("").alias("from_item"), F.lit("").alias("to_item"), F.lit(False).alias("satisfied"))
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule_ord"), F.lit(f).alias("from_item"), F.lit(t).alias("to_item")) for n, f, t in rules])).alias("rule")
    text = F.lower(F.concat_ws(" ", F.col("l.from"), F.col("l.to"), F.col("l.type")))
    links = arts.select("std", F.explode("links").alias("l")).filter(F.col("l").isNotNull()).select("std", text.alias("text"))
    words = links.select("std", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), 0))).alias("word")).distinct()
    x = words.select("std", "word", rule).select("std", "word", "rule.*")
    hit = lambda item: F.exists(T.tokens(F.col(item)), lambda t: F.contains(F.col("word"), t))
    ok = x.groupBy("std", "rule_ord").agg((F.bool_or(hit("from_item")) & F.bool_or(hit("to_item"))).alias("ok"))
    every = arts.select("std").distinct().select("std", rule).select("std", "rule.*")
    return every.join(ok, ["std", "rule_ord"], "left").select("std", "rule_ord", "from_item", "to_item", F.coalesce("ok", F.lit(False)).alias("satisfied"))


def trace_score(states: DataFrame) -> DataFrame:
    return states.groupBy("std").agg(F.count(F.lit(1)).alias("n_rules"), F.count_if("satisfied").alias("n_satisfied"), share(F.count_if("satisfied"), F.count(F.lit(1))).alias("score"))


def linked(arts: DataFrame) -> DataFrame:
    """(std, linked): whether any artifact of a standard has a link."""
    return arts.groupBy("std").agg(F.bool_or(F.coalesce(F.size("links"), F.lit(0)) > 0).alias("linked"))


def trace_default(arts: DataFrame) -> DataFrame:
    """Scores where there are no rules: 70.0 for a standard with links, else 0.0."""
    return linked(arts).select("std", F.lit(0).cast("bigint").alias("n_rules"), F.lit(0).cast("bigint").alias("n_satisfied"), F.when(F.col("linked"), 70.0).otherwise(0.0).alias("score"))


def trace_default_findings(arts: DataFrame) -> DataFrame:
    """Where there are no rules: links without a model, or no links at all."""
    has = F.col("linked")
    return findings(linked(arts), "traceability_chain", F.when(has, "NO_TRACEABILITY_MODEL").otherwise("NO_TRACEABILITY_EVIDENCE"), F.when(has, "WARNING").otherwise("CRITICAL"), F.lit(0))


def trace_findings(states: DataFrame) -> DataFrame:
    return findings(states.filter("not satisfied"), "traceability_chain", F.lit("MISSING_TRACE_LINK"), F.lit("MAJOR"), F.col("rule_ord"), title=F.concat_ws(" -> ", "from_item", "to_item"))


# ---- layer 8 and what follows


def layer_scores(stds: DataFrame, points: dict[str, DataFrame]) -> DataFrame:
    """(std, layer, score) of every standard and each layer's rows (std, points), points from 0 to 1, in one
    aggregation: a join for each layer fills the driver with plans and threads. A standard that a layer has
    nothing to measure in gets that layer's default, as does one without a name."""
    layer = F.explode(F.array(*[F.lit(n) for n in points])).alias("layer")
    every = stds.select("std").distinct().select("std", layer, F.lit(None).cast("double").alias("points"), F.lit(True).alias("known"))
    rows = [p.filter("std is not null").select("std", F.lit(n).alias("layer"), F.col("points").cast("double").alias("points"), F.lit(False).alias("known")) for n, p in points.items()]
    n = F.count("points")
    mean = F.col("layer").isin("content_alignment", "semantic_matching")
    score = F.when(n == 0, F.when(F.col("layer") == "method_audit", 100.0).otherwise(0.0)).when(mean, F.round(100 * F.avg("points"), 1)).otherwise(share(F.sum("points"), n))
    return united(every, *rows).groupBy("std", "layer").agg(score.alias("score"), F.bool_or("known").alias("known")).filter("known").drop("known")


def coverage_points(states: DataFrame) -> DataFrame:
    return states.select("std", F.when(F.col("state") == "full", 1.0).when(F.col("state") == "partial", 0.5).otherwise(0.0).alias("points"))


def united(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def severity_weight(severity: Column) -> Column:
    out = F.lit(1)
    for name, w in reversed(SEVERITY_WEIGHT):
        out = F.when(severity == name, w).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), severity), F.lit(0)), F.lit(len(SEVERITY_ORDER) + 1))


def gap_groups(all_findings: DataFrame, multiplier: float) -> DataFrame:
    """(std, gap_key, n_findings, base_risk, weighted_risk, worst, priority, first_seen): findings by
    node, else activity, else layer."""
    key = F.coalesce("node_id", "activity", "layer")
    seen = F.struct("layer_ord", "finding_ord")
    g = all_findings.groupBy("std", key.alias("gap_key")).agg(
        F.count(F.lit(1)).alias("n_findings"), F.sum(severity_weight(F.col("severity"))).cast("bigint").alias("base_risk"), F.min(severity_rank(F.col("severity"))).alias("rank"), F.min(seen).alias("seen"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types")
    )
    weighted = F.round(F.col("base_risk") * F.lit(float(multiplier)), 1)
    worst = F.element_at(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("rank").cast("int"))
    return g.select("std", "gap_key", "n_findings", "base_risk", weighted.alias("weighted_risk"), worst.alias("worst"), priority(weighted).alias("priority"), F.col("seen.layer_ord").alias("layer_ord"), F.col("seen.finding_ord").alias("finding_ord"), "types")


def priority(risk: Column) -> Column:
    return F.when(risk >= 80, "HIGH").when(risk >= 20, "MEDIUM").otherwise("LOW")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def top_gaps(gaps: DataFrame, k: int = 10) -> DataFrame:
    """The k gravest gaps of each standard, ties in the order they were first seen."""
    w = Window.partitionBy("std").orderBy(F.desc("weighted_risk"), "layer_ord", "finding_ord", "gap_key")
    return gaps.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def recommendations(gaps: DataFrame, k: int = 10) -> DataFrame:
    """One line for each of the gravest gaps: '[priority] key: ...' with a phrase for each family."""
    has = lambda *ts: F.arrays_overlap(F.split("types", ","), F.array(*[F.lit(t) for t in ts]))
    phrases = F.concat_ws(
        " ",
        F.when(has("MISSING_COVERAGE", "PARTIAL_COVERAGE"), "Add or finish a work product."),
        F.when(has("LOW_CONTENT_ALIGNMENT", "LOW_SEMANTIC_MATCH"), "Say what the clause asks for."),
        F.when(has("MISSING_METHOD"), "Apply the missing methods."),
        F.when(has("BROKEN_REFERENCE", "MISSING_TRACE_LINK"), "Complete the links."),
        F.when(has("MISSING_CONCEPTS"), "Address the missing concepts."),
    )
    return top_gaps(gaps, k).select("std", "place", "gap_key", F.concat(F.lit("["), "priority", F.lit("] "), "gap_key", F.lit(": "), phrases).alias("line"))


def weighted_scores(scores: DataFrame) -> DataFrame:
    """(std, layer, layer_ord, score, weight, contribution, running) of (std, layer, score)."""
    w = F.element_at(F.create_map(*[F.lit(x) for pair in LAYERS for x in pair]), F.col("layer"))
    at = F.array_position(F.array(*[F.lit(n) for n, _ in LAYERS]), F.col("layer"))
    x = scores.withColumn("weight", w).withColumn("layer_ord", at).withColumn("contribution", F.col("score") * F.col("weight"))
    running = F.sum("contribution").over(Window.partitionBy("std").orderBy("layer_ord").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("running", running)


def overall(scores: DataFrame) -> DataFrame:
    # to a millionth, so that the order in which parts are added can't move a grade
    x = weighted_scores(scores).groupBy("std").agg(F.round(F.sum("contribution"), 6).alias("raw"))
    return x.select("std", "raw", F.round("raw", 1).alias("score"), grade(F.col("raw")).alias("grade"))


def named_ids(all_findings: DataFrame) -> DataFrame:
    """(std, ids, n, n_critical, n_major): findings of a node by the ids that they and their messages
    name: the node, of a reference its source and target."""
    edge = F.col("layer") == "reference_integrity"
    ids = F.array_compact(F.array(F.when(edge, F.concat_ws(":", "group_key", "node_id")).otherwise(F.col("node_id")), F.when(edge, F.col("title"))))
    return all_findings.filter("node_id is not null").groupBy("std", ids.alias("ids")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.count_if(F.col("severity") == "MAJOR").alias("n_major"))


def held_ids(parts: DataFrame, ids: DataFrame) -> DataFrame:
    """(std, part, id) of the parts (std, part) that occur, as substrings, in an id (std, id) of their
    standard. A part meets only the ids that hold its first characters."""
    return S.words_with(parts.select("std", F.col("part").alias("piece")), ids.select("std", F.col("id").alias("word"))).select("std", F.col("piece").alias("part"), F.col("word").alias("id"))


def findings_by_claim(arts: DataFrame, all_findings: DataFrame) -> DataFrame:
    """(std, art_ord, n_findings, n_critical, n_major): a finding belongs to the artifacts that map a
    part of an id it names, each once. Blanks around a mapped section don't count."""
    named = named_ids(all_findings)
    claimed = R.claims(arts).select("std", "art_ord", F.trim("node_id").alias("part")).distinct()
    ids = named.select("std", "ids", F.explode(F.array_distinct("ids")).alias("id"))
    x = claimed.join(held_ids(claimed.select("std", "part"), ids.select("std", "id")), ["std", "part"]).join(ids, ["std", "id"]).select("std", "art_ord", "ids").distinct()
    return x.join(named, ["std", "ids"]).groupBy("std", "art_ord").agg(F.sum("n").alias("n_findings"), F.sum("n_critical").alias("n_critical"), F.sum("n_major").alias("n_major"))


def register(arts: DataFrame, all_findings: DataFrame) -> DataFrame:
    """One row for each artifact: counts, sizes and the state its findings give it. A finding
    belongs to the artifacts that map part of an id it names."""
    counted = findings_by_claim(arts, all_findings)
    x = arts.join(counted, ["std", "art_ord"], "left").na.fill(0, ["n_findings", "n_critical", "n_major"])
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    state = F.when(F.trim("full_text") == "", "Missing").when(F.col("n_critical") > 0, "Not Compliant").when(F.col("n_major") > 0, "Partially Compliant").when(size("mapped") > 0, "Compliant").otherwise("N/A")
    return x.select("std", "art_ord", "art_id", "title", "n_findings", "n_critical", "n_major", size("mapped").alias("n_mapped"), F.coalesce(F.array_join(F.slice("mapped", 1, 50), "; "), F.lit("")).alias("mapped"), size("tags").alias("n_tags"), size("methods").alias("n_methods"), F.length("full_text").alias("n_chars"), state.alias("state"), F.concat("n_critical", F.lit("C / "), "n_major", F.lit("M")).alias("counts"))


def register_by_id(rows: DataFrame) -> DataFrame:
    """Register rows looked up by an artifact's id: of several artifacts with one id the first."""
    w = Window.partitionBy("std", "art_id").orderBy("art_ord")
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def inferred_groups(scores: DataFrame, groups: DataFrame, least: float = 40.0) -> DataFrame:
    """(std, node_id, group_key): groups that a section with a good score points to: its id holds the
    group's name or begins with its number. ``scores`` is (std, node_id, score) in percent."""
    ids = scores.filter(F.col("score") > least).select("std", "node_id").filter(F.col("node_id").isNotNull()).distinct()
    g = groups.select("std", "group_key").distinct()
    held = S.words_with(g.select("std", F.col("group_key").alias("piece")), ids.select("std", F.col("node_id").alias("word"))).select("std", F.col("word").alias("node_id"), F.col("piece").alias("group_key"))
    size = F.length("node_id")
    heads = ids.filter(size > 0).select("std", "node_id", F.explode(F.transform(F.sequence(F.lit(1), size), lambda n: F.substring(F.col("node_id"), F.lit(1), n))).alias("number"))
    first = heads.join(g.withColumn("number", F.replace("group_key", F.lit("part_"))), ["std", "number"]).select("std", "node_id", "group_key")
    return held.union(first).distinct()


def trace_matrix(arts: DataFrame) -> DataFrame:
    """(std, art_ord, node_id, verified): one row for each artifact and section it maps."""
    return arts.select("std", "art_ord", F.explode(F.array_distinct("mapped")).alias("node_id"), (F.coalesce(F.size("methods"), F.lit(0)) > 0).alias("verified"), F.coalesce(F.array_join(F.slice("methods", 1, 5), "; "), F.lit("")).alias("verified_by")).filter(F.col("node_id").isNotNull())


def orphan_requirements(reqs: DataFrame, arts: DataFrame) -> DataFrame:
    return reqs.select("std", "node_id").distinct().join(R.claims(arts).select("std", "node_id").distinct(), ["std", "node_id"], "left_anti")


def orphan_artifacts(arts: DataFrame) -> DataFrame:
    return arts.select("std", "art_ord", "art_id").join(R.claims(arts).select("std", "art_ord").distinct(), ["std", "art_ord"], "left_anti")


def trace_coverage(reqs: DataFrame, arts: DataFrame) -> DataFrame:
    n = reqs.groupBy("std").agg(F.count(F.lit(1)).alias("n_requirements"))
    a = arts.groupBy("std").agg(F.count(F.lit(1)).alias("n_artifacts"), F.count_if(F.coalesce(F.size(F.array_compact("mapped")), F.lit(0)) > 0).alias("n_with_traces"))
    c = trace_matrix(arts).groupBy("std", "node_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("v"))
    c = c.groupBy("std").agg(F.count(F.lit(1)).alias("n_traced"), F.sum("n").alias("n_chains"), F.sum("v").alias("n_verified"))
    o = orphan_requirements(reqs, arts).groupBy("std").agg(F.count(F.lit(1)).alias("n_orphans"))
    x = n.join(a, "std", "left").join(c, "std", "left").join(o, "std", "left").na.fill(0)
    return x.select("std", "n_requirements", "n_traced", "n_artifacts", "n_with_traces", "n_chains", "n_verified", F.col("n_orphans").alias("n_orphan_requirements"), (F.col("n_artifacts") - F.col("n_with_traces")).alias("n_orphan_artifacts"), F.least(F.lit(100.0), share(F.col("n_traced"), F.col("n_requirements"))).alias("coverage"))


def severity_histogram(all_findings: DataFrame) -> DataFrame:
    """(severity, n, share): counts over everything and their share in percent."""
    n = all_findings.groupBy(F.coalesce("severity", F.lit("INFO")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over one row for each severity
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


def heat_map(all_findings: DataFrame) -> DataFrame:
    """Findings by group and severity."""
    return all_findings.groupBy(F.coalesce("group_key", F.lit("unknown")).alias("group_key")).pivot("severity", list(SEVERITY_ORDER)).count().na.fill(0)


def gap_heat_map(all_findings: DataFrame, gaps: DataFrame, k: int = 10) -> DataFrame:
    """Findings of each standard's gravest gaps by severity."""
    keyed = all_findings.select("std", F.coalesce("node_id", "activity", "layer").alias("gap_key"), F.coalesce("severity", F.lit("INFO")).alias("severity"))
    top = top_gaps(gaps, k).select("std", "gap_key", "place")
    return keyed.join(top, ["std", "gap_key"]).groupBy("std", "place", "gap_key").pivot("severity", list(SEVERITY_ORDER)).count().na.fill(0)


def matrix_summary(states: DataFrame) -> DataFrame:
    """(std, n_missing, n_partial, n_compliant): distinct sections that are missing or partial, the rest."""
    x = states.groupBy("std", "node_id").agg(F.bool_or(F.col("state") == "missing").alias("m"), F.bool_or(F.col("state") == "partial").alias("p"))
    g = x.groupBy("std").agg(F.count_if("m").alias("n_missing"), F.count_if("p").alias("n_partial"))
    n = states.groupBy("std").agg(F.count(F.lit(1)).alias("n"))
    return n.join(g, "std").select("std", "n_missing", "n_partial", F.greatest(F.lit(0), F.col("n") - F.col("n_missing") - F.col("n_partial")).cast("bigint").alias("n_compliant"))


def appendix(all_findings: DataFrame, k: int = 100) -> DataFrame:
    """The first k findings of each standard by severity, then in the order they were found."""
    w = Window.partitionBy("std").orderBy(severity_rank(F.col("severity")), "layer_ord", "finding_ord", F.coalesce("activity", F.lit("")))
    x = all_findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return x.select("std", "place", "severity", "layer", "type", F.coalesce("node_id", "activity", "layer").alias("about"))


def layer_stats(all_findings: DataFrame) -> DataFrame:
    """(layer, n, n_critical, n_major): findings of each layer."""
    return all_findings.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.count_if(F.col("severity") == "MAJOR").alias("n_major"))


def gap_advice(gaps: DataFrame, lines: DataFrame, absent: str = "Review and close this gap.") -> DataFrame:
    """(std, gap_key, advice): each gap with the recommendation whose line names it, else a default."""
    named = lines.select("std", F.regexp_extract("line", r"^\[\w+\] (.*?): ", 1).alias("gap_key"), F.regexp_extract("line", r"^\[\w+\] .*?: (.*)$", 1).alias("advice"))
    return gaps.select("std", "gap_key").join(named.dropDuplicates(["std", "gap_key"]), ["std", "gap_key"], "left").select("std", "gap_key", F.coalesce("advice", F.lit(absent)).alias("advice"))


def findings_by_part(all_findings: DataFrame) -> DataFrame:
    x = all_findings.groupBy(F.coalesce("group_key", F.lit("unknown")).alias("group_key"))
    health = F.when(F.col("n") == 0, "green").when(F.col("n_critical") > 0, "red").otherwise("amber")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.countDistinct("std", "node_id").alias("n_nodes")).withColumn("health", health)


def compliance_matrix(states: DataFrame, sims: DataFrame, k: int | None = None) -> DataFrame:
    """The requirements of each standard (the first k, if given) by group and section, with their
    place, state and alignment."""
    w = Window.partitionBy("std").orderBy("group_key", "node_id", "node_ord")
    x = states.withColumn("place", F.row_number().over(w))
    x = (x if k is None else x.filter(F.col("place") <= k)).join(sims, ["std", "node_ord"], "left")
    return x.select("std", "place", "group_key", "node_id", "state", F.round(100 * F.col("sim"), 1).alias("alignment"))


def last_scores(reqs: DataFrame, sims: DataFrame) -> DataFrame:
    """(std, node_id, score): of sections that several parts share, the last one's score."""
    return reqs.join(sims, ["std", "node_ord"]).groupBy("std", "node_id").agg(F.round(100 * F.max_by("sim", "node_ord"), 1).alias("score"))


def decision(scores: DataFrame, hist: DataFrame) -> DataFrame:
    """(std, verdict) from the unrounded overall score and the findings of each standard."""
    n = hist.groupBy("std").agg(F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"), F.count_if(F.col("severity") == "MAJOR").alias("n_major"))
    x = scores.join(n, "std", "left").na.fill(0, ["n_critical", "n_major"])
    verdict = F.when((F.col("raw") >= 85) & (F.col("n_critical") == 0) & (F.col("n_major") <= 2), "COMPLIANT").when((F.col("raw") >= 60) & (F.col("n_critical") <= 2), "CONDITIONALLY COMPLIANT").otherwise("NOT COMPLIANT")
    return x.select("std", "score", "grade", "n_critical", "n_major", verdict.alias("verdict"))


def level_multiplier(target: str, scale: Sequence[str]) -> float:
    return float(2 ** scale.index(target)) if target in scale else 1.0
