"""Text likeness inside a standard: TF-IDF cosines and fuzzy ratios in bounded blocks,
containment of terms.

Cosines and fuzzy ratios have to see the pairs of a standard, so the rows of either side are spread
over blocks of bounded size and blocks meet blocks: a row travels once for each block of the other
side, not once for each pair, and no group grows with the data.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import text as T
from traceloom.functions.likeness import Bounds, Prepared, Ranked, likeness

#: Sizes of the pieces of words that substrings are looked up by.
GRAMS = (6, 3, 2, 1)
#: Rows of one side in a block, and characters of their texts, on average.
BLOCK, LETTERS = 256, 2**19
#: Texts that a requirement is rated with before bounds, where some ratio is enough.
TRIES = 16
#: The same for cosines, and the numbers held at a time in a block of them.
DOCUMENTS, DENSE = 1024, 2_000_000


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(std, key, term, n, n_all): occurrences of each term and of all terms of a row."""
    x = df.select("std", key, T.tokens(F.col(text)).alias("ts")).select("std", key, F.size("ts").alias("n_all"), F.explode("ts").alias("term"))
    return x.groupBy("std", key, "n_all", "term").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(df: DataFrame, key: str, text: str) -> DataFrame:
    return term_counts(df, key, text).select("std", key, "term", (F.col("n") / F.col("n_all")).alias("tf"))


def inverse_document_frequency(arts: DataFrame, counts: DataFrame) -> DataFrame:
    """(std, term, idf): ln(n / (1 + df)) over the artifacts of a standard; may be 0 or less."""
    n = arts.groupBy("std").agg(F.count(F.lit(1)).alias("n_docs"))
    df = counts.groupBy("std", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "std").select("std", "term", F.log(F.col("n_docs") / (1 + F.col("df"))).alias("idf"))


def _weights(texts: list[str], number: dict[str, int], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row of blank-separated terms, the numbers of the terms that have one, and their weights
    in a vector of unit length. A term without a number weighs 1 and counts in the length."""
    out = []
    for text in texts:
        counts = Counter(text.split())
        n_all = counts.total()
        known = [(number[t], n) for t, n in counts.items() if t in number]
        rest = sum(n * n for t, n in counts.items() if t not in number)
        at = np.fromiter((k for k, _ in known), np.int64, len(known))
        w = np.fromiter((n for _, n in known), np.float64, len(known)) * idf[at]
        length = math.sqrt(float(w @ w) + rest) / n_all if n_all else 0.0
        out.append((at, w / n_all / length if length else np.zeros(len(known))))
    return out


def _vocabulary(left: pa.Table) -> pa.Table:
    """(std, n, terms, counts) of a block of artifacts (std, n, b): in how many rows each term occurs."""
    counts = Counter(t for text in left["b"].to_pylist() for t in set(text.split()))
    return pa.table({"std": left["std"][:1], "n": pa.array([left.num_rows], pa.int64()), "terms": pa.array([list(counts)], pa.list_(pa.string())), "counts": pa.array([list(counts.values())], pa.list_(pa.int64()))})


def _idf(blocks: pa.Table) -> pa.Table:
    """(std, terms, idf) of the vocabularies of a standard's blocks, terms joined by blanks."""
    n, counts = sum(blocks["n"].to_pylist()), Counter()
    for terms, times in zip(blocks["terms"], blocks["counts"]):
        for t, k in zip(terms.as_py(), times.as_py()):
            counts[t] += k
    return pa.table({"std": blocks["std"][:1], "terms": pa.array([" ".join(counts)]), "idf": pa.array([[math.log(n / (1 + k)) for k in counts.values()]], pa.list_(pa.float64()))})


def _best_cosine(left: pa.Table, right: pa.Table) -> pa.Table:
    """(node_ord, best) of a block of requirements, and a row of its standard's idf, with artifacts. Vectors
    of artifacts are laid out densely by the terms of the requirements, a bounded piece at a time."""
    empty = pa.table({"node_ord": pa.array([], pa.int64()), "best": pa.array([], pa.float64())})
    if not right.num_rows:
        return empty
    rows = list(zip(left["node_ord"].to_pylist(), left["b"].to_pylist(), left["idf"].to_pylist()))
    terms, idf = next(((b, w) for k, b, w in rows if k is None), ("", []))
    keys = [k for k, _, _ in rows if k is not None]
    if not keys:
        return empty
    number, weight = {t: i for i, t in enumerate(terms.split())}, np.asarray(idf, np.float64)
    nodes = _weights([b for k, b, _ in rows if k is not None], number, weight)
    used = np.unique(np.concatenate([at for at, _ in nodes]))
    place = np.full(len(number), -1, np.int64)
    place[used] = np.arange(len(used))
    nodes = [(place[at], w) for at, w in nodes]
    best, texts = np.zeros(len(keys)), right["b"].to_pylist()
    size = max(1, DENSE // max(1, len(used)))
    for i in range(0, len(texts), size):
        arts = _weights(texts[i : i + size], number, weight)
        dense = np.zeros((len(used), len(arts)))
        for j, (at, w) in enumerate(arts):
            kept = place[at] >= 0
            dense[place[at[kept]], j] = w[kept]
        for j, (at, w) in enumerate(nodes):
            if len(at):
                best[j] = max(best[j], (w @ dense[at]).max())
    return pa.table({"node_ord": pa.array(keys, pa.int64()), "best": pa.array(best)})


def alignment(node_rows: DataFrame, arts: DataFrame) -> DataFrame:
    """(std, node_ord, sim): the best cosine of a requirement with any artifact of its standard, 0 if
    none shares a term. Rows travel as texts of terms, once for each block of the other side, and a
    block gives one number for each requirement: no pair of rows and no term of a row is shuffled."""
    text = lambda c: F.coalesce(F.concat_ws(" ", T.tokens(F.col(c))), F.lit("")).alias("b")
    a = arts.filter("std is not null").select("std", "art_ord", text("full_text"))
    n = node_rows.filter("std is not null").select("std", "node_ord", text("node_text"))

    def bins(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("std").agg(F.ceil(F.count(F.lit(1)) / DOCUMENTS).cast("int").alias(name))

    # standards with both sides; an idf is of no use to the others
    counts = bins(n, "__nl").join(bins(a, "__nr"), "std")
    of = lambda key, size: F.pmod(F.xxhash64(key), F.col(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    a = a.join(counts, "std").withColumn("__br", of("art_ord", "__nr"))
    vocabulary = a.select("std", "__br", "b").groupBy("std", "__br").applyInArrow(_vocabulary, "std string, n long, terms array<string>, counts array<long>")
    idf = vocabulary.groupBy("std").applyInArrow(_idf, "std string, terms string, idf array<double>")
    left = n.join(counts, "std").select("std", "node_ord", "b", F.lit(None).cast("array<double>").alias("idf"), of("node_ord", "__nl").alias("__bl"), every("__nr").alias("__br"))
    of_all = idf.join(counts, "std").select("std", F.lit(None).cast("long").alias("node_ord"), F.col("terms").alias("b"), "idf", every("__nl").alias("__bl"), "__nr")
    left = left.unionByName(of_all.select("std", "node_ord", "b", "idf", "__bl", every("__nr").alias("__br")))
    right = a.select("std", "b", every("__nl").alias("__bl"), "__br")
    group = ["std", "__bl", "__br"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_best_cosine, "node_ord long, best double")
    best = found.groupBy("node_ord").agg(F.max("best").alias("best"))
    return node_rows.select("std", "node_ord").join(best, "node_ord", "left").select("std", "node_ord", F.coalesce("best", F.lit(0.0)).alias("sim"))


def blocked(left: DataFrame, right: DataFrame, key: str, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = BLOCK) -> DataFrame:
    """``run`` over all pairs of blocks of two tables of the same ``key``, as a cogroup. A key of n and
    m rows gives about n/block x m/block groups, so a key that holds a third of all rows is spread.
    Long texts make more blocks, so that none holds more than ``LETTERS`` characters on average."""
    def bins(df: DataFrame, name: str) -> DataFrame:
        letters = F.sum(F.length(F.concat_ws("", *[c for c in df.columns if c != key])))
        return df.groupBy(key).agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, letters / LETTERS)).cast("int").alias(name))

    counts = bins(left, "__nl").join(bins(right, "__nr"), key)

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        x = df.join(counts, key).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(own.replace("__b", "__n"))).cast("int"))
        return x.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other.replace("__b", "__n")) - 1))).drop("__nl", "__nr")

    group = [key, "__bl", "__br"]
    # the work is in the pairs, not in the bytes by which adaptive execution would join partitions:
    # a number of its own keeps them, more than usual since blocks differ in weight
    n = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = (spread(df, *names).repartition(n, *group).groupBy(*group) for df, names in ((left, ("__bl", "__br")), (right, ("__br", "__bl"))))
    return x.cogroup(y).applyInArrow(run, schema)


def best_ratio(node_rows: DataFrame, arts: DataFrame, enough: float | None = None) -> DataFrame:
    """(std, node_ord, ratio): the best fuzzy likeness of a requirement's text with an artifact's.

    Both texts count whole. Equal texts are rated once; in a block each artifact's text is prepared
    once. A requirement meets the artifacts by descending upper bounds of their likeness, until none can
    raise its maximum. Maxima are merged by an aggregation; texts don't return from the blocks, but
    their digests.

    ``enough``: for who asks only which requirements stay below it. Those have their best ratio; one
    that reaches it in a block is rated no further there, and has some ratio that reaches it.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    n = node_rows.select("std", text.alias("a"))
    b = arts.select("std", F.lower("full_text").alias("b")).distinct()
    limit = math.inf if enough is None else enough

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["std", "digest", "best"]
        if not left.num_rows or not right.num_rows:
            return pa.table({"std": pa.array([], pa.string()), "digest": pa.array([], pa.string()), "best": pa.array([], pa.float64())})
        texts, best = left["a"].to_pylist(), [-1.0] * left.num_rows
        prepared = [Prepared(y) for y in right["b"].to_pylist()]
        # short texts have the higher ratios: a few of them mostly are enough, before bounds are looked for
        first = sorted(prepared, key=lambda p: p.places is not None)[:TRIES] if enough is not None else []
        ranked = Ranked(prepared)
        for i, x in enumerate(texts):
            for p in first:
                best[i] = max(best[i], likeness(x, p))
                if best[i] >= limit:
                    break
            best[i] = ranked.best(x, best[i], limit)
        return pa.table([left["std"], pa.array([sha256(x.encode()).hexdigest() for x in texts]), pa.array(best, pa.float64())], names=names)

    found = blocked(n.distinct(), b, "std", run, "std string, digest string, best double").groupBy("std", "digest").agg(F.max("best").alias("best"))
    return node_rows.select("std", "node_ord", F.sha2(text.cast("binary"), 256).alias("digest")).join(found, ["std", "digest"], "left").select("std", "node_ord", F.coalesce("best", F.lit(0.0)).alias("ratio"))


def alike(left: DataFrame, right: DataFrame, least: float, strict: bool = False, key: str = "std") -> DataFrame:
    """(key, a, b) of the texts (key, a) and (key, b) that are alike: a ratio of ``least`` or more, or
    ``strict``: above it."""
    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        texts, keys, found = x["a"].to_pylist(), x[key].to_pylist(), []
        prepared = [Prepared(b) for b in y["b"].to_pylist()]
        bounds = Bounds(prepared) if prepared else None
        for k, a in zip(keys, texts) if bounds else ():
            most = bounds.of(a)
            for j in np.flatnonzero(most > least if strict else most >= least).tolist():
                r = likeness(a, prepared[j])
                if r > least or not strict and r == least:
                    found.append((k, a, prepared[j].text))
        columns = zip(*found) if found else ([], [], [])
        return pa.table([pa.array(c, pa.string()) for c in columns], names=[key, "a", "b"])

    return blocked(left.select(key, "a").distinct(), right.select(key, "b").distinct(), key, run, f"{key} string, a string, b string")


def title_matches(node_rows: DataFrame, arts: DataFrame, least: float = 0.6) -> DataFrame:
    """(std, node_ord) of requirements whose title is like an artifact's; each distinct pair of
    titles of a standard is rated once."""
    n = node_rows.select("std", "node_ord", F.lower(F.coalesce("title", F.lit(""))).alias("a"))
    return n.join(alike(n, arts.select("std", F.lower("title").alias("b")), least, strict=True).select("std", "a").distinct(), ["std", "a"], "left_semi").select("std", "node_ord")


def held_pieces(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """(piece, word): the words that hold a piece. A piece meets the words that hold its first
    characters, six, three, two or one of them; the empty piece meets the empty word only."""
    size = F.length("piece")
    first = F.col("piece")
    for g in reversed(GRAMS):
        first = F.when(size >= g, F.substring("piece", 1, g)).otherwise(first)
    p = pieces.select("piece").distinct().withColumn("__gram", first)
    n = F.length("word")

    def pieces_of(g: int) -> Column:
        return F.when(n >= g, F.transform(F.sequence(F.lit(1), n - g + 1), lambda i: F.substring(F.col("word"), i, F.lit(g)))).otherwise(F.array().cast("array<string>"))

    every = F.when(n == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.flatten(F.array(*[pieces_of(g) for g in GRAMS]))))
    grams = words.select("word").distinct().select("word", F.explode(every).alias("__gram"))
    return p.join(grams, "__gram").filter(F.contains("word", "piece")).select("piece", "word")


def words_with(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """(std, piece, word): the words (std, word) of a standard that hold a piece (std, piece) of it.
    Pieces and words meet once over all standards; each standard then keeps its own."""
    own = pieces.filter("piece <> ''").select("std", "piece").distinct()
    spoken = words.filter("word <> ''").select("std", "word").distinct()
    return spoken.join(held_pieces(own, spoken), "word").join(own, ["std", "piece"], "left_semi").select("std", "piece", "word")


def containment(node_rows: DataFrame, arts: DataFrame) -> DataFrame:
    """(std, node_ord, share): which share of a requirement's distinct terms occurs, as substrings,
    in any artifact text of its standard. A term of letters and digits lies inside one word, so the distinct
    terms of a standard are looked for in blocks of its texts; the terms that no block holds go back."""
    terms = node_rows.select("std", "node_ord", F.array_distinct(T.tokens(F.col("node_text"))).alias("terms")).filter("size(terms) > 0")
    wanted = terms.select("std", F.explode("terms").alias("term")).groupBy("std").agg(F.collect_set("term").alias("wanted"))
    bins = arts.groupBy("std").agg(F.ceil(F.count(F.lit(1)) / DOCUMENTS).cast("int").alias("__n"))
    texts = arts.select("std", "art_ord", F.lower("full_text").alias("text")).join(bins, "std")
    blocks = texts.groupBy("std", F.pmod(F.xxhash64("art_ord"), F.col("__n")).alias("__b")).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    lacking = blocks.join(wanted, "std").select("std", F.explode(F.filter("wanted", lambda t: ~F.contains(F.col("text"), t))).alias("term"))
    # a block that happens to be empty lacks nothing, so the blocks that there are count
    there = blocks.groupBy("std").agg(F.count(F.lit(1)).alias("__there"))
    lacking = lacking.groupBy("std", "term").agg(F.count(F.lit(1)).alias("__k")).join(there, "std").filter("__k = __there").groupBy("std").agg(F.collect_list("term").alias("lacking"))
    known = there.join(lacking, "std", "left").select("std", F.coalesce("lacking", F.array().cast("array<string>")).alias("lacking"))
    n = F.size("terms")
    share = (n - F.size(F.array_intersect("terms", "lacking"))) / n
    return terms.join(known, "std", "left").select("std", "node_ord", F.coalesce(share, F.lit(0.0)).alias("share"))
