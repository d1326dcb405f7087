"""Mixing sources to target shares of the total size, by Poisson replication.

Each document gets a uniform number from a hash of its key; inverting the Poisson distribution
with its source's mean at that number, cut at the source's cap, gives how often it is used. The
mean is calibrated: with a document's number fixed, its count steps up at known means, so the
size a source reaches is a step function of its mean. The steps are summed in a fixed number of
bins for each source (pre-aggregated, never more rows than sources x bins), and the bin is taken
in which the target is reached. The documents are exploded by their counts and shuffled globally
by a hash.

The total is the largest at which every source can keep its share under its cap; a smaller one
may be asked for. At the largest, the source that limits it is used up: each of its documents
comes as often as the cap allows, which is the Poisson count cut at the cap for a great mean.

Defined results
* documents whose source is null or not on the list, and null keys: left out;
* null, empty and blank texts: size 0, left out (they would only add empty records);
* a source on the list without documents: its share is missing, the others keep their
  proportions; it is reported with 0;
* a target of null, 0 or less, or a cap below 1: the source is not used;
* a document key that occurs twice: two documents with equal counts;
* an empty list or no documents: no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.tokenizer import token_counts
from traceloom.session import scratch_path

SEED = 17
#: Bins for the calibration of a source's mean, on a scale of log2(mean) from -24 to 8.
BINS = 16384
_LOW, _HIGH = -24.0, 8.0


def _uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from a hash of the key."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _steps(caps: int) -> list[np.ndarray]:
    """For k = 1..caps: P(N < k) at each bin's mean, falling along the bins. Each row adds one term to
    the one before."""
    means = np.array([2.0 ** (_LOW + (_HIGH - _LOW) * b / BINS) for b in range(BINS + 1)])
    term = np.array([math.exp(-m) for m in means])
    out = [term.copy()]
    for k in range(1, caps):
        term = term * means / k
        out.append(out[-1] + term)
    return out


def sized(documents: DataFrame, targets: DataFrame, key: str = "doc_id", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, source, n_tokens) of the documents that may be used."""
    listed = usable_targets(targets).select("source")
    d = documents.filter(F.col(key).isNotNull() & (F.length(F.trim("text")) > 0)).join(F.broadcast(listed), "source", "left_semi")
    return token_counts(d, [key, "source"], vocabulary=vocabulary, folder=folder).filter("n_tokens > 0")


def usable_targets(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats); a source listed twice counts once, with its largest share."""
    t = targets.filter("source is not null and target_share > 0 and max_repeats >= 1")
    return t.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")


def replicate(documents: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = SEED, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts: key, source, n_tokens, n_uses; plan: source, share, cap, mean ...)."""
    spark = documents.sparkSession
    docs = sized(documents, targets, key, vocabulary, folder).withColumn("u", _uniform(F.col(key).cast("string"), seed))
    # the list of sources is a small configuration table: one row for each
    wanted = {r.source: (r.target_share, r.max_repeats) for r in usable_targets(targets).collect()}
    if not wanted:
        empty = docs.limit(0).select(key, "source", "n_tokens", F.lit(0).alias("n_uses"))
        return empty, spark.createDataFrame([], "source string, mean_bin int, max_repeats int")
    caps = max(c for _, c in wanted.values())
    table = spark.sparkContext.broadcast(_steps(caps))
    cap_of = {s: c for s, (_, c) in wanted.items()}
    kind = documents.schema[key].dataType.simpleString()

    # the bins at which a document's count steps to 1, 2, ... cap
    def step_bins(batches):
        import pyarrow as pa

        falling = [-row for row in table.value]
        for batch in batches:
            u = batch.column("u").to_numpy(zero_copy_only=False)
            steps = np.stack([np.searchsorted(f, -u, side="left") for f in falling], axis=1).astype(np.int32)
            c = np.array([cap_of[s] for s in batch.column("source").to_pylist()], dtype=np.int32)
            keep = np.arange(caps)[None, :] < c[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(c))).astype(np.int32)), pa.array(steps[keep]))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("source"), batch.column("n_tokens"), lists], names=[key, "source", "n_tokens", "steps"])

    stepped = docs.mapInArrow(step_bins, f"{key} {kind}, source string, n_tokens bigint, steps array<int>")
    # read twice, and the texts must not be encoded again: a written table survives lost executors
    stepped.write.parquet(path := scratch_path(spark, "mixing"))
    stepped = spark.read.parquet(path)
    bins = stepped.select("source", "n_tokens", F.explode("steps").alias("bin")).groupBy("source", "bin").agg(F.sum("n_tokens").alias("mass"))
    # at most sources x bins rows, whatever the corpus
    mass: dict[str, dict[int, int]] = {}
    for r in bins.toLocalIterator():
        mass.setdefault(r.source, {})[r.bin] = r.mass
    shares = {s: w for s, (w, _) in wanted.items() if s in mass}
    norm = sum(shares.values())
    most = min(sum(mass[s].values()) * norm / w for s, w in shares.items()) if shares else 0
    total = most if total is None else min(total, most)
    chosen = []
    for s, w in shares.items():
        goal, reached, best = total * w / norm, 0, -1
        for b in sorted(mass[s]):
            after = reached + mass[s][b]
            if after > goal and after - goal > goal - reached:
                break
            reached, best = after, b
        chosen.append((s, best))
    means = spark.createDataFrame(chosen, "source string, mean_bin int")
    used = stepped.join(F.broadcast(means), "source").select(key, "source", "n_tokens", F.size(F.filter("steps", lambda x: x <= F.col("mean_bin"))).alias("n_uses"))
    return used.filter("n_uses > 0"), means


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = SEED, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The collection in its shuffled order: (position hash, key, source, n_tokens, copy)."""
    used, _ = replicate(documents, targets, key, total, seed, vocabulary, folder)
    copies = used.select(key, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_uses"))).alias("copy_no"))
    place = F.xxhash64(F.lit(seed + 1), F.col(key).cast("string"), F.col("copy_no"))
    return copies.select(place.alias("place"), key, "source", "n_tokens", "copy_no").repartitionByRange("place").sortWithinPartitions("place", key, "copy_no")


def shares(documents: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = SEED, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """For each source of the list: target and reached share, documents, uses, tokens, largest use."""
    used, _ = replicate(documents, targets, key, total, seed, vocabulary, folder)
    got = used.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_uses").alias("n_uses"), F.max("n_uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("n_tokens")
    )
    x = targets.filter("source is not null").join(got, "source", "left").na.fill(0, ["n_documents", "n_uses", "most_uses", "n_tokens"])
    whole = got.agg(F.sum("n_tokens").alias("whole"))
    x = x.crossJoin(F.broadcast(whole))  # one row
    return x.select("source", "target_share", "max_repeats", "n_documents", "n_uses", "most_uses", "n_tokens", F.coalesce(F.col("n_tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"))
