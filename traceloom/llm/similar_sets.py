"""All pairs of records whose sets of values overlap above a threshold.

Equal sets become one class first, so copies cost nothing. Each class gets minwise hash
signatures, split into bands; classes that share a bucket of any band are candidates, pruned by
exact bounds (sizes, and a bitmap of the elements from which the overlap can't be larger than
assumed), deduplicated, and verified against the sets themselves.

With 20 bands of 3 rows a pair at the threshold of 0.65 is missed with a chance of 0.16 %, one
at 0.7 with 0.02 %; ``exact`` takes candidates that miss none. There is no cap on buckets or partners; a bucket that many classes share is
a skewed key of an equi-join, which adaptive execution splits.

Defined results
* null arrays, null and blank elements: no element; elements count once;
* sets with fewer than ``min_size`` elements take no part;
* a record delivered twice counts once, as delivered first;
* records with equal sets are a pair (overlap 1); a record is no pair with itself;
* empty tables: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import folded_values, once
from traceloom.session import scratch_path

THRESHOLD = 0.65
MIN_SIZE = 4
BANDS = 20
ROWS = 3


def record_sets(df: DataFrame, key: str, values: str, min_size: int = MIN_SIZE, order: str = "loaded_at") -> DataFrame:
    """(record_key, loaded_at, items): the sorted set of each delivered row; null where it has
    fewer than ``min_size`` elements."""
    items = F.array_sort(F.array_distinct(folded_values(F.col(values))))
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("record_key"), F.col(order).alias("loaded_at"), F.when(F.size(items) >= min_size, items).alias("items"))


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: class_id, check, record_key) and (classes: class_id, check, items), equal sets in
    one class. A class is named by 128 bits; only the first 64 travel with the bands. Rows and
    classes are written once to the shared folder, since each is read several times: for the
    bands, for verification and for the members."""
    spark = sets.sparkSession
    named = sets.select("record_key", "loaded_at", "items", F.xxhash64("items").alias("class_id"), F.xxhash64(F.lit(7), "items").alias("check"))
    named.write.parquet(path := scratch_path(spark, "sets"))
    named = spark.read.parquet(path)
    narrow = named.select("record_key", "loaded_at", "class_id", "check", F.col("items").isNotNull().alias("large"))
    members = once(narrow, "record_key", "class_id", "check", "large").filter("large").select("class_id", "check", "record_key")
    classes = named.filter(F.col("items").isNotNull()).select("class_id", "check", "items").dropDuplicates(["class_id", "check"])
    classes.write.parquet(path := scratch_path(spark, "classes"))
    return members, spark.read.parquet(path)


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_rows(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(band, class_id, sketch): a bucket of each band. The sketch is the size (8 bits, 255: that
    or more) and a bitmap of 24 bits; a bucket is named by 48 bits, a false meeting only costs a look."""
    schema = pa.schema([("band", pa.int64()), ("class_id", pa.int64()), ("sketch", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        a, b = _mixers(bands * rows)
        salt, _ = _mixers(bands)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lists = batch.column(1)
                values = lists.flatten().dictionary_encode()
                names = np.array([xxh64_intdigest(v.encode()) for v in values.dictionary.to_pylist()], dtype=np.uint64)
                h = names[values.indices.to_numpy()]
                lengths = np.diff(lists.offsets.to_numpy())
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
                bitmap = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), h % np.uint64(24)), starts)
                sketch = (bitmap << np.uint64(8)) | np.minimum(lengths, 255).astype(np.uint64)
                out = []
                for k in range(bands):
                    band = np.full(len(starts), salt[k], dtype=np.uint64)
                    for r in range(k * rows, (k + 1) * rows):
                        x = h * a[r] + b[r]
                        x ^= x >> np.uint64(29)
                        low = np.minimum.reduceat(x * np.uint64(0xBF58476D1CE4E5B9), starts)
                        band = (band ^ low) * np.uint64(0x9E3779B97F4A7C15)
                        band ^= band >> np.uint64(32)
                    out.append(band >> np.uint64(16))
                ids = np.tile(batch.column(0).to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(ids), pa.array(np.tile(sketch.astype(np.uint32).view(np.int32), bands))], schema=schema)

    return classes.select("class_id", "items").mapInArrow(run, "band bigint, class_id bigint, sketch int")


def candidate_pairs(bands: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs of classes that share a bucket and may reach the threshold."""
    l = bands.select("band", F.col("class_id").alias("a"), F.col("sketch").alias("sa"))
    r = bands.select("band", F.col("class_id").alias("b"), F.col("sketch").alias("sb"))
    na, nb = F.col("sa").bitwiseAND(255), F.col("sb").bitwiseAND(255)
    ma, mb = F.shiftrightunsigned("sa", 8), F.shiftrightunsigned("sb", 8)
    # elements of one side whose bit the other lacks are surely not shared
    shared = F.least(na - F.bit_count(ma.bitwiseAND(F.bitwise_not(mb))), nb - F.bit_count(mb.bitwiseAND(F.bitwise_not(ma))))
    possible = (na == 255) | (nb == 255) | (shared >= F.lit(threshold) * (na + nb - shared) - 1e-9)
    return l.join(r, "band").filter((F.col("a") < F.col("b")) & possible).select("a", "b").distinct()


def prefix_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of classes that may reach the threshold, none missed: two such sets share one of
    the first elements of both, in the order of how rare elements are; so many that the rest of
    either is too small to reach it. Costlier than bands where elements are common."""
    items = classes.select("class_id", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    ordered = items.join(often, "item").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("o"))  # of one set
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    first = ordered.select("class_id", "n", F.explode(F.slice(F.col("o.item"), F.lit(1), keep.cast("int"))).alias("item"))
    l, r = (first.select("item", F.col("class_id").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    least = F.lit(threshold) - 1e-9
    return l.join(r, "item").filter((F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))).select("a", "b").distinct()


def verified(pairs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, ca, b, cb, n_shared, n_all) of the candidate pairs that reach the threshold by their sets."""
    x = pairs.join(classes.select(F.col("class_id").alias("a"), F.col("check").alias("ca"), F.col("items").alias("ia")), "a")
    x = x.join(classes.select(F.col("class_id").alias("b"), F.col("check").alias("cb"), F.col("items").alias("ib")), "b")
    x = x.withColumn("n_shared", F.size(F.array_intersect("ia", "ib"))).withColumn("n_all", F.size("ia") + F.size("ib") - F.col("n_shared"))
    return x.filter(_alike(F.col("n_shared"), F.col("n_all"), threshold)).select("a", "ca", "b", "cb", "n_shared", "n_all")


def _alike(shared: Column, everything: Column, threshold: float) -> Column:
    # whole numbers: 0.65 has no exact binary form
    return shared * 1000 >= everything * round(threshold * 1000)


def class_pairs(sets: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs between classes, members of classes): the result in its compact form. ``exact``: candidates
    from shared first elements in place of bands, so that no pair can be missed."""
    members, classes = set_classes(sets)
    pairs = prefix_pairs(classes, threshold) if exact else candidate_pairs(band_rows(classes), threshold)
    return verified(pairs, classes, threshold), members


def similar_records(sets: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(left_key, right_key), smaller first: pairs within classes and between similar classes."""
    pairs, members = class_pairs(sets, threshold, exact)
    left = members.select(F.col("class_id").alias("a"), F.col("check").alias("ca"), F.col("record_key").alias("x"))
    right = members.select(F.col("class_id").alias("b"), F.col("check").alias("cb"), F.col("record_key").alias("y"))
    between = pairs.select("a", "ca", "b", "cb").join(left, ["a", "ca"]).join(right, ["b", "cb"]).select(F.least("x", "y").alias("left_key"), F.greatest("x", "y").alias("right_key"))
    same = left.join(right, (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))).filter(F.col("x") < F.col("y")).select(F.col("x").alias("left_key"), F.col("y").alias("right_key"))
    return between.unionAll(same)


def linked_records(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(record_key, class_id, n_copies, n_links): the compact form, one row for each record.
    ``class_id`` is the smallest key of the class; n_links counts the similar classes, not the copies in them."""
    pairs, members = class_pairs(sets, threshold)
    name = ["class_id", "check"]
    both = pairs.select(F.col("a").alias("class_id"), F.col("ca").alias("check")).unionAll(pairs.select("b", "cb"))
    links = both.groupBy(*name).agg(F.count(F.lit(1)).alias("n_links"))
    sizes = members.groupBy(*name).agg(F.count(F.lit(1)).alias("n_copies"), F.min("record_key").alias("first_key"))
    return members.join(sizes, name).join(links, name, "left").select("record_key", F.col("first_key").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def tag_sets(clauses: DataFrame, products: DataFrame) -> DataFrame:
    """The tag sets of clauses and work products in one table; their keys never clash."""
    return record_sets(clauses, "clause_key", "tags").unionAll(record_sets(products, "wp_key", "tags_addressed"))
