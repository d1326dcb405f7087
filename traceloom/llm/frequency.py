"""Occurrences and records of every distinct value, kept by incremental signed deltas.

A batch of changes holds, for each changed record, its values before and after (null before:
added, null after: deleted). Only these records are aggregated: values before count -1, values
after +1, and what cancels out vanishes. The deltas are merged into persistent counts that are
partitioned by a hash of the term. A batch rewrites the buckets that its deltas touch, and no
others; a small list of the buckets' versions, written last and under a new name, makes it visible
at once or not at all. Whoever opens the folder finds the newest list there, after a restart too.
Where no changes are given but a new state of the records, they are found by comparing it with the
stored one (``sync``), and only records that differ are aggregated.

The total of records with a value is kept among the counts, under a null term, so that the share
of a term is always taken of the same state.

Defined results
* null arrays and null or blank elements: no value; a record without a value doesn't count;
* a value repeated in a record: several occurrences, one record;
* spellings that differ in case or white space (no-break spaces too) are one term;
* a record delivered twice counts once, as delivered first;
* a batch without changes, or whose changes cancel out: the counts stay as they are;
* a batch cut off before its list is written: as if it had never begun, its files are written anew;
* one writer at a time: a list that is there already isn't overwritten, the later writer fails;
* empty tables: no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.common import folded_values, once
from traceloom.session import file_system, scratch_path

#: A term in fewer records is too rare.
RARE_BELOW = 3
#: A term in more than this share of the records with a value is too common.
COMMON_ABOVE = 0.2
#: Buckets of new counts (those of stored ones are kept with them).
BUCKETS = 16
RECORDS = "field_name string, record_key bigint, after array<string>"
COUNTS = "field_name string, term string, n_occurrences bigint, n_records bigint"


def added(records: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Records as changes, one row for each field: (field_name, record_key, before, after), nothing before."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("field_name"), values.alias("after")) for name, values in fields.items()])).alias("x")
    return records.select(F.col(key).alias("record_key"), each).select("x.field_name", "record_key", F.lit(None).cast("array<string>").alias("before"), "x.after")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two states (record_key, field_name, after): only records that differ."""
    o = old.select("field_name", "record_key", F.col("after").alias("before"))
    both = o.join(new.select("field_name", "record_key", "after"), ["field_name", "record_key"], "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def term_deltas(changes: DataFrame) -> DataFrame:
    """(field_name, term, n_occurrences, n_records) to add to the counts; a null term: records with a value."""
    # row by row: each value is an occurrence, each distinct one a record, and the record itself is
    # one for the null term; only sums of whole batches are shuffled
    def side(column: str, sign: int) -> Column:
        values = F.coalesce(folded_values(F.col(column)), F.array().cast("array<string>"))
        row = lambda term, o, r: F.struct(term.alias("term"), F.lit(o * sign).cast("bigint").alias("o"), F.lit(r * sign).cast("bigint").alias("r"))
        some = F.when(F.size(values) > 0, F.array(row(F.lit(None).cast("string"), 0, 1))).otherwise(F.array().cast("array<struct<term:string,o:bigint,r:bigint>>"))
        return F.concat(F.transform(values, lambda v: row(v, 1, 0)), F.transform(F.array_distinct(values), lambda v: row(v, 0, 1)), some)

    both = changes.select("field_name", F.explode(F.concat(side("after", 1), side("before", -1))).alias("x")).select("field_name", "x.*")
    d = both.groupBy("field_name", "term").agg(F.sum("o").alias("n_occurrences"), F.sum("r").alias("n_records"))
    return d.filter((F.col("n_occurrences") != 0) | (F.col("n_records") != 0))


def merge_counts(counts: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """Counts after the deltas; terms that no record holds any more are gone."""
    if counts is None:
        merged = deltas
    else:
        merged = counts.select("field_name", "term", "n_occurrences", "n_records").unionByName(deltas).groupBy("field_name", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
    return merged.filter(F.col("n_records") > 0)


class TermCounts:
    """Persistent counts in a folder: data/v=N/bucket=K, lists/N.json, and the records of ``sync``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, (path or scratch_path(spark, "term-counts")).rstrip("/")
        self.new = {"version": 0, "n": buckets, "buckets": {}, "records": 0}

    def _names(self, folder: str) -> list[str]:
        fs, p = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def state(self) -> dict:
        """The newest list: the version and, for each bucket, the version that its rows are in."""
        versions = [int(n[:-5]) for n in self._names("lists") if n.endswith(".json")]
        if not versions:
            return self.new
        return json.loads(self.spark.read.text(f"{self.path}/lists/{max(versions)}.json", wholetext=True).first()[0])

    def _publish(self, state: dict) -> None:
        name = f"{self.path}/lists/{state['version']}.json"
        fs, final = file_system(self.spark, name)
        _, draft = file_system(self.spark, f"{self.path}/drafts/{state['version']}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer has published {name}")

    def _rows(self, state: dict, buckets: list[str]) -> DataFrame | None:
        paths = [f"{self.path}/data/v={state['buckets'][b]}/bucket={b}" for b in buckets if b in state["buckets"]]
        return self.spark.read.schema(COUNTS).parquet(*paths) if paths else None

    def read(self) -> DataFrame:
        """The counts as last published."""
        state = self.state()
        rows = self._rows(state, list(state["buckets"]))
        return self.spark.createDataFrame([], COUNTS) if rows is None else rows

    def apply(self, changes: DataFrame, records: int | None = None) -> DataFrame:
        """Merge a batch of changes into the buckets it touches; the counts after it."""
        state = self.state()
        version = state["version"] + 1
        data = f"{self.path}/data/v={version}"
        bucket = F.pmod(F.xxhash64("field_name", "term"), F.lit(state["n"])).cast("int")
        deltas = term_deltas(changes)
        if state["buckets"]:
            deltas.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/deltas")
            touched = self._buckets("deltas")
            deltas = self.spark.read.schema(COUNTS + ", bucket int").parquet(f"{self.path}/deltas").drop("bucket")
            if touched:
                merge_counts(self._rows(state, touched), deltas).withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(data)
        else:
            merge_counts(None, deltas).withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(data)
            touched = []
        written = self._buckets(f"data/v={version}")
        kept = {b: v for b, v in state["buckets"].items() if b not in touched}
        self._publish({**state, "version": version, "buckets": kept | dict.fromkeys(written, version), "records": records or state["records"]})
        return self.read()

    def _buckets(self, folder: str) -> list[str]:
        return [n.removeprefix("bucket=") for n in self._names(folder) if n.startswith("bucket=")]

    def sync(self, new: DataFrame) -> DataFrame:
        """Merge the changes between the stored records and a new state of them (``added`` rows)."""
        state = self.state()
        after = new.select("field_name", F.col("record_key").cast("bigint").alias("record_key"), F.col("after").cast("array<string>").alias("after"))
        version = state["version"] + 1
        after.write.mode("overwrite").parquet(path := f"{self.path}/records/v={version}")
        after = self.spark.read.schema(RECORDS).parquet(path)
        if state["records"]:
            before = self.spark.read.schema(RECORDS).parquet(f"{self.path}/records/v={state['records']}")
        else:
            before = self.spark.createDataFrame([], RECORDS)
        return self.apply(changed(before, after), version)

    def vacuum(self) -> None:
        """Delete what the newest list doesn't name."""
        state = self.state()
        named = {f"v={v}" for v in state["buckets"].values()}
        for folder, keep in (("data", named), ("records", {f"v={state['records']}"}), ("lists", {f"{state['version']}.json"})):
            for name in self._names(folder):
                if name not in keep:
                    fs, p = file_system(self.spark, f"{self.path}/{folder}/{name}")
                    fs.delete(p, True)


def mark_terms(counts: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """Counts of terms with ``mark``: 'rare', 'common' or null. The totals are one row for each field."""
    totals = counts.filter(F.col("term").isNull()).select("field_name", F.col("n_records").alias("n_total"))
    terms = counts.filter(F.col("term").isNotNull()).join(F.broadcast(totals), "field_name")
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_above * F.col("n_total"), "common")
    return terms.select("field_name", "term", "n_occurrences", "n_records", mark.alias("mark"))


def field_values(clauses: DataFrame, products: DataFrame) -> DataFrame:
    """The values of the three counted fields of deduplicated records, as added ones."""
    c = added(clauses, "clause_key", {"tags": F.col("tags"), "asil_level": F.array("asil_level")})
    return c.unionAll(added(products, "wp_key", {"methods_used": F.col("methods_used")}))


def term_counts(clauses: DataFrame, products: DataFrame, counts: TermCounts | None = None) -> DataFrame:
    """Counts and marks of every term. With persistent counts given, only records that differ from
    the stored ones are aggregated; without, all are added to empty counts in one batch."""
    state = field_values(once(clauses, "clause_key", "tags", "asil_level"), once(products, "wp_key", "methods_used"))
    return mark_terms(counts.sync(state) if counts else TermCounts(clauses.sparkSession).apply(state))


def live_term_counts(clauses: DataFrame, products: DataFrame, cut: str, counts: TermCounts | None = None) -> DataFrame:
    """Counts of live records, in two batches: the state at ``cut``, then today's, of which only the
    changes since are aggregated: records added, and records deleted."""
    c, p = (once(df, key, *columns, "loaded_at", "deleted_at") for df, key, columns in ((clauses, "clause_key", ("tags", "asil_level")), (products, "wp_key", ("methods_used",))))
    at = F.lit(cut).cast("timestamp_ntz")
    then = (F.col("loaded_at") < at) & F.coalesce(F.col("deleted_at") >= at, F.lit(True))
    counts = counts or TermCounts(clauses.sparkSession)
    counts.sync(field_values(c.filter(then), p.filter(then)))
    now = F.col("deleted_at").isNull()
    return mark_terms(counts.sync(field_values(c.filter(now), p.filter(now))))
