from collections import Counter
from datetime import datetime as D

import pytest

from traceloom.llm import frequency as Q

CLAUSE = "clause_key long, tags array<string>, asil_level string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, field_name string, term int"
PRODUCT = "wp_key long, methods_used array<string>, loaded_at timestamp_ntz, deleted_at timestamp_ntz, n_records int"
T1, T2 = D(2024, 1, 1), D(2025, 6, 1)


def frames(spark, clauses, products=()):
    return spark.createDataFrame([(k, t, a, at, d, "f", 1) for k, t, a, at, d in clauses], CLAUSE), spark.createDataFrame([(k, m, at, d, 1) for k, m, at, d in products], PRODUCT)


def rows(df):
    return {(r.field_name, r.term): (r.n_occurrences, r.n_records, r.mark) for r in df.collect()}


def test_folding_repeats_nulls_and_marks(spark):
    c, p = frames(spark, [(1, ["A  b", "a b", None, " "], "B", T1, None), (2, ["a  B "], "b", T1, None), (3, None, None, T1, None), (4, [], " ", T1, None), (5, ["x"], "c", T1, None)], [(9, ["m"], T1, None)])
    got = rows(Q.term_counts(c, p))
    assert got == {("tags", "a b"): (3, 2, "rare"), ("tags", "x"): (1, 1, "rare"), ("asil_level", "b"): (2, 2, "rare"), ("asil_level", "c"): (1, 1, "rare"), ("methods_used", "m"): (1, 1, "rare")}


def test_common_is_above_a_fifth(spark):
    c, p = frames(spark, [(k, ["a"] if k <= 3 else ["b"] if k <= 7 else [f"u{k}"], None, T1, None) for k in range(1, 16)])
    got = rows(Q.term_counts(c, p))
    assert got["tags", "a"] == (3, 3, None) and got["tags", "b"] == (4, 4, "common")  # 3 of 15 is a fifth, not more


def test_delivered_twice(spark):
    c, p = frames(spark, [(1, ["new"], None, T2, None), (1, ["old"], None, T1, None)])
    assert set(rows(Q.term_counts(c, p))) == {("tags", "old")}


def test_empty(spark):
    assert rows(Q.term_counts(*frames(spark, []))) == {}


def test_signed_deltas_merge_to_a_recount(spark):
    schema = "field_name string, record_key long, before array<string>, after array<string>"
    first = spark.createDataFrame([("f", 1, None, ["a", "b", "b"]), ("f", 2, None, ["a"]), ("f", 3, None, ["c"])], schema)
    then = spark.createDataFrame([("f", 1, ["a", "b", "b"], ["a", "b"]), ("f", 3, ["c"], None), ("f", 4, None, ["A", "d"])], schema)
    store = Q.TermCounts(spark)
    store.apply(first)
    got = {r.term: (r.n_occurrences, r.n_records) for r in store.apply(then).collect()}
    assert got == {None: (0, 3), "a": (3, 3), "b": (1, 1), "d": (1, 1)}
    changed = Q.changed(first.select("field_name", "record_key", "after"), spark.createDataFrame([("f", 1, ["a", "b", "b"]), ("f", 2, ["z"])], "field_name string, record_key long, after array<string>"))
    assert sorted(r.record_key for r in changed.collect()) == [2, 3]


def test_batches_equal_one_count(spark):
    c, p = frames(spark, [(1, ["a"], "A", T1, None), (2, ["a", "b"], "B", T1, T2), (3, ["b"], "A", T2, None), (4, ["q"], "D", T2, T2)], [(7, ["m", "m"], T1, T2), (8, ["m"], T2, None)])
    live_c, live_p = c.filter("deleted_at is null"), p.filter("deleted_at is null")
    assert rows(Q.live_term_counts(c, p, "2025-01-01")) == rows(Q.term_counts(live_c, live_p))


def test_one_term_in_most_records(spark):
    c, p = frames(spark, [(k, ["hot", f"t{k % 7}"], None, T1, None) for k in range(3000)])
    got = rows(Q.term_counts(c, p))
    want = Counter(f"t{k % 7}" for k in range(3000))
    assert got["tags", "hot"] == (3000, 3000, "common") and all(got["tags", t][1] == n for t, n in want.items())


CHANGES = "field_name string, record_key long, before array<string>, after array<string>"


def totals(df):
    return {r.term: r.n_records for r in df.collect()}


def test_first_batch_is_kept(spark):
    c, p = frames(spark, [(1, ["a"], None, T1, None), (2, ["a", "b"], None, T1, None)])
    store = Q.TermCounts(spark)
    Q.term_counts(c, p, store)
    more = spark.createDataFrame([("tags", 2, ["a", "b"], None), ("tags", 3, None, ["a"])], CHANGES)
    assert store.state()["version"] == 1 and totals(store.apply(more)) == {None: 2, "a": 2}


def test_counts_survive_a_restart(spark, tmp_path):
    c, p = frames(spark, [(k, ["a", f"t{k}"], None, T1, None) for k in range(40)])
    Q.term_counts(c, p, Q.TermCounts(spark, str(tmp_path / "counts")))
    again = Q.TermCounts(spark, str(tmp_path / "counts"))
    assert again.state()["version"] == 1 and totals(again.read())["a"] == 40
    # the same records again: no change, all buckets stay where they are
    before = again.state()["buckets"]
    assert rows(Q.term_counts(c, p, Q.TermCounts(spark, str(tmp_path / "counts"))))["tags", "a"] == (40, 40, "common")
    assert again.state()["version"] == 2 and again.state()["buckets"] == before
    # one record changed, one gone, one new
    c2, p2 = frames(spark, [(0, ["a", "new"], None, T1, None)] + [(k, ["a", f"t{k}"], None, T1, None) for k in range(2, 41)])
    assert rows(Q.term_counts(c2, p2, Q.TermCounts(spark, str(tmp_path / "counts")))) == rows(Q.term_counts(c2, p2))


def test_a_batch_touches_only_its_buckets(spark, tmp_path):
    store = Q.TermCounts(spark, str(tmp_path / "counts"))
    store.apply(spark.createDataFrame([("f", k, None, [f"t{k}"]) for k in range(200)], CHANGES))
    assert set(store.state()["buckets"].values()) == {1}
    store.apply(spark.createDataFrame([("f", 7, ["t7"], ["t8"])], CHANGES))
    versions = list(store.state()["buckets"].values())
    assert 1 <= versions.count(2) <= 2 and versions.count(1) >= len(versions) - 2
    got = totals(store.read())
    assert got[None] == 200 and got["t8"] == 2 and "t7" not in got and len(got) == 200
    store.vacuum()
    assert totals(Q.TermCounts(spark, str(tmp_path / "counts")).read()) == got


def test_unpublished_batch_and_second_writer(spark, tmp_path):
    store = Q.TermCounts(spark, str(tmp_path / "counts"))
    store.apply(spark.createDataFrame([("f", 1, None, ["a"])], CHANGES))
    (tmp_path / "counts" / "data" / "v=2" / "bucket=0").mkdir(parents=True)
    (tmp_path / "counts" / "data" / "v=2" / "bucket=0" / "cut-off.parquet").write_bytes(b"half")
    assert totals(store.read()) == {None: 1, "a": 1}
    assert totals(store.apply(spark.createDataFrame([("f", 2, None, ["a"])], CHANGES))) == {None: 2, "a": 2}
    with pytest.raises(RuntimeError):
        store._publish(store.state())
    assert totals(store.apply(spark.createDataFrame([("f", 1, ["a"], None), ("f", 2, ["a"], None)], CHANGES))) == {}
    assert totals(store.apply(spark.createDataFrame([], CHANGES))) == {}
