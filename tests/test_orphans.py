from datetime import datetime as D

from traceloom.operators import orphans

CLAUSE = "clause_key long, standard_id string, part string, section string, cross_references array<string>, loaded_at timestamp_ntz, deleted_at timestamp_ntz, block string, n int, reason string"
PRODUCT = "wp_key long, id string, standard_id string, mapped_part string, mapped_sections array<string>, traceability_links array<struct<`from`:string,`to`:string,type:string>>, loaded_at timestamp_ntz, deleted_at timestamp_ntz, pos int"
T1, T2, T3 = D(2024, 1, 5), D(2024, 2, 5), D(2024, 3, 5)


def clause(key, part, section, refs=None, loaded=T1, deleted=None):
    return (key, "S", part, section, refs, loaded, deleted, "b", 1, "r")


def product(key, ident, part="3", sections=None, links=None, loaded=T2, deleted=None):
    return (key, ident, "S", part, sections, links, loaded, deleted, 1)


def found(spark, part_3, part_4, products):
    df = orphans.orphan_references(spark.createDataFrame(part_3, CLAUSE), spark.createDataFrame(part_4, CLAUSE), spark.createDataFrame(products, PRODUCT))
    return sorted((r.field_name[:5], r.source_key, r.pos, r.reason, r.load_month) for r in df.collect())


def test_cross_references(spark):
    p3 = [
        clause(1, "3", "5.1", ["5.2", None, "part_4:7.1", "Part 4: 7.2", "part_9:1.1", "tbd", "5", "", "§ 5.9", " clause 5.1.1. ", "5.1"]),
        clause(1, "3", "5.1", ["5.2", None, "part_4:7.1", "Part 4: 7.2", "part_9:1.1", "tbd", "5", "", "§ 5.9", " clause 5.1.1. ", "5.1"], loaded=T3),
        clause(2, "3", "5.2", deleted=T3), clause(3, "3", "5.10"), clause(4, "3", "5.1.1", loaded=T2),
    ]
    p4 = [clause(9, "4", "7.1")]
    assert found(spark, p3, p4, []) == [("cross", 1, 1, "deleted", "2024-01"), ("cross", 1, 4, "missing", "2024-01"), ("cross", 1, 9, "missing", "2024-01"), ("cross", 1, 10, "late", "2024-01")]


def test_sections_and_links(spark):
    link = lambda to: (None, to, None)
    wps = [
        product(10, "WP-0000000007", sections=["5.1", "all", "6.6", None], links=[link("wp 8"), link("SWP-9 export"), None, link("[WP-0000000007]"), link("whole"), link(None), link("WP_99 rev C")]),
        product(11, "WP-0000000008", part=None, sections=["9.9"], loaded=T3),
    ]
    assert found(spark, [clause(1, "3", "5.1", loaded=T3)], [], wps) == [("mappe", 10, 1, "late", "2024-02"), ("mappe", 10, 3, "missing", "2024-02"), ("trace", 10, 1, "late", "2024-02"), ("trace", 10, 7, "missing", "2024-02")]


def test_runs_are_compressed(spark):
    p = spark.createDataFrame([("x", n, T1, False) for n in (1, 2, 3, 5, 6, 9, 3)], "block string, n long, loaded timestamp_ntz, deleted boolean")
    runs = sorted((r.run_start, r.run_end, len(r.loaded)) for r in orphans.compress_runs(p).collect())
    assert runs == [(1, 3, 3), (5, 6, 2), (9, 9, 1)]


def test_numbers_beyond_64_bits(spark):
    long = "9" * 20
    p3 = [clause(1, "3", "5.1", [f"5.{long}", f"{long}.1", "5.1"]), clause(2, "3", f"5.{long}"), clause(3, "3", "6.1")]
    wps = [product(10, f"WP-{long}", links=[(None, f"WP-{long}", None)])]
    assert found(spark, p3, [], wps) == [("cross", 1, 1, "missing", "2024-01"), ("cross", 1, 2, "missing", "2024-01"), ("trace", 10, 1, "missing", "2024-02")]


def test_empty(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [clause(1, "3", "5.1", ["7.7"])], [], []) == [("cross", 1, 1, "missing", "2024-01")]


def test_one_target_holds_most_references(spark):
    wps = [product(k, f"WP-{k:010d}", links=[(None, "WP-1", None)] * 2 + [(None, f"WP-{10**9 + k}", None)]) for k in range(1, 400)]
    got = found(spark, [], [], wps)
    assert len(got) == 399 and {g[3] for g in got} == {"missing"}
