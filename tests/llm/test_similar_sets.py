import itertools
import random
from datetime import datetime as D

from traceloom.llm import similar_sets as Q

CLAUSE = "clause_key long, tags array<string>, loaded_at timestamp_ntz, record_key int, items string"
PRODUCT = "wp_key long, tags_addressed array<string>, loaded_at timestamp_ntz, band int"
T = D(2024, 1, 1)


def pairs(spark, clauses, products=()):
    c = spark.createDataFrame([(*(r if len(r) == 3 else (*r, T)), 1, "i") for r in clauses], CLAUSE)
    p = spark.createDataFrame([(*(r if len(r) == 3 else (*r, T)), 1) for r in products], PRODUCT)
    return [tuple(r) for r in Q.similar_records(Q.tag_sets(c, p)).collect()], c, p


def test_small_cases(spark):
    a = list("abcde")
    got, _, _ = pairs(spark, [(1, a), (2, ["A ", "b", "c", "d", "e", "E ", None, " "]), (3, list("abcd")), (4, list("abc")), (5, None), (6, list("abcdx")), (7, list("abxyz"))], [(20, list("abcdf"))])
    # {a..e} against {a..d}: 4/5; against {a..d,x}: 4/6; {a,b,c} is too small
    assert sorted(got) == [(1, 2), (1, 3), (1, 6), (1, 20), (2, 3), (2, 6), (2, 20), (3, 6), (3, 20), (6, 20)]


def test_threshold_is_exact(spark):
    twenty = [f"t{i}" for i in range(20)]
    got, _, _ = pairs(spark, [(1, twenty), (2, twenty[:13]), (3, twenty[:12])])
    assert sorted(got) == [(1, 2), (2, 3)]  # 13/20 is enough, 12/20 isn't


def test_against_brute_force(spark):
    rng = random.Random(5)
    sets = {}
    for k in range(1, 500):
        base = set(rng.sample(range(40), rng.randint(3, 9))) if k % 3 or k < 4 else set(sets[rng.randrange(1, k)]) ^ {rng.randrange(40)}
        sets[k] = base
    got, _, _ = pairs(spark, [(k, [f"v{x}" for x in s]) for k, s in sets.items() if k % 2], [(1000 + k, [f"V{x} " for x in s]) for k, s in sets.items() if not k % 2])
    name = {k if k % 2 else 1000 + k: s for k, s in sets.items()}
    want = {tuple(sorted((a, b))) for a, b in itertools.combinations(name, 2) if min(len(name[a]), len(name[b])) >= 4 and 100 * len(name[a] & name[b]) >= 65 * len(name[a] | name[b])}
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.995 * len(want)
    c, p = (spark.createDataFrame([(k, [f"v{x}" for x in s], T) for k, s in name.items() if (k < 1000) == first], f"{key} long, {field} array<string>, loaded_at timestamp_ntz") for first, key, field in ((True, "clause_key", "tags"), (False, "wp_key", "tags_addressed")))
    assert {tuple(r) for r in Q.similar_records(Q.tag_sets(c, p), exact=True).collect()} == want


def test_delivered_twice_counts_first(spark):
    got, _, _ = pairs(spark, [(1, list("wxyz"), D(2025, 1, 1)), (1, list("abcd"), T), (2, list("abcd")), (3, list("wxyz"))])
    assert got == [(1, 2)]


def test_copies_and_links(spark):
    _, c, p = pairs(spark, [(k, list("abcde")) for k in range(1, 41)] + [(50, list("abcdf")), (60, list("qrstu"))])
    links = {r.record_key: (r.n_copies, r.n_links) for r in Q.linked_records(Q.tag_sets(c, p)).collect()}
    assert links[1] == (40, 1) and links[50] == (1, 1) and links[60] == (1, 0) and len({r.class_id for r in Q.linked_records(Q.tag_sets(c, p)).collect()}) == 3


def test_empty_and_long(spark):
    assert pairs(spark, [])[0] == []
    long = [f"t{i}" for i in range(5000)]
    assert pairs(spark, [(1, long), (2, long[:4000]), (3, ["x" * 100_000, "b", "c", "d"])])[0] == [(1, 2)]
