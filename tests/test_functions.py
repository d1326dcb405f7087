import difflib

import pytest
from pyspark.sql import functions as F

from traceloom.functions import text as T
from traceloom.operators import discovery, sections


def one(spark, column, **values):
    kinds = {str: "string", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="The FTA of ab12 x9 isn't safe-state; ÉCU") == ["fta", "ab12", "isn", "safe", "state"]


@pytest.mark.parametrize("level, target, want", [("all", "B", True), ("A-C", "B", True), ("C-D", "B", False), ("ASIL B", "A", True), ("X-Y", "B", True), ("C", "B", False), ("", "B", True), ("D", None, True)])
def test_risk(spark, level, target, want):
    assert one(spark, T.risk_applies(F.col("l"), target, ["A", "B", "C", "D"]), l=level) is want


@pytest.mark.parametrize("tag, want", [("fta", True), ("abc", False), ("ABC", True), ("a", False), ("two  gaps", False), ("1 2", False), ("line\nbreak", False), ("safe state", True), (None, False)])
def test_concept(spark, tag, want):
    assert one(spark, T.is_concept(F.col("t")), t=tag) is want


def test_ratio_and_bounds(spark):
    pairs = [("abc" * 90, "abd" * 90), ("", ""), ("wiper motor", "motor wiper"), ("x", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.ratio("a", "b").alias("r"), T.ratio_bound(F.col("a"), F.col("b")).alias("u"), T.shared_bound(T.letter_counts(F.col("a")), T.letter_counts(F.col("b")), F.length("a"), F.length("b")).alias("s"))
    for r in df.collect():
        assert r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio()
        assert r.r <= r.s + 1e-9 <= r.u + 2e-9


def test_likeness_is_difflib():
    import random

    from traceloom.functions.likeness import Prepared, likeness

    rng = random.Random(5)
    for size, letters in ((30, "ab "), (150, "abcdefgh "), (500, "aaaabbbcc defghijklmnop"), (700, "the unit shall brake z")):
        for _ in range(60):
            a, b = ("".join(rng.choices(letters, k=rng.randint(0, size))) for _ in range(2))
            if rng.random() < 0.5:
                b = b[: len(b) // 2] + a[len(a) // 3 :]
            assert likeness(a, Prepared(b)) == difflib.SequenceMatcher(None, a, b).ratio(), (a, b)


def test_terms_are_bounded_as_written(spark):
    terms = ["hazard analysis", "fault tree", "fault tree analysis", "c++", "+x", "end-to-end", "fmea", ""]
    find = lambda t: one(spark, T.terms_in_text(F.col("t"), terms), t=t)
    assert find("Hazard. Analysis of a fault\n\ntree") == [] and find("HAZARD ANALYSIS: a fault tree analysis") == ["fault tree", "fault tree analysis", "hazard analysis"]
    assert find("c++ code") == [] and find("c++11") == ["c++"] and find("a+x b") == ["+x"] and find("an end-to-end test, xfmea, fmea_1, éfmea") == ["end-to-end"]
    assert find(None) is None and find("") == [] and one(spark, T.terms_in_text(F.col("t"), []), t="x") == []


def test_emphasised_acronyms(spark):
    tags = lambda t: one(spark, T.tags_in_text(F.col("t")), t=t)
    assert tags("a *can* bus, **fmea** and _spi_; CAN, SPI and __CPU__") == ["CAN", "FMEA", "SPI"]


def test_clause_texts(spark):
    assert [one(spark, T.clause_class(F.col("t")), t=t) for t in ("it shall", "it Should", "may be", "NOTE x", "shallow", "")] == ["requirement", "recommendation", "permission", "guideline", "overview", "overview"]
    assert one(spark, T.notes_in_text(F.col("t")), t="Body. NOTE 1 First  one\nEXAMPLE second") == ["First one", "second"]
    assert one(spark, T.level_in_text(F.col("t")), t="for ASIL B-D") == "B-D"
    assert one(spark, T.section_id(F.col("t")), t="**6.4.2** Technical") == "6.4.2"
    assert one(spark, T.clauses_in_text(F.col("t")), t="see clause 6.4.2 and ISO 26262-3 7.4, satisfies 5") == ["5", "6.4.2", "7.4"]
    assert one(spark, T.part_number(F.col("t"), F.col("f")), t="ISO 26262-4", f="x.md") == "4" and one(spark, T.part_number(F.col("t"), F.col("f")), t="", f="my_part_7.md") == "7"
    assert one(spark, T.tags_in_text(F.col("t")), t="FMEA and CPU in a safety review") == ["FMEA", "Review", "Safety"]
    a, b = T.traces_in_text(F.col("t"))
    assert one(spark, a, t="It is derived from Safety goals. Traced to WP-1, verified by a test") == ["Safety goals"]
    assert one(spark, b, t="It is derived from Safety goals. Traced to WP-1, verified by a test") == ["WP-1", "a test"]
    r = one(spark, T.references_in_text(F.col("t")), t="see Part 3, Clause 7.4.1; per annex")
    assert [(x.part, x.section) for x in r] == [("3", "")]  # the context ends at the first full stop


STANDARD = "# Part 4\nintro\n## 5 General\n\nThe item shall. NOTE A note\n### 5.1 Sub *part*\nIt may.\n## Foreword\nx\n"
LAYOUT = "\n".join([" " * 40 + "6  Specification of work", "  6.1 ....... 4", ""] + [" " * 35 + f"the text number {i} of the page" for i in range(12)] + ["All rights reserved", " " * 6 + "6.4.2  Technical things", "it shall hold", "12"])


def test_sections(spark):
    docs = spark.createDataFrame([(1, STANDARD), (2, LAYOUT), (3, None), (4, "")], "doc_id long, text string")
    s = sorted((r.doc_id, r.section_no, r.level, r.heading) for r in sections.sections(docs).collect())
    assert s == [(1, 1, 1, "Part 4"), (1, 2, 2, "5 General"), (1, 3, 3, "5.1 Sub *part*"), (1, 4, 2, "Foreword"), (2, 1, 2, "6 Specification of work"), (2, 2, 4, "6.4.2 Technical things")]
    c = {(r.doc_id, r.section): r for r in sections.clauses(docs).collect()}
    assert set(c) == {(1, "5"), (1, "5.1"), (2, "6"), (2, "6.4.2")}
    assert (c[1, "5"].type, c[1, "5"].notes, c[1, "5.1"].title, c[1, "5.1"].type) == ("requirement", ["A note"], "Sub part", "permission")


def test_discovery(spark):
    docs = spark.createDataFrame([(1, '{"clauses": [{"section": "1", "text": "a", "asil": "B"}, {"section": "2", "text": "b", "asil": "C"}]}'), (2, "broken"), (3, None)], "k long, p string")
    m = discovery.walk(docs, "k", "p")
    assert {r.role: r.name for r in discovery.field_roles(discovery.key_frequency(m, "k")).collect()} == {"id": "section", "text": "text", "risk": "asil"}
    assert discovery.leaf_text(m, "k").first().text == "1\na\nB\n2\nb\nC"


def test_best_ratio_and_containment_against_brute_force(spark):
    from traceloom.operators import similarity as S

    texts = ["the brake controller shall limit the signal", "a pump", "", "xyz " * 80, "limit the brake signal of the pump"]
    arts = ["brake limit signal", "the pump controller limits brakes", "", "zyx " * 90, "brake controller shall limit"]
    n = spark.createDataFrame([("S", i, t, t) for i, t in enumerate(texts)] + [("T", 9, "x", "alone")], "std string, node_ord long, text string, node_text string")
    a = spark.createDataFrame([("S", i, t) for i, t in enumerate(arts)], "std string, art_ord long, full_text string")
    got = {r.node_ord: r.ratio for r in S.best_ratio(n, a).collect()}
    assert got == {**{i: max(difflib.SequenceMatcher(None, t, b).ratio() for b in arts) for i, t in enumerate(texts)}, 9: 0.0}
    share = {r.node_ord: r.share for r in S.containment(n, a).collect()}
    words = [w for t in texts[:1] for w in ("brake", "controller", "limit", "signal")]
    assert share[0] == sum(any(w in x for x in arts) for w in words) / len(words) and share[9] == 0


def test_best_ratio_of_whole_texts(spark):
    from traceloom.operators import similarity as S

    rng = __import__("random").Random(17)
    words = "brake signal limit unit shall İ ß 😀 controller pump test of the".split()
    text = lambda k: " ".join(rng.choices(words, k=k))
    same = text(110)
    assert len(same) > 500
    # alike only after 500 characters, and alike only before
    texts = ["x" * 500 + same, same + "y" * 900, "", text(400), text(30), same]
    arts = ["z" * 500 + same, text(400) + same, same[:500] + "q" * 700, text(20), "", text(3000)]
    n = spark.createDataFrame([("S", i, t) for i, t in enumerate(texts)] + [("S", 8, texts[0]), ("T", 9, same), (None, 10, same)], "std string, node_ord long, text string")
    a = spark.createDataFrame([("S", i, t) for i, t in enumerate(arts)] + [(None, 7, same)], "std string, art_ord long, full_text string")
    low = lambda t: spark.createDataFrame([(t,)], "t string").selectExpr("lower(t)").first()[0]
    ratios = {i: max(difflib.SequenceMatcher(None, low(t), low(b)).ratio() for b in arts) for i, t in enumerate(texts)}
    wanted = ratios | {8: ratios[0], 9: 0.0, 10: 0.0}
    assert {r.node_ord: r.ratio for r in S.best_ratio(n, a).collect()} == wanted
    some = {r.node_ord: r.ratio for r in S.best_ratio(n, a, enough=0.5).collect()}
    assert some.keys() == wanted.keys() and all(some[k] == w if w < 0.5 else 0.5 <= some[k] <= w for k, w in wanted.items())


def test_ranked_pieces_of_long_texts():
    from traceloom.functions.likeness import Prepared, Ranked

    rng = __import__("random").Random(19)
    text = lambda k: "".join(rng.choices("abcdefgh stuvwxyz", k=k))
    others = [text(rng.choice([0, 3, 60, 250, 700])) for _ in range(30)]
    for piece in (1, 400, 10**6):
        ranked = Ranked([Prepared(b) for b in others], piece)
        assert sorted(p.text for part in ranked.parts for p in part) == sorted(others)
        assert all(len(part) == 1 or sum(len(p.text) for p in part) <= piece for part in ranked.parts)
        for a in ("", text(2), text(90), others[4] + text(300), text(1500)):
            best = max(difflib.SequenceMatcher(None, a, b).ratio() for b in others)
            assert ranked.best(a, -1.0, 2.0) == best and ranked.best(a, 1.5, 2.0) == 1.5
            some = ranked.best(a, -1.0, 0.3)
            assert some == best if best < 0.3 else 0.3 <= some <= best


def test_long_texts_make_more_blocks(spark):
    from traceloom.operators import similarity as S

    rows = lambda k, n: spark.createDataFrame([("s", f"{i} " + "x" * n) for i in range(k)], f"std string, {'a' if n else 'b'} string")
    sizes = S.blocked(rows(8, S.LETTERS), rows(3, 0), "std", lambda x, y: __import__("pyarrow").table({"rows": [x.num_rows], "pairs": [x.num_rows * y.num_rows]}), "rows long, pairs long").collect()
    assert sum(r.pairs for r in sizes) == 24 and max(r.rows for r in sizes) < 8


def test_bounds_of_likeness():
    from difflib import SequenceMatcher

    from traceloom.functions.likeness import Bounds, Prepared

    rng = __import__("random").Random(13)
    for letters in ("ab", "abcdefé", "abcdefghijklmnopqrstuvwxyz eeeaaa", "ab\0😀"):
        for _ in range(12):
            text = lambda: "".join(rng.choices(letters, k=rng.choice([0, 1, 40, 199, 200, 330, 500])))
            others = [text() for _ in range(5)]
            for a in (text(), others[0][:120] + text()[:80] + others[1][5:90], ""):
                most = Bounds([Prepared(b) for b in others]).of(a)
                assert all(m >= SequenceMatcher(None, a, b).ratio() for m, b in zip(most, others))
    # a short text in another order, a long one whose rare characters are not in the other
    assert list(Bounds([Prepared("abcd"), Prepared("e " * 100 + "xyz")]).of("dcba" + " e" * 10)) == [2 * 1 / 28, 0.0]
