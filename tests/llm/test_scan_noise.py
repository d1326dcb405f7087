from datetime import datetime as D

from traceloom.llm import scan_noise as Q

T1, T2 = D(2024, 1, 1), D(2024, 2, 1)
CLAUSE = "clause_key long, volume string, text string, notes array<string>, loaded_at timestamp_ntz, defect string, line int"
CLEAN = [
    "The pedal controller shall confirm the stored calibration of the backup line within the next cycle.",
    "Hardware- and software-related measures include end-to-end protection and safety-related elements of the vehicle.",
    "The review board shall limit a short circuit towards ground before the vehicle is moving.",
    "If the sensor cannot detect the signal, the driver shall announce a corrupted configuration record.",
]


def run(spark, scanned, clean=CLEAN):
    rows = [(k, None, t, None, T1, "d", 1) for k, t in enumerate(clean * 3, 1000)]
    rows += [(k, v, t, n, T1, "d", 1) for k, v, t, n in scanned]
    got = Q.repaired(spark.createDataFrame(rows, CLAUSE)).collect()
    return {(r.clause_key, r.field_name, r.item_pos): (sorted(r.defects), r.text) for r in got}


def test_each_defect(spark):
    got = run(spark, [
        (1, "V", "The pedal controller shall con-\nfirm the stored calibration of the\n- 17 -\nbackup line within the next cycle.", ["fine", None, "The review board shall 1imit a short\ncircuit t0wards ground."]),
        (2, "V", "BRAKE CONCEPT PHASE   18\nThe review board shall limit a short\ncircuit towards ground.", None),
        (3, "V", "BRAKE C0NCEPT PHASE   19\nIf the sensor cannot detect the sig­nal, the driver shall\nannounce a corrupted configuгation record.", None),
        (4, "V", "Hardware- and\nsoftware-related measures include end-\nto-end protection.", None),
        (5, "V", "If the sen- sor cannot detect the signal, the dri¬\n[20]\nver shall announce a corrupted record (SG_60l, B35O).", None),
    ])
    assert got[1, "text", 0] == (["broken_word", "page_number"], "The pedal controller shall confirm the stored calibration of the backup line within the next cycle.")
    assert got[1, "notes", 1][0] == [] and got[1, "notes", 3] == (["misread"], "The review board shall limit a short circuit towards ground.")
    assert got[2, "text", 0] == (["running_header"], "The review board shall limit a short circuit towards ground.")
    assert got[3, "text", 0] == (["broken_word", "misread", "running_header"], "If the sensor cannot detect the signal, the driver shall announce a corrupted configuration record.")
    assert got[4, "text", 0] == ([], "Hardware- and software-related measures include end- to-end protection.")
    assert got[5, "text", 0] == (["broken_word", "page_number"], "If the sensor cannot detect the signal, the driver shall announce a corrupted record (SG_60l, B35O).")


def test_edges(spark):
    got = run(spark, [(1, "V", None, None), (2, "V", "", []), (3, "V", " \n ", ["- 3 -"]), (4, "V", "The vehicle is moving. " * 4000, None)])
    assert got[2, "text", 0] == ([], "") and got[3, "notes", 1] == (["page_number"], "") and got[4, "text", 0][0] == []
    assert (1, "text", 0) not in got and all(k < 1000 for k, _, _ in got)
    assert run(spark, [], clean=[]) == {}


def test_no_unscanned_texts(spark):
    got = run(spark, [(k, "V", "the driver shall limit the signal\nof the vehicle", None) for k in range(1, 30)] + [(50, "V", "the driver shall 1imit the signal", None)], clean=[])
    assert got[50, "text", 0] == (["misread"], "the driver shall limit the signal") and got[1, "text", 0][0] == []


def test_delivered_twice(spark):
    rows = [(1, "V", "the vehicle\n- 9 -", None, T2, "d", 1), (1, "V", "the vehicle", None, T1, "d", 1)]
    assert [r.defects for r in Q.repaired(spark.createDataFrame(rows, CLAUSE)).collect()] == [[]]


def test_pieces():
    for wrong, right in (("1imit", "limit"), ("si9na1", "signal"), ("momtor", "monitor"), ("corriipted", "corrupted"), ("withholcl", "withhold"), ("rnodule", "module")):
        assert Q.strokes(wrong) == Q.strokes(right) and Q.glyph_edits(wrong, right) in (1, 2)
    assert all(Q.strokes(a) == Q.strokes(b) for a, b in Q.GLYPHS)
    assert Q.glyph_edits("same", "same") == 0 and Q.glyph_edits("abc", "abd") is None and Q.glyph_edits("t0ta1t", "fofalf") is None
    assert [x for x in ("— 52 —", "[49]", "p. 7", "Page 12", "75 of 285", "   56", "41 ms", "S1, E2", "1. x", "") if Q.is_page_number(x)] == ["— 52 —", "[49]", "p. 7", "Page 12", "75 of 285", "   56"]
    assert Q.head_key("BRAKE C0NCEPT  PHASE 7") == Q.head_key("BRAKE CONCEPT PHASE 12")


def test_strokes_as_expression(spark):
    words = ["".join(c) for c in zip("rnodule1г!", "clwvvmf9éﬁ", "hbun68d0|ﬂ")] + ["", "module"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", Q.stroke_column(df.w).alias("s")).collect()} == {w: Q.strokes(w) for w in words}


def test_context_decides_between_readings(spark):
    # 'hcar' is 'hear' or, by the strokes of h and b, 'bear': only the neighbours tell
    clean = ["The operator shall hear the loud warning tone in the cabin.", "The main frame shall bear the heavy axle load of the trailer."] * 6
    got = run(spark, [(1, "V", "The operator shall hcar the loud warning tone.", None), (2, "V", "The main frame shall hcar the heavy axle load.", None)], clean)
    assert got[1, "text", 0] == (["misread"], "The operator shall hear the loud warning tone.")
    assert got[2, "text", 0] == (["misread"], "The main frame shall bear the heavy axle load.")


def test_real_word_in_the_wrong_place(spark):
    clean = ["The driver shall clear the fault memory of the unit."] * 40 + ["My dear friend of the old house."] * 2
    got = run(spark, [(1, "V", "The driver shall dear the fault memory of the unit.", None), (2, "V", "My dear friend of the old house.", None)], clean)
    assert got[1, "text", 0] == (["misread"], "The driver shall clear the fault memory of the unit.") and got[2, "text", 0][0] == []


def test_long_words_and_far_halves(spark):
    long = "".join(f"part{c}" for c in "abcdefghijklmnopqrst")
    clean = [f"The {long} shall limit the signal.", *CLEAN]
    far = "The pedal controller shall con-\n\n\n\n- 17 -\n\n\nBRAKE CONCEPT PHASE   18\n\n\n\nfirm the stored calibration of the backup line."
    got = run(spark, [(1, "V", f"The {long.replace('m', 'rn', 1).replace('g', '9')} shall limit the signal.", None), (2, "V", far, None)], clean)
    assert got[1, "text", 0] == (["misread"], f"The {long} shall limit the signal.")
    assert got[2, "text", 0] == (["broken_word", "page_number", "running_header"], "The pedal controller shall confirm the stored calibration of the backup line.")
