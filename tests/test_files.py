"""From files to a report, over a small standard of our own."""

import json

import pytest

from traceloom import cli
from traceloom.operators import layers as L
from traceloom.plans import files
from traceloom.sources import readers, sinks

GLOSSARY = {"glossary": [{"term": "pump", "definition": "moves oil", "source": "x"}, {"term": "valve", "definition": "stops oil", "source": "x"}]}
PART_3 = {
    "part": "3", "title": "Oil loop",
    "clauses": [
        {"section": "5.1", "title": "Pump plan", "type": "requirement", "text": "The pump plan shall be written.", "tags": ["pump planning"], "asil_level": "all", "notes": ["keep it"], "cross_references": [{"part": "3", "section": "6.1", "context": "c"}, "5.9"]},
        {"section": "6.1", "title": "Valve test", "type": "requirement", "text": "Each valve shall be tested.", "tags": ["valve test"], "asil_level": "B", "notes": [], "cross_references": []},
        {"section": "7.1", "title": "Strict", "type": "requirement", "text": "Only at the highest level.", "tags": [], "asil_level": "C-D", "cross_references": []},
        {"section": "8.1", "title": "Hint", "type": "informative", "text": "It helps to label hoses.", "tags": [], "asil_level": "all", "cross_references": []},
    ],
    "methods": [{"activity": "test", "methods": [{"method": "leak check", "ASIL": ["A", "B"]}, {"name": "burst check", "ASIL": ["D"]}, {"method": "zzz qqq", "level": "all"}]}],
    "traceability_model": {"mapping": [{"from": "pump plan", "to": "test report"}, {"from": "hose", "to": "label"}]},
}
ARTIFACTS = {
    "project": {"target_asil": "B", "parts_in_scope": ["3"]},
    "work_products": [
        {"id": "W1", "title": "Pump plan", "status": "approved", "content": "The pump plan for pump planning.", "mapped_sections": ["5.1"], "methods_used": ["Leak chek"], "traceability_links": [{"from": "Pump plan", "to": "Test report", "type": "verifies"}]},
        {"id": "W2", "title": "Hose list", "status": "draft", "content": "", "mapped_sections": []},
    ],
}


@pytest.fixture
def standard(tmp_path):
    (tmp_path / "s").mkdir()
    for name, data in {"a_glossary.json": GLOSSARY, "part_3.json": PART_3, "compliance_report_old.json": {"part": "9", "clauses": [{"section": "1"}]}}.items():
        (tmp_path / "s" / name).write_text(json.dumps(data))
    (tmp_path / "w.json").write_text(json.dumps(ARTIFACTS))
    return tmp_path


def test_json_standard(spark, standard):
    m = files.FileModel(spark, str(standard / "s"), str(standard / "w.json"))
    f = m.fields
    assert (f.id, f.title, f.type, f.risk, f.tag, f.notes, f.methods, f.references) == ("section", "title", "type", "asil_level", "tags", "notes", ["methods"], ["cross_references"])
    assert (m.target, m.groups, m.scale) == ("B", ["part_3"], ["B", "C", "D"]) and [r[1:] for r in m.rules] == [("pump plan", "test report"), ("hose", "label")]
    assert sorted(r.node_id for r in m.reqs.collect()) == ["5.1", "6.1"]
    assert sorted((r.method, r.found) for r in m.methods().collect()) == [("leak check", True), ("zzz qqq", False)]
    assert {(r.src, r.target) for r in m.edges().collect()} == {("part_3:5.1", "part_3:6.1")}
    scores = {r.layer: r.score for r in m.scores().collect()}
    assert (scores["node_coverage"], scores["concept_coverage"], scores["reference_integrity"], scores["method_audit"], scores["traceability_chain"]) == (50.0, 50.0, 0.0, 50.0, 50.0) and len(scores) == 7
    assert {r.art_id: r.state for r in L.register(m.arts, m.findings()).collect()} == {"W1": "Partially Compliant", "W2": "Missing"}


def test_settings_say_what_is_what(spark, standard):
    meta = {"field_mappings": {"text_field": "text", "id_field": "section", "risk_field": "asil_level"}, "risk_scale": ["A", "B", "C", "D"], "traceability_paths": [{"name": "n", "path": ["a", "b"]}]}
    (standard / "s" / "compliance_meta.json").write_text(json.dumps(meta))
    m = files.FileModel(spark, str(standard / "s"), str(standard / "w.json"))
    assert (m.fields.text, m.fields.notes, m.fields.tag, m.fields.methods) == ("text", None, None, []) and m.scale == ["A", "B", "C", "D"]
    assert m.rules[-1][1:] == ("", "") and {r.layer: r.score for r in m.scores().collect()}["method_audit"] == 100.0
    assert L.level_multiplier(m.target, m.scale) == 2.0


def test_markdown_beside_json_and_documents(spark, standard):
    (standard / "s" / "part_4.md").write_text("# Part 4\n## 9 Bench\n### 9.1 Bench test\nThe bench shall be level. See Part 3, Clause 5.1 of it.\n")
    (standard / "docs").mkdir()
    (standard / "docs" / "plan.txt").write_text("BENCH PLAN\nWe follow clause 9.1, derived from Goals, verified by a test.\n")
    (standard / "docs" / "bad.docx").write_bytes(b"no archive")
    m = files.FileModel(spark, str(standard / "s"), str(standard / "docs"))
    assert {"5.1", "9.1"} <= {r.node_id for r in m.nodes.collect()} and {r.group_key for r in m.nodes.collect()} == {"part_3", "part_4"}
    row = m.arts.first()
    assert row.mapped == ["9.1"] and [(x["from"], x["to"]) for x in row.links] == [("Goals", None), (None, "a test")] and (m.target, m.groups) == (None, None)
    assert [r.path.endswith("bad.docx") for r in m.unread.collect()] == [True]
    with pytest.raises(ValueError):
        files.FileModel(spark, str(standard / "x.pdf"), str(standard / "docs"))


def test_report_from_the_command_line(spark, standard, monkeypatch, capsys):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    assert cli.main(["run", str(standard / "s"), str(standard / "w.json"), "--out", str(standard / "compliance_report"), "--format", "all"]) == 0
    said = capsys.readouterr().out
    assert "node_coverage" in said and "50.0 %" in said
    content = json.loads((standard / "compliance_report.json").read_text())
    assert content["head"]["generated_at"] and [r["layer"] for r in content["scores"]][0] == "node_coverage" and len(content["scores"]) == 7 and len(content["register"]) == 2
    assert "<h2>register</h2>" in (standard / "compliance_report.html").read_text()
    assert [p.rpartition("/")[2] for p in sinks.collect_reports(str(standard), str(standard / "kept"), "now")] == ["compliance_report_now.json", "w_now.json"]
    assert readers.newest_file(spark, str(standard), "compliance_report.*").startswith("file:") and files.report_head("/x/iso_26262", "t")["standard"] == "ISO 26262"


def test_reports_hold_all_rows_pages_the_first(spark, tmp_path):
    df = spark.range(250).selectExpr("id AS n").orderBy("n")
    content = sinks.report({"rows": df})
    assert [r["n"] for r in content["rows"]] == list(range(250)) and len(sinks.report({"rows": df}, 7)["rows"]) == 7
    sinks.write_report(content, str(tmp_path / "r"), "html")
    assert "100 of 250 rows" in (tmp_path / "r.html").read_text()
