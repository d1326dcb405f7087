import io
import json
import zipfile

import pytest

from traceloom.sources import extract, readers, sinks
from traceloom.streaming import watch

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


DOCX = archive(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>Safety plan</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
ODT = archive(content_xml='<o xmlns:t="urn:t"><t:h>Head</t:h><t:p>Body of it</t:p></o>')
XLSX = archive(
    xl__workbook_xml='<workbook><sheets><sheet name="One"/></sheets></workbook>', xl__sharedStrings_xml="<sst><si><t>Name</t></si><si><t>Level</t></si></sst>",
    xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><v>3</v></c></row></sheetData></worksheet>',
)


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a.docx": DOCX, "b.odt": ODT, "c.xlsx": XLSX, "d.csv": b"Name,Level\nx,3\n", "e.md": b"# Title\ntext, derived from Goals.\n", "f.txt": "PLAN\nna\xefve".encode("latin-1"), "g.json": json.dumps({"a": ["hara", {"b": "per 5.1"}]}).encode(), "h.docx": b"broken", "i.bin": b"?"}.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_extract():
    assert extract.extract("a.docx", DOCX) == ("Safety plan", "Safety plan\na | b")
    assert extract.extract("b.odt", ODT) == ("Head", "Head\nBody of it")
    assert extract.extract("c.xlsx", XLSX) == ("c", "=== Sheet: One ===\nName\tLevel\nName: x | Level: 3")
    assert extract.extract("d.csv", b"Name,Level\nx,3\n") == ("d", "Name\tLevel\nName: x | Level: 3")
    assert extract.extract("f.txt", "1. Aim\nna\xefve".encode("latin-1")) == ("1. Aim", "1. Aim\nna\xefve")


def test_folder(spark, folder):
    assert readers.list_files(spark, folder).count() == 8
    files = {r.file_name: r for r in readers.extracted(readers.binary_files(spark, folder)).collect()}
    assert files["h.docx"].error and not files["f.txt"].error
    docs = {r.title: r for r in readers.document_files(spark, folder).collect()}
    assert len(docs) == 7 and docs["Safety plan"].id == "WP-001" and docs["Title"].derived_from == ["Goals"]
    assert docs["g"].methods == ["hara"] and docs["g"].mapped == ["5.1"]


def test_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"project": {"target_asil": "B", "parts_in_scope": [3, 4]}, "work_products": [{"wp_id": "W1", "name": "N", "content": "c", "body": "d", "sections": [{"title": "s", "text": "t"}], "tags": ["X"], "mapped_clauses": ["5.1"], "links": [{"from": "a", "to": "b"}], "status": "Draft", "state": "Done"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "W2"}]))
    (tmp_path / "c.json").write_text("{")
    rows = readers.json_artifacts(spark, str(tmp_path)).orderBy("art_ord").collect()
    assert [(r.art_ord, r.id) for r in rows] == [(1, "W1"), (2, "W2")]
    assert (rows[0].title, rows[0].full_text, rows[0].status, rows[0].tags, rows[0].mapped, rows[0].links[0]["to"]) == ("N", "c d s t", "done", ["x"], ["5.1"], "b")
    assert readers.target_and_scope(readers.json_artifacts(spark, str(tmp_path))) == ("B", ["part_3", "part_4"])


def test_standards(spark, tmp_path):
    (tmp_path / "part_3.md").write_text("# Part 3\n## 5 General\nIt shall.\n")
    (tmp_path / "README.md").write_text("# no\n## 1 No\n")
    (tmp_path / "p.json").write_text(json.dumps({"part": "4", "title": "T", "clauses": [{"section": "6.1", "text": "x", "tags": ["a"]}, {"id": "6.2", "text": "y"}]}))
    (tmp_path / "g.json").write_text(json.dumps({"glossary": [{"term": "t", "definition": "d"}]}))
    assert [(r.part, r.section, r.type) for r in readers.standard(spark, str(tmp_path / "part_3.md")).collect()] == [("3", "5", "requirement")]
    assert [(r.part, r.section) for r in readers.markdown_standard(spark, str(tmp_path)).collect()] == [("3", "5")]
    assert [(r.group_key, r.node_id, r.risk) for r in readers.standard(spark, str(tmp_path)).orderBy("place").collect()] == [("part_4", "6.1", "all"), ("part_4", "6.2", "all")]
    assert [r.term for r in readers.glossary(spark, str(tmp_path)).collect()] == ["t"]
    with pytest.raises(ValueError):
        readers.standard(spark, "x.pdf")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("5.1", "a <b>", None, "B", ["x", None, "y"])], "node_id string, title string, node_type string, risk string, tags array<string>")
    assert tuple(sinks.trace_export(df).first()) == ("5.1", "a <b>", "", "B", "x; y")
    sinks.write_csv(sinks.trace_export(df), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["Tags"] == "x; y"
    done = sinks.write_report(sinks.report({"nodes": df}), str(tmp_path / "r"), "all")
    assert "a &lt;b&gt;" in (tmp_path / "r.html").read_text() and readers.saved_report(spark, done[0]).count() == 1


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.txt", "b.txt"):
        (tmp_path / "in" / n).write_text(n)
        q = watch.store_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
        assert q.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.txt", "b.txt"]
