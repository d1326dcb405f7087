"""Text of one file's bytes by its extension: text, markdown, CSV, JSON, DOCX, ODT, XLSX, PDF.

Office formats are archives of XML and are read with the standard library; PDF needs the program
``pdftotext`` and is reported as unreadable without it. These functions run inside executors.
"""

from __future__ import annotations

import csv
import io
import json
import re
import shutil
import subprocess
import tempfile
import zipfile
from pathlib import PurePosixPath
from xml.etree import ElementTree

EXTENSIONS = (".json", ".md", ".txt", ".csv", ".docx", ".odt", ".xlsx", ".xls", ".pdf")
PDF_SECONDS = 30


def decode(data: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _words(node) -> str:
    return "".join(t for t in node.itertext())


def docx(data: bytes) -> tuple[str, str]:
    """(title, text): paragraphs, then table rows with cells joined by ' | '."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    tables = [t for t in body.iter() if _local(t.tag) == "tbl"]
    inside = {id(p) for t in tables for p in t.iter()}
    lines = [_words(p) for p in body.iter() if _local(p.tag) == "p" and id(p) not in inside]
    for t in tables:
        for row in (r for r in t.iter() if _local(r.tag) == "tr"):
            lines.append(" | ".join(_words(c).strip() for c in row if _local(c.tag) == "tc"))
    lines = [x for x in lines if x.strip()]
    named = next((n.text for n in core.iter() if _local(n.tag) == "title" and n.text), "") if core is not None else ""
    return named or (lines[0][:100] if lines else ""), "\n".join(lines)


def odt(data: bytes) -> tuple[str, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("content.xml"))
    lines = [x for x in (_words(n) for n in body.iter() if _local(n.tag) in ("p", "h")) if x.strip()]
    return (lines[0] if lines and len(lines[0]) < 200 else ""), "\n".join(lines)


def xlsx(data: bytes) -> tuple[str, str]:
    """All sheets, each under a banner, rows as ``table_text``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_words(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for title, name in zip([*titles, *[""] * len(sheets)], sheets):
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if _local(r.tag) == "row"):
                cells: list[str] = []
                for c in (c for c in row if _local(c.tag) == "c"):
                    value = "".join(_words(v) for v in c if _local(v.tag) in ("v", "is"))
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    cells += [""] * (at - len(cells))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                rows.append(cells)
            out += [f"=== Sheet: {title} ===", table_text(rows)]
    return "", "\n".join(out)


def table_text(rows: list[list[str]]) -> str:
    """'Header: value | ...' under a header row (two or more cells, all filled and short), else cells
    joined by tabs."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    head = rows[0] if rows else []
    if len(head) >= 2 and all(c.strip() and len(c) < 100 for c in head):
        return "\n".join(["\t".join(head), *(" | ".join(f"{h}: {c}" for h, c in zip(head, r) if c.strip()) for r in rows[1:])])
    return "\n".join("\t".join(r) for r in rows)


def pdf(data: bytes) -> tuple[str, str]:
    if not shutil.which("pdftotext"):
        raise ValueError("pdftotext is not installed")
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(data)
        f.flush()
        best = ""
        for options in (["-layout"], []):
            done = subprocess.run(["pdftotext", *options, f.name, "-"], capture_output=True, timeout=PDF_SECONDS, check=False)
            best = max(best, done.stdout.decode("utf-8", "replace"), key=len)
            if len(best) >= 500:
                break
    return "", best


def _leaves(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [x for p in parts for x in _leaves(p)]


def text_title(text: str) -> str:
    """The first of five lines that is all capitals or numbered, else the first that isn't blank."""
    lines = [x.strip() for x in text.split("\n")]
    for x in lines[:5]:
        if x and (x.isupper() or re.match(r"\d+\.\s+", x)):
            return x[:100]
    return next((x[:100] for x in lines if x), "")


def extract(name: str, data: bytes) -> tuple[str, str]:
    """(title, text) of a file; ValueError and the like for what can't be read."""
    path = PurePosixPath(name)
    kind = path.suffix.lower()
    if kind == ".docx":
        title, text = docx(data)
    elif kind == ".odt":
        title, text = odt(data)
    elif kind in (".xlsx", ".xls"):
        title, text = xlsx(data) if data[:2] == b"PK" else ("", decode(data))
    elif kind == ".pdf":
        title, text = pdf(data)
    elif kind == ".csv":
        title, text = "", table_text(list(csv.reader(io.StringIO(data.decode("utf-8", "replace")))))
    elif kind == ".json":
        title, text = "", "\n".join(_leaves(json.loads(decode(data))))
    else:
        text = decode(data)
        heading = re.search(r"^#\s+(.+)$", text, re.M) if kind == ".md" else None
        title = heading[1].strip() if heading else "" if kind == ".md" else text_title(text)
    return title or path.stem, text
