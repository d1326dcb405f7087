"""Sinks: JSON and CSV from DataFrames, reports of bounded size as one file."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a section that an HTML page shows; the JSON report holds them all.
PAGE_ROWS = 100


def trace_export(nodes: DataFrame) -> DataFrame:
    """Section, Title, Type, Level and Tags joined by '; '."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return nodes.select(F.col("node_id").alias("Section"), text("title").alias("Title"), text("node_type").alias("Type"), F.col("risk").alias("Level"), text(F.array_join("tags", "; ")).alias("Tags"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_clauses(clauses: DataFrame, path: str, part: str, title: str) -> None:
    """Clause rows as documents of a part: one JSON line for each clause, in folders by part."""
    clauses.withColumns({"part": F.lit(part), "part_title": F.lit(title)}).write.mode("overwrite").partitionBy("part").json(path)


def report(sections: dict[str, DataFrame], rows: int | None = None) -> dict[str, list[dict]]:
    """The rows of each section in the frame's order, as plain values; all of them, unless ``rows`` says how many."""
    return {name: [json.loads(x) for x in (df if rows is None else df.limit(rows)).toJSON().toLocalIterator()] for name, df in sections.items()}


def write_report_json(content: dict, path: str) -> str:
    Path(path).write_text(json.dumps(content, ensure_ascii=False, indent=1, default=str), encoding="utf-8")
    return path


def write_report_html(content: dict, path: str, title: str = "Coverage report") -> str:
    out = [f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, rows in content.items():
        if not isinstance(rows, list):
            out.append(f"<p>{html.escape(json.dumps(rows, ensure_ascii=False, default=str))}</p>")
            continue
        whole, rows = len(rows), rows[:PAGE_ROWS]
        columns = list(dict.fromkeys(c for r in rows for c in r))
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in columns)}</tr>")
        out += [f"<tr>{''.join(f'<td>{html.escape(str(r.get(c, chr(0x2014))))}</td>' for c in columns)}</tr>" for r in rows]
        out.append("</table>" + (f"<p>{PAGE_ROWS} of {whole} rows</p>" if whole > PAGE_ROWS else ""))
    Path(path).write_text("\n".join([*out, "</body></html>"]), encoding="utf-8")
    return path


def write_report(content: dict, stem: str, formats: str = "json") -> list[str]:
    """One file for each format of 'json', 'html' or 'all'."""
    done = []
    if formats in ("json", "all"):
        done.append(write_report_json(content, f"{stem}.json"))
    if formats in ("html", "all"):
        done.append(write_report_html(content, f"{stem}.html"))
    if not done:
        raise ValueError(f"unknown format {formats!r}")
    return done


def collect_reports(folder: str, out: str, stamp: str, kinds: tuple[str, ...] = (".json", ".docx", ".pdf")) -> list[str]:
    """Copies of a folder's reports under names with a time stamp."""
    Path(out).mkdir(parents=True, exist_ok=True)
    done = []
    for p in sorted(Path(folder).iterdir()):
        if p.suffix in kinds and p.is_file():
            target = Path(out) / f"{p.stem}_{stamp}{p.suffix}"
            target.write_bytes(p.read_bytes())
            done.append(str(target))
    return done


def summary_lines(scores: list[dict], overall: list[dict]) -> list[str]:
    """What the console shows: each layer's score with its bar, then the whole."""
    lines = [f"{r['layer']:<22} {r['score']:>6.1f} % x {r['weight']:.2f} {'#' * int(r['score'] // 5)}" for r in scores]
    return lines + [f"{r['std']}: {r['score']:.1f} % {r['grade']}" for r in overall]
