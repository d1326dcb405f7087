"""python -m traceloom.cli run STANDARD ARTIFACT [--meta FILE] [--out STEM] [--format json|html|all] | check DATA | ingest PATH OUT | parse PATH OUT"""

from __future__ import annotations

import argparse
from datetime import datetime

from traceloom.session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="a standard's files against artifact files, as a report")
    run.add_argument("standard")
    run.add_argument("artifact")
    run.add_argument("--meta")
    check = sub.add_parser("check", help="coverage of standards by work products of tables, as a report")
    check.add_argument("data")
    for one in (run, check):
        one.add_argument("--out", default="report")
        one.add_argument("--format", default="json", choices=("json", "html", "all"))
    for name, text in (("ingest", "files of any kind to artifacts"), ("parse", "markdown standards to clauses")):
        one = sub.add_parser(name, help=text)
        one.add_argument("path")
        one.add_argument("out")
    args = p.parse_args(argv)
    spark = local_session()
    if args.command in ("run", "check"):
        from traceloom.plans import files
        from traceloom.plans.compliance import Model
        from traceloom.sources import sinks

        m = Model(spark, args.data) if args.command == "check" else files.FileModel(spark, args.standard, args.artifact, args.meta)
        content = sinks.report(files.report_sections(m))
        print(*sinks.summary_lines(content["scores"], content["overall"]), sep="\n")
        head = files.report_head(args.data if args.command == "check" else args.standard, datetime.now().isoformat())
        print(*sinks.write_report({"head": head, **content}, args.out, args.format), sep="\n")
    else:
        from traceloom.sources import readers, sinks

        df = readers.document_files(spark, args.path) if args.command == "ingest" else readers.markdown_standard(spark, args.path)
        sinks.write_json(df, args.out)
        print(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
