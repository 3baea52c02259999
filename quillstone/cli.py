"""Command line: extract a folder into a workbook, a database and reports.

Exit codes: 0 done, 1 failed, 130 interrupted.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
from pathlib import Path
from typing import TYPE_CHECKING

from quillstone import config
from quillstone.errors import QuillstoneError

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from quillstone.plans.pipeline import Choice


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstone", description="Extract header fields from document files.")
    p.add_argument("input", help="a file or a folder")
    p.add_argument("-o", "--output", help="folder or .xlsx file for the results")
    p.add_argument("-c", "--config", help="YAML settings")
    p.add_argument("-r", "--recursive", action="store_true", help="folders below the input too")
    p.add_argument("--no-excel", action="store_true")
    p.add_argument("--no-database", action="store_true")
    p.add_argument("--evaluate", "--ground-truth", "-gt", metavar="GROUND_TRUTH", help="score against this file")
    p.add_argument("--qa", default="auto", help="question answering backend, none, or auto: the first that is installed")
    p.add_argument("--ocr", help="recognition backend, instead of the one in the settings")
    p.add_argument("--default-date", type=dt.date.fromisoformat, metavar="YYYY-MM-DD", help="the day that dates without some part take it from; today by default")
    p.add_argument("--no-fuzzy-dates", action="store_true", help="leave dates that no format fits as they are")
    p.add_argument("--debug", action="store_true", help="Spark's log at level INFO")
    p.add_argument("--report", choices=("txt", "json", "html"), default="txt")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def choice_of(args: argparse.Namespace):
    """The backends that the options name.  Without an installed model, fields come from patterns alone."""
    from quillstone.plans.pipeline import Choice
    from quillstone.sources import backends

    qa = None
    if args.qa == "auto":
        qa = next((b for b in backends.QA.known.values() if b.available()), None)
    elif args.qa != "none":
        qa = backends.QA.resolve(args.qa, strict=True)
    ocr = backends.OCR.resolve(args.ocr, strict=True) if args.ocr else None
    return Choice(qa=qa, ocr=ocr, fuzzy_dates=not args.no_fuzzy_dates, default_date=args.default_date)


def score(headers: DataFrame, truth: DataFrame, kind: str, warn=print) -> str:
    """The report of extractions against ground truth; incomplete records of the latter are told."""
    from quillstone.operators import evaluate
    from quillstone.operators.extract import flat
    from quillstone.operators.store import with_ids
    from quillstone.plans import reports

    incomplete = evaluate.completeness(truth).first().invalid_records
    if incomplete:
        warn(f"ground truth has {incomplete} incomplete records")
    # places are dense, as the running confidence divides by them
    numbered = with_ids(flat(headers), ["source_file"], start=-1).withColumnRenamed("id", "idx")
    return reports.report(*evaluate.evaluate(numbered, truth), kind)


def run(args: argparse.Namespace, choice: Choice | None = None) -> int:
    from pyspark.sql import functions as F

    from quillstone.plans import pipeline
    from quillstone.session import materialise, session
    from quillstone.sources import ground_truth, sqlite, workbook

    settings = config.load(args.config)
    spark = session()
    if args.debug:
        spark.sparkContext.setLogLevel("INFO")
    say = (lambda *x: None) if args.quiet else print
    choice = choice or choice_of(args)
    if choice.qa is None:
        print("no question answering model: vendor and customer can't be found", file=sys.stderr)
    found = pipeline.extract(spark, args.input, settings, choice, recursive=args.recursive)
    headers = materialise(found.headers)
    target = Path(args.output or settings.get("paths.output_dir", "outputs"))
    folder = target.parent if target.suffix == ".xlsx" else target
    folder.mkdir(parents=True, exist_ok=True)
    stamp = headers.sparkSession.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    failed = 0
    sinks = []
    if settings.get("output.excel.enabled", True) and not args.no_excel:
        book = target if target.suffix == ".xlsx" else folder / settings.get("output.excel.filename_pattern").format(timestamp=stamp)
        sinks.append(("workbook", lambda: workbook.export(headers, str(book), settings.get("output.excel.sheet_name"))))
    if settings.get("output.database.enabled", True) and not args.no_database:
        base, table = folder / settings.get("output.database.name"), settings.get("output.database.table_name")
        sinks.append(("database", lambda: sqlite.append(pipeline.admitted(headers), str(base), table)))
    for name, sink in sinks:
        try:
            say(f"{name}: {sink()}")
        except QuillstoneError as e:
            failed += 1
            print(f"{name}: {e}", file=sys.stderr)
    if args.evaluate:
        say(score(headers, ground_truth.read(spark, args.evaluate), args.report, lambda *x: print(*x, file=sys.stderr)))
    for r in found.errors.limit(20).collect():
        print(f"{r.stage}: {r.path}: {r.error}", file=sys.stderr)
    return int(bool(failed))


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except KeyboardInterrupt:
        return 130
    except QuillstoneError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
