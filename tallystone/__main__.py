"""A run from the command line: python -m tallystone FOLDER OUT [--settings FILE] [--units FILE] [--cache PATH] [--replay FOLDER].

Writes OUT/comparison.xlsx, OUT/result.json and OUT/report.txt, and prints the report. The session comes from
spark-submit or from the environment; the folder and the cache may lie in any store that Spark reads.
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import batch
from .sinks import report
from .sources import ocr, settings


def main(argv: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(prog="tallystone", description="Compares the quotations in a folder.")
    ask.add_argument("folder")
    ask.add_argument("out")
    for name in ("settings", "units", "cache", "replay"):
        ask.add_argument(f"--{name}")
    given = ask.parse_args(argv)
    settings.load_env()
    own = settings.layered(settings.settings(given.settings), {"llm": {"replay_dir": given.replay}} if given.replay else None)
    if given.units:
        own["units"] = settings.units(given.units)
    spark = SparkSession.builder.appName("tallystone").getOrCreate()
    run = batch.run(spark, given.folder, None, ocr.engine(own["ocr"]["engine"], own["ocr"]["dpi"]), own, given.cache)
    out = Path(given.out)
    out.mkdir(parents=True, exist_ok=True)
    limits = (own["compare"]["price_deviation_threshold"], own["compare"]["lead_time_factor"])
    report.write_workbook(run, str(out / "comparison.xlsx"), *limits)
    (out / "result.json").write_text(report.result_json(run), encoding="utf-8")
    told = report.report(run)
    (out / "report.txt").write_text(told, encoding="utf-8")
    print(told)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
