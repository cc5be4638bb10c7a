"""python -m quireflow FOLDER --output OUT --plugins MODULE [--engines a,b]: reads the files of a folder into JSON results."""

from __future__ import annotations

import argparse
import importlib

from pyspark import cloudpickle
from pyspark.sql import SparkSession

from quireflow import pipeline
from quireflow.sources import scan


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quireflow", description="Reads scanned files with all registered engines and writes one JSON object a document.")
    p.add_argument("folder", help="folder or file to read; folders are searched through")
    p.add_argument("--output", help="folder of the results; next to the input if not given")
    p.add_argument("--plugins", required=True, help="module that registers engines when it is imported")
    p.add_argument("--engines", help="names of the engines to use, divided by commas; all registered ones if not given")
    a = p.parse_args(args)
    cloudpickle.register_pickle_by_value(importlib.import_module(a.plugins))  # so that workers need not have it
    names = a.engines.split(",") if a.engines else sorted(scan.ENGINES, key=lambda n: scan.ENGINES[n][0])
    unknown = [n for n in names if n not in scan.ENGINES]
    if unknown:
        p.error(f"no such engine: {', '.join(unknown)}; there are {', '.join(scan.ENGINES)}")
    spark = SparkSession.builder.appName("quireflow").getOrCreate()
    for r in pipeline.process_folder(spark, a.folder, a.output or a.folder.rstrip("/") + "-results", names).collect():
        print(f"{r['status']}: {r['documents']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
