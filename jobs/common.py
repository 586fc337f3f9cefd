"""What both jobs share: configuration, logging and the command line's session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("sweepgrid.jobs")


def read_json(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with what a JSON file says; the file is read by Spark, so it may lie in any store. Unknown keys are an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"]) if path else {}
    unknown = given.keys() - defaults.keys()
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def main(doc: str, run: Callable[..., dict], paths: tuple[str, ...], argv: list[str] | None = None) -> int:
    """Parses paths and a configuration, runs the job in a session of its own and logs its figures."""
    p = argparse.ArgumentParser(description=doc)
    for name in paths:
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, *(a[n] for n in paths), config=a["config"])
    finally:
        spark.stop()
    return 0
