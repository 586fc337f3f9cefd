"""Where intermediate results go, read from the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's own folder; a local one only where neither is set and all runs on this machine."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not given:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="sweepgrid-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(given)
    return given.rstrip("/")


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to be broadcast, after its rows have been counted up to a limit; beyond it an error, as nested loops would not end."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows cannot be compared with every row of another table")
    return F.broadcast(df)


#: Rows of a table of settings (one for each scan) up to which it is broadcast.
SETTINGS_ROWS = 20_000


def beside(rows: DataFrame, settings: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the settings of their scan, one row for each value of by; without by there is one row for all.

    Settings are broadcast behind a count. Beyond it the join shuffles, and skewed scans are split there.
    """
    if not by:
        return rows.join(F.broadcast(settings))
    few_scans = settings.limit(SETTINGS_ROWS + 1).count() <= SETTINGS_ROWS
    return rows.join(F.broadcast(settings) if few_scans else settings, list(by))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def afresh(df: DataFrame) -> DataFrame:
    """df written under the shared folder and read again: as cut, but with sizes that are measured.

    A checkpoint hands on the estimate of its plan. Joins multiply estimates, so a loop that joins what it made with itself
    squares them in each round, until the driver cannot hold the number.
    """
    at = f"{shared_dir(df.sparkSession)}/afresh-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
