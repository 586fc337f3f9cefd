"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import sys

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut, shared_dir

__all__ = ["cut", "delete", "mix64", "shared_dir", "ship_package", "sub_batches", "table", "text_bytes", "word_array", "word_count"]

#: What separates words: space and the ASCII controls 9 to 13, as bytes.split() does.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def ship_package() -> None:
    """Let Python workers run this package even where it is not on their path."""
    import sweepgrid

    root = os.path.dirname(os.path.dirname(os.path.abspath(sweepgrid.__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]
    if root not in map(os.path.abspath, filter(None, known)):
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules["sweepgrid"])


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one input table."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of intermediate results."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def word_array(text: Column) -> Column:
    """The words of a text (null and blank texts: none), kept as they stand."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, to size groups by."""
    got = df.agg(F.sum(F.octet_length(text)).alias("n")).first()
    return int(got["n"] or 0)


def sub_batches(ids, texts, limit: int):
    """Lists of (id, bytes) with about limit bytes each; a longer text stands alone."""
    some, held = [], 0
    for i, t in zip(ids, texts, strict=True):
        b = b"" if t is None else (t.encode() if isinstance(t, str) else bytes(t))
        if some and held + len(b) > limit:
            yield some
            some, held = [], 0
        some.append((i, b))
        held += len(b)
    if some:
        yield some


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x
