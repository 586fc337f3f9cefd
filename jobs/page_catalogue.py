"""A catalogue of files as they arrive: names, sizes, digests, and which content was there before.

    python -m jobs.page_catalogue --pages pages.parquet --catalogue OUT/catalogue --hosts OUT/hosts --checkpoint OUT/checkpoint --config jobs/page_catalogue.json

Input: a folder of Parquet files (page_id, url, html) that grows. A file stream takes what its checkpoint has not seen and
ends when all of it is read (availableNow). Each batch adds to the catalogue, partitioned by batch: a batch that is repeated
after a failure replaces its own partition and nothing else. Content is the same if its digest is; its first page is the smallest of the
batch that brought it, and later pages point there. The figures of the hosts that a batch touched are then made anew,
bucket by bucket, from the catalogue.
"""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.functions.names import numeric_first_key, sha1_12, stem
from sweepgrid.functions.session import cut

from .common import log, main, read_json

DEFAULTS = {"buckets": 16}
PAGES = "page_id long, url string, html string"
CATALOGUE = "page_id long, host string, folder string, name string, number string, n_bytes long, digest string, first_id long, is_new boolean, bucket int, batch long"


def parsed(pages: DataFrame, buckets: int) -> DataFrame:
    """What names and contents say. Without a url host, folder and name are empty; without html the content is empty; a page without an id is left out."""
    pages = pages.where("page_id IS NOT NULL")
    path = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"[?#].*$", ""), r"/+$", "")
    host = F.regexp_extract(path, r"^[A-Za-z]+://([^/]*)", 1)
    rest = F.regexp_replace(path, r"^[A-Za-z]+://[^/]*/?", "")
    content = F.coalesce("html", F.lit(""))
    named = pages.select("page_id", host.alias("host"), F.regexp_replace(rest, r"/?[^/]*$", "").alias("folder"), stem(rest).alias("name"), F.octet_length(content).cast("long").alias("n_bytes"), sha1_12(content.cast("binary")).alias("digest"))
    # Names that are whole numbers, without leading zeros, order the pages of a folder.
    number = F.when(numeric_first_key(F.col("name"))[0] == 0, F.regexp_extract("name", r"^\s*([+-]?)0*(\d+)\s*$", 2))
    return named.withColumn("number", number).withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(buckets)).cast("int"))


def catalogue_of(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as it stands; empty before the first batch."""
    try:
        return spark.read.schema(CATALOGUE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CATALOGUE)


def add_batch(pages: DataFrame, batch: int, catalogue: str, buckets: int) -> None:
    """One batch into the catalogue. Digests of earlier batches are looked up; only their first pages are read."""
    spark = pages.sparkSession
    rows = cut(parsed(pages, buckets))  # contents are read once
    known = catalogue_of(spark, catalogue).where((F.col("batch") < batch) & F.col("is_new")).select("digest", F.col("first_id").alias("known_id"))
    # One row for each digest meets the history; copies, however many, only meet that row.
    first = rows.groupBy("digest").agg(F.min("page_id").alias("here_id")).join(known, "digest", "left")
    placed = rows.join(first, "digest").withColumn("first_id", F.coalesce("known_id", "here_id"))
    new = F.col("known_id").isNull() & F.col("page_id").eqNullSafe(F.col("here_id"))
    out = placed.select("page_id", "host", "folder", "name", "number", "n_bytes", "digest", "first_id", new.alias("is_new"), "bucket", F.lit(batch).cast("long").alias("batch"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(catalogue)


def update_hosts(spark: SparkSession, catalogue: str, hosts: str, batch: int) -> None:
    """Figures of all hosts in the buckets that the batch touched, from the whole catalogue."""
    rows = catalogue_of(spark, catalogue)
    touched = [r["bucket"] for r in rows.where(F.col("batch") == batch).select("bucket").distinct().collect()]  # as many as buckets at most
    figures = rows.where(F.col("bucket").isin(touched)).groupBy("bucket", "host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("is_new").cast("long")).alias("new_contents"), F.sum("n_bytes").alias("n_bytes"), F.max("batch").alias("last_batch")
    )
    if touched:
        figures.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(hosts)


def run(spark: SparkSession, pages: str, catalogue: str, hosts: str, checkpoint: str, config: str | None = None) -> dict[str, int]:
    """Takes what is new, waits for its end, and returns the batches and rows taken."""
    conf = read_json(spark, config, DEFAULTS)

    def take(some: DataFrame, batch: int) -> None:
        add_batch(some, batch, catalogue, conf["buckets"])
        update_hosts(some.sparkSession, catalogue, hosts, batch)

    # As a pattern that matches the path alone, it may name one file as well as a folder.
    path = pages.rstrip("/")
    arriving = spark.readStream.schema(PAGES).parquet(f"{path[:-1]}[{path[-1]}]")
    query = arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = [p["batchId"] for p in query.recentProgress if p["numInputRows"] > 0]
    made = {"batches": len(done), "pages": catalogue_of(spark, catalogue).where(F.col("batch").isin(done)).count() if done else 0}
    log.info("took %d pages in %d batches from %s; catalogue %s, hosts %s", made["pages"], made["batches"], pages, catalogue, hosts)
    return made


if __name__ == "__main__":
    sys.exit(main(__doc__, run, ("pages", "catalogue", "hosts", "checkpoint")))
