"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so Jaccard similarity says little; what
counts is containment: the share of an item's shingles that a document has. Items are
partitioned by their number of distinct shingles, the bounds of partitions growing
by a fifth, and an item's sketch holds its smallest shingle hashes, about a fifth of them and a
few more, by the upper bound of its partition. A document that has enough of an item leaves
out so few of its shingles that some of its sketch must be met (`need` of them, for sure and
not only likely). So the search looks for sketches alone; the pairs that it finds, few, are
verified by the exact containment of all distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_array

WORDS = 5
THRESHOLD = 0.8
#: A sketch has one entry for this many of its partition's upper bound, beyond those that a document may leave out.
SPARE = 16
#: Sketches, candidates and leaks are broadcast up to this many rows (about 40 bytes each) and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shingle_hashes(words: Column, k: int = WORDS) -> Column:
    """Hashes of all runs of k words; a shorter text that has words is one shingle."""
    n = F.size(words)

    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(k)])

    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), one)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(runs)


def item_shingles(bench: DataFrame, threshold: float = THRESHOLD, ident: str = "item_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """Distinct (item, part, h) with n_item (the item's distinct shingles), in_sketch, and need: the part of the sketch that a match has at least.

    part is the MD5 of the item's text: items that share an ident, or have none, stay apart.
    """
    words = bench.select(F.col(ident).alias("item"), _text_key(F.col(text)).alias("part"), word_array(F.col(text)).alias("w"))
    rows = words.select("item", "part", F.explode(F.array_distinct(shingle_hashes(F.col("w"), k))).alias("h")).distinct()
    item = Window.partitionBy("item", "part")
    rows = rows.withColumn("n_item", F.count(F.lit(1)).over(item)).withColumn("rank", F.row_number().over(item.orderBy(F.xxhash64("h", F.lit(11)), "h")))
    top = F.greatest(F.col("n_item"), F.floor(F.pow(F.lit(2.0), F.ceil(4 * F.log2("n_item") - F.lit(1e-9)) / 4)))  # bounds 1, 2, 4, 8 and three between each
    absent = lambda n: F.floor(n * F.lit(1 - threshold) + F.lit(1e-9))  # noqa: E731  so many shingles a match may leave out
    sketch = F.least(F.col("n_item"), absent(top) + F.greatest(F.lit(1), F.floor(top / SPARE)))
    return rows.select("item", "part", "h", "n_item", (F.col("rank") <= sketch).alias("in_sketch"), (sketch - absent(F.col("n_item"))).alias("need"))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _found(docs: DataFrame, items: DataFrame, threshold: float, ident: str, text: str) -> DataFrame:
    """(id, key, item, part, n_shared, n_item) for each distinct (ident, text) of docs that holds an item; key: the text's MD5."""
    keyed = docs.select(F.col(ident).alias("id"), _text_key(F.col(text)).alias("key"), F.col(text).alias("t"))
    # A column of its own: a text is split once, not for each shingle.
    runs = lambda df, *cols: df.select(*cols, word_array(F.col("t")).alias("w")).select(*cols, F.explode(F.array_distinct(shingle_hashes(F.col("w")))).alias("h"))
    sketches = items.where("in_sketch").select("item", "part", "h", "need")
    hits = runs(keyed, "id", "key").join(_bounded(sketches, sketches.count()), "h")
    candidates = cut(hits.groupBy("id", "key", "item", "part").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need").select("id", "key", "item", "part"))
    n = candidates.count()
    which = _bounded(candidates.select(F.col("id").alias("c_id"), F.col("key").alias("c_key")).distinct(), n)
    met = keyed.join(which, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key")), "left_semi").dropDuplicates(["id", "key"])
    pairs = met.join(candidates.select(F.col("id").alias("c_id"), F.col("key").alias("c_key"), "item", "part"), F.col("id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key")))
    every = _bounded(items.select(F.col("item").alias("c_item"), F.col("part").alias("c_part"), F.col("h").alias("c_h"), "n_item"), items.count())
    shared = runs(pairs, "id", "key", "item", "part").join(every, F.col("item").eqNullSafe(F.col("c_item")) & (F.col("part") == F.col("c_part")) & (F.col("h") == F.col("c_h")))
    counted = shared.groupBy("id", "key", "item", "part").agg(F.count(F.lit(1)).alias("n_shared"), F.first("n_item").alias("n_item"))
    return counted.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item"))


def contained(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, ident: str = "doc_id", text: str = "text", item_ident: str = "item_id", item_text: str = "text") -> DataFrame:
    """(ident, item_ident, n_shared, n_item, containment) for each document that holds an item.

    Null and blank texts have no shingles and match nothing; a text below five words is one
    shingle. Rows are judged by their own texts: equal rows give one row, different texts with
    one ident, or with none, one each. So are items: of equal ones one counts, and different texts
    with one ident, or with none, are items of their own. No items or no documents: no rows. An item in many documents costs rows in proportion to its matches.
    """
    items = cut(item_shingles(bench, threshold, item_ident, item_text))
    got = _found(docs, items, threshold, ident, text)
    return got.select(F.col("id").alias(ident), F.col("item").alias(item_ident), F.col("n_shared").cast("long"), F.col("n_item").cast("long"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean_rows(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a test item; every row is judged by its own text."""
    items = cut(item_shingles(bench, threshold))
    leaks = cut(_found(docs, items, threshold, ident, text).select(F.col("id").alias("__sg_id"), F.col("key").alias("__sg_leak")).distinct())
    return docs.join(_bounded(leaks, leaks.count()), docs[ident].eqNullSafe(F.col("__sg_id")) & (_text_key(docs[text]) == F.col("__sg_leak")), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return contained(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE_OP9 = r"""
WITH t AS (
  SELECT 0 AS kind, item_id AS id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark)
  UNION ALL
  SELECT 1, doc_id, unnest(w), generate_subscripts(w, 1), len(w)
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)
),
g AS (
  SELECT kind, id, i, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS s
  FROM t WINDOW o AS (PARTITION BY kind, id ORDER BY i)
),
s AS (SELECT DISTINCT kind, id, s FROM g WHERE i + 4 <= n OR (n < 5 AND i = 1)),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 0 GROUP BY 1),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM s d JOIN s b USING (s) WHERE d.kind = 1 AND b.kind = 0 GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""
