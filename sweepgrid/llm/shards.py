"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number that its own content decides, the number is
permuted within [0, N), and the permuted number gives shard (mod) and slot (div).
Shards hold counts at most one apart (law ``rows``), and anyone who knows N, the
seed and a row number can compute where that row went, or invert it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ROUNDS = 6
#: Buckets of a large table by its rows; a small one has more, so that tasks get about as many rows each.
ROWS_PER_BUCKET, LEAST_BUCKETS = 2000, 4096
#: A walk leaves [0, N) for at most a - 1 steps in a row; for N up to WALKS**2 this bound is exact,
#: beyond it a walk this long has a probability below 2**-380.
WALKS = 64


def sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and a * b - n < a: the halves of the Feistel domain."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def global_row_number(df: DataFrame, keys: list[str], out: str, n: int) -> DataFrame:
    """Adds 0..N-1, dealt by the hash of the keys and ordered inside each small bucket.

    Only counts per bucket pass through one task, one for each ROWS_PER_BUCKET rows of a large table. Rows are dealt by all
    their columns, so that keys which are null or repeat do not meet in one bucket.
    """
    buckets = max(n // ROWS_PER_BUCKET, LEAST_BUCKETS)
    b, tie = f"{out}__bucket", f"{out}__tie"
    dealt = df.withColumn(tie, F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])).withColumn(b, F.pmod(F.xxhash64(tie), F.lit(buckets)))
    counts = dealt.groupBy(b).agg(F.count(F.lit(1)).alias(f"{out}__n"))
    w = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(b, F.coalesce(F.sum(f"{out}__n").over(w), F.lit(0)).alias(f"{out}__start"))
    within = Window.partitionBy(b).orderBy(*keys, tie)
    ranked = dealt.withColumn(f"{out}__r", F.row_number().over(within))
    return ranked.join(starts, b).withColumn(out, F.col(f"{out}__start") + F.col(f"{out}__r") - 1).drop(b, tie, f"{out}__start", f"{out}__r")


def _round(i, left: Column, right: Column, a: int, b: int, seed: int) -> tuple[Column, Column]:
    """One round of the unbalanced network; i may be a column."""
    if isinstance(i, int):
        if i % 2 == 0:
            return F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed + i)), F.lit(a)), F.lit(a)), right
        return left, F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed + i)), F.lit(b)), F.lit(b))
    even = i % 2 == 0
    step = i % ROUNDS + F.lit(seed)
    return (
        F.when(even, F.pmod(left + F.pmod(F.xxhash64(right, step), F.lit(a)), F.lit(a))).otherwise(left),
        F.when(even, right).otherwise(F.pmod(right + F.pmod(F.xxhash64(left, step), F.lit(b)), F.lit(b))),
    )


def permute(df: DataFrame, number: str, out: str, n: int, seed: int) -> DataFrame:
    """Adds the Feistel image of number in [0, n); numbers that leave the range walk on."""
    a, b = sides(n)
    left, right = f"{out}__l", f"{out}__r"
    seed = int(seed)
    df = df.withColumn(left, F.floor(F.col(number) / F.lit(b)).cast("long") if n < 2**50 else F.expr(f"`{number}` div {b}L"))
    df = df.withColumn(right, F.pmod(F.col(number), F.lit(b).cast("long")))
    for i in range(ROUNDS):
        x, y = _round(i, F.col(left), F.col(right), a, b, seed)
        df = df.withColumns({left: x.cast("long"), right: y.cast("long")})
    start = F.struct(F.col(left).alias("l"), F.col(right).alias("r"), F.lit(True).alias("on"))

    def step(s: Column, i: Column) -> Column:
        on = F.when(i % ROUNDS == 0, s["l"] * F.lit(b) + s["r"] >= F.lit(n)).otherwise(s["on"])
        x, y = _round(i, s["l"], s["r"], a, b, seed)
        return F.struct(
            F.when(on, x).otherwise(s["l"]).cast("long").alias("l"), F.when(on, y).otherwise(s["r"]).cast("long").alias("r"), on.alias("on")
        )

    walked = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS * WALKS - 1)), start, step, lambda s: s["l"] * F.lit(b) + s["r"])
    direct = F.col(left) * F.lit(b) + F.col(right)
    lost = F.raise_error(F.lit(f"a row left its range for {WALKS} walks")).cast("long")
    return df.withColumn(out, F.when(direct < n, direct).otherwise(walked).cast("long")).withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(lost)).drop(left, right)


def feistel_shards(df: DataFrame, keys: list[str], n_shards: int = 24, seed: int = 20240607) -> DataFrame:
    """df with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Nulls in keys are keys like any other; rows that are equal in all columns are
    interchangeable; an empty table stays empty. Columns named shard or slot are replaced.
    """
    n = df.count()
    num, at = "__sg_row", "__sg_at"
    df = df.drop("shard", "slot")
    got = permute(global_row_number(df, keys, num, n), num, at, max(n, 1), seed)
    shard = F.pmod(F.col(at), F.lit(n_shards)).cast("int")
    return got.withColumns({"shard": shard, "slot": F.expr(f"`{at}` div {n_shards}L")}).drop(num, at)


def feistel_position(number: int, n: int, round_hash: Callable[[int, int], int]) -> int:
    """The same permutation for one number, given the hash of (value, key): where a row went, without Spark."""
    a, b = sides(n)
    x, y = divmod(number, b)
    while True:
        for i in range(ROUNDS):
            if i % 2 == 0:
                x = (x + round_hash(y, i)) % a
            else:
                y = (y + round_hash(x, i)) % b
        if x * b + y < n:
            return x * b + y


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``: counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return feistel_shards(docs, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
