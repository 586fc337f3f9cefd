"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash into blocks, whose number grows with the source.
A source's target decides its quota of block instances: whole passes over its blocks, and
one more of the first of its permuted blocks. The quotas of all sources are then split among
the output shards by a binary tree: at each node, the tokens that stand for them are permuted
and cut in proportion to the shards left and right, which is an exact multivariate
hypergeometric draw of each source's quota. Each shard fills its quotas with disjoint blocks
in permuted order, and what it was given decides how often a document is taken. Its rows
are shuffled locally. Only the block table passes the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Blocks of a source: so many at least, and one for each BLOCK_DOCS documents of a large one.
BLOCKS, BLOCK_DOCS = 512, 2048
#: Documents of a source, at least, among which single ones fill what whole blocks leave of its target.
POOL = 256
#: The block table is broadcast up to this many rows (about 100 bytes each) and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000
#: Tokens of a tree node that one task ranks; a node with more is ranked by parts of its permutation.
PART_TOKENS = 500_000
SHARDS = 16
SEED = 7_1234


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """One row per source (src, null_last, source_size) -> also rank, weight, target.

    Water filling: sources sorted by cap / weight are filled one after the other; a source
    is held at its cap when the level that the rest would share exceeds it. One row per
    source passes a single window.
    """
    order = Window.orderBy("null_last", "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("src_rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("src_rank", F.row_number().over(order) - 1).withColumn("weight", w)
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", "src_rank")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("held", F.col("fill") <= F.col("level"))
    # Once a source is not held, no later one is; the first free one's level holds for all free ones.
    free = F.max(F.when(~F.col("held"), F.struct(-F.col("fill"), -F.col("src_rank"), F.col("level")))).over(every)["level"]
    return ranked.withColumn("target", F.when(F.col("held"), F.col("cap")).otherwise(F.least(F.col("cap"), free * F.col("weight")))).drop(
        "cap", "fill", "level", "held"
    )


def _spread(*parts) -> Column:
    return F.xxhash64(*parts)


def split_tree(tokens: DataFrame, shards: int, seed: int, most: int = 0) -> DataFrame:
    """Splits tokens (any columns that identify one) among shards: adds ``shard``.

    At a node that covers shards [lo, hi), round(n * left / all) of its n tokens go left,
    drawn without replacement by a hash permutation: the counts by source that go left are
    a multivariate hypergeometric draw, and the totals are exact. most: a bound of the number of
    tokens, by which large nodes are ranked in parts.
    """
    ident = tokens.columns
    nodes = tokens.withColumns({"lo": F.lit(0), "hi": F.lit(shards)})
    depth = max(0, (shards - 1).bit_length())
    for level in range(depth):
        at = _spread(*ident, F.lit(seed + level))
        parts = max(1, most // PART_TOKENS >> level)
        if parts == 1:
            node = Window.partitionBy("lo", "hi")
            nodes = nodes.withColumns({"r": F.row_number().over(node.orderBy(at, *ident)), "n": F.count(F.lit(1)).over(node)})
        else:
            nodes = cut(nodes.withColumn("part", F.pmod(at, F.lit(parts))))
            part = Window.partitionBy("lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            sizes = nodes.groupBy("lo", "hi", "part").agg(F.count(F.lit(1)).alias("m"))
            starts = cut(sizes.select("lo", "hi", "part", F.coalesce(F.sum("m").over(part), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy("lo", "hi")).alias("n")))
            rank = F.row_number().over(Window.partitionBy("lo", "hi", "part").orderBy(at, *ident))
            nodes = nodes.withColumn("r", rank).join(starts, ["lo", "hi", "part"]).withColumn("r", F.col("r") + F.col("start"))
        mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
        left = F.col("r") <= F.round(F.col("n") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        one = F.col("hi") - F.col("lo") <= 1
        nodes = nodes.select(
            *ident,
            F.when(one | left, F.col("lo")).otherwise(mid).alias("lo"),
            F.when(one | ~left, F.col("hi")).otherwise(mid).alias("hi"),
        )
    return nodes.select(*ident, F.col("lo").alias("shard"))


def _mixed(docs: DataFrame, source: str, size: str, ident: list[str], shards: int, seed: int) -> DataFrame:
    """docs with __sg_h (the permutation), __sg_size, __sg_target and __sg_homes (one output shard for each copy)."""
    key = {"__sg_src": F.coalesce(F.col(source).cast("string"), F.lit("")), "__sg_null": F.col(source).isNull()}
    rows = docs.withColumns(key).withColumn("__sg_h", _spread(*ident, F.col(size), F.lit(seed)))
    # A fine deal first, then as few blocks as a source's documents need: documents are read once for both.
    fine = F.pmod(F.col("__sg_h"), F.lit(BLOCKS)).cast("long")
    counts = rows.groupBy("__sg_src", "__sg_null").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.where(F.col("n") > BLOCKS * BLOCK_DOCS).select("__sg_src", "__sg_null", F.ceil(F.col("n") / (BLOCKS * BLOCK_DOCS)).alias("__sg_k"))
    wide = cut(wide)
    n_wide = wide.count()
    if n_wide:
        rows = rows.join(F.broadcast(wide) if n_wide <= BROADCAST_ROWS else wide, ["__sg_src", "__sg_null"], "left")
        rows = rows.withColumn("__sg_b", fine + BLOCKS * F.pmod(_spread("__sg_h", F.lit(seed + 1)), F.coalesce("__sg_k", F.lit(1)))).drop("__sg_k")
    else:
        rows = rows.withColumn("__sg_b", fine)

    # Block sums are the only thing that is aggregated over documents; the rest of the plan works on the block table.
    grouped = rows.groupBy(F.col("__sg_src").alias("src"), F.col("__sg_null").alias("null_last"), F.col("__sg_b").alias("b"))
    blocks = cut(grouped.agg(F.sum(size).cast("long").alias("words"), F.count(F.lit(1)).alias("docs")))
    n_blocks = blocks.count()
    totals = blocks.groupBy("src", "null_last").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(MAX_REPEATS), F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12)))).otherwise(0).cast("int")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))

    # Permuted blocks: those that fit in the rest are drawn once more; from the first that doesn't on, enough blocks to hold POOL
    # documents form the pool, which is drawn once more too, and of which single documents fill what is left.
    of_source = Window.partitionBy("src", "null_last")
    perm = of_source.orderBy(_spread("src", "null_last", "b", F.lit(seed + 99)), "b")
    running = perm.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = blocks.join(targets, ["src", "null_last"]).withColumns({"upto": F.sum("words").over(running), "docs_upto": F.sum("docs").over(running), "place": F.row_number().over(perm), "all": F.count(F.lit(1)).over(of_source)})
    drawn = drawn.withColumn("fits", F.col("upto") <= F.col("rest"))
    drawn = drawn.withColumns({"had": F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))).over(of_source), F.lit(0)), "docs_had": F.coalesce(F.max(F.when(F.col("fits"), F.col("docs_upto"))).over(of_source), F.lit(0))})
    drawn = drawn.withColumn("pooled", ~F.col("fits") & (F.col("had") < F.col("rest")) & (F.col("docs_upto") - F.col("docs") - F.col("docs_had") < POOL))
    drawn = cut(drawn.withColumn("left_over", F.col("rest") - F.col("had")))

    # A source's quota: instances 1 to `all` are its first pass over the permuted blocks, the next its second, and so on.
    quotas = drawn.groupBy("src", "null_last").agg((F.max(F.col("whole") * F.col("all")) + F.sum((F.col("fits") | F.col("pooled")).cast("long"))).alias("quota"))
    tokens = quotas.where("quota > 0").select("src", "null_last", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("i"))
    split = split_tree(tokens, shards, seed, n_blocks * (MAX_REPEATS + 1))
    # Each shard's quota of a source is a run of the source's instances, in an order that has nothing to do with their passes.
    given = split.groupBy("src", "null_last", "shard").agg(F.count(F.lit(1)).alias("q"))
    upto = F.sum("q").over(of_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = given.withColumn("upto", upto).select("src", "null_last", "shard", F.explode(F.sequence(F.col("upto") - F.col("q") + 1, F.col("upto"))).alias("turn"))
    turns = tokens.withColumn("turn", F.row_number().over(of_source.orderBy(_spread("src", "i", F.lit(seed + 5)), "i"))).withColumn("turn", F.col("turn").cast("long"))
    sizes = drawn.select("src", "null_last", "all").distinct()
    filled = turns.join(runs, ["src", "null_last", "turn"]).join(sizes, ["src", "null_last"])
    filled = filled.select("src", "null_last", (F.pmod(F.col("i") - 1, F.col("all")) + 1).cast("int").alias("place"), "i", "shard")
    homes = filled.groupBy("src", "null_last", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "shard"))), lambda x: x["shard"]).alias("homes"))
    plan = cut(drawn.join(homes, ["src", "null_last", "place"], "left").select(
        F.col("src").alias("__sg_src"), F.col("null_last").alias("__sg_null"), F.col("b").alias("__sg_b"), F.col("source_size").alias("__sg_size"), F.col("target").alias("__sg_target"),
        F.col("pooled").alias("__sg_pool"), F.col("left_over").alias("__sg_left"), F.coalesce("homes", F.array().cast("array<int>")).alias("__sg_homes"),
    ))
    if n_blocks <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    dealt = rows.join(plan, ["__sg_src", "__sg_null", "__sg_b"])

    # The pool of a source: documents in permuted order while they fit, then twice the largest that fit in what is left, then the one that
    # comes nearest to what is left, also if it goes over the target by less than it fills. The others lose the last copy.
    pool, of_pool = dealt.where("__sg_pool").withColumn("__sg_open", F.lit(True)), Window.partitionBy("__sg_src", "__sg_null")
    for k in range(3):
        part = F.col("__sg_open") & (F.col(size) > 0) & (F.col(size) <= F.col("__sg_left"))
        pool = pool.withColumn("__sg_part", part)
        within = Window.partitionBy("__sg_src", "__sg_null", "__sg_part").orderBy(F.col(size).desc() if k else F.col("__sg_h"), F.col("__sg_h"), *ident)
        sums = F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        pool = pool.withColumn("__sg_in", F.col("__sg_part") & (sums <= F.col("__sg_left")))
        used = F.coalesce(F.sum(F.when(F.col("__sg_in"), F.col(size))).over(of_pool), F.lit(0))
        pool = pool.withColumns({"__sg_left": F.col("__sg_left") - used, "__sg_open": F.col("__sg_open") & ~F.col("__sg_in")})
    off = F.abs(F.col(size) - F.col("__sg_left"))
    nearest = F.row_number().over(Window.partitionBy("__sg_src", "__sg_null", "__sg_open").orderBy(off, F.col("__sg_h"), *ident)) == 1
    pool = pool.withColumn("__sg_in", nearest & F.col("__sg_open") & (off < F.col("__sg_left")))
    pool = pool.withColumn("__sg_open", F.col("__sg_open") & ~F.col("__sg_in"))
    pool = pool.withColumn("__sg_homes", F.when(F.col("__sg_open"), F.slice("__sg_homes", F.lit(1), F.size("__sg_homes") - 1)).otherwise(F.col("__sg_homes")))
    dealt = dealt.where("NOT __sg_pool").unionByName(pool.select(dealt.columns))
    return dealt.withColumn("__sg_homes", F.when(F.col(size) > 0, F.col("__sg_homes")).otherwise(F.array().cast("array<int>"))).drop("__sg_src", "__sg_null", "__sg_b", "__sg_pool", "__sg_left")


def mix(docs: DataFrame, source: str = "source", size: str = "size", ident: list[str] | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs (which has a size column) with ``source_size``, ``target``, ``copies`` and
    ``shards`` (one output shard for each copy); such columns of docs are replaced.

    Null sources form a source of their own, ordered last. A size of 0 is never taken; an
    empty table stays empty. A source of few large documents goes over its target by a part of one
    where that is nearer than to stay below it. Equal rows are told apart by the order of the sort only.
    """
    got = _mixed(docs, source, size, ident or ["doc_id"], shards, seed).drop("source_size", "target", "copies", "shards")
    got = got.withColumnsRenamed({"__sg_size": "source_size", "__sg_target": "target", "__sg_homes": "shards"})
    return got.withColumn("copies", F.size("shards")).drop("__sg_h")


def mixed_rows(docs: DataFrame, size: Column, source: str = "source", ident: list[str] | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document once for each copy taken, with the columns of docs as they are, dealt to its shard and shuffled there.

    ident: what tells rows apart; all columns that can be hashed and ordered unless given.
    """
    cols = docs.columns
    ident = ident or [c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant", "interval"))]
    got = _mixed(docs.withColumn("__sg_words", size), source, "__sg_words", ident, shards, seed)
    out = got.select(*cols, "__sg_h", F.posexplode("__sg_homes").alias("__sg_copy", "__sg_shard"))
    return out.repartition("__sg_shard", F.pmod("__sg_h", F.lit(64))).sortWithinPartitions("__sg_shard", _spread("__sg_h", "__sg_copy")).select(*cols)


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    # The plan and the decisions read sizes three times; texts are split for them once.
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(sized).select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "shards")
