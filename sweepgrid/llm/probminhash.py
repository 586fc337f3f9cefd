"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Each shingle of a text is a Poisson process with a rate that is its weight (1 + ln of its
count): its arrivals hit random registers, and a register keeps the shingle that came
first. A shingle stops as soon as its next arrival is later than every register of its
text, so long texts cost little more than one arrival a shingle. Registers of two texts
agree with the probability Jaccard similarity; bands of registers find candidates, and
candidates are verified by the exact Jaccard similarity of their shingle sets. A text that
repeats shingles is also sketched with all weights 1, in the same bands, so that repeats do
not hide a pair whose sets are similar.

No bucket is ever compared with itself. The members of a bucket are compared with its hub
alone; what the hubs leave apart is searched by the members' differences from their hub,
which two similar texts of different classes must share (see `differences`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mix64, sub_batches, table
from .components import components
from .textunits import Words, shingles

WORDS, THRESHOLD = 5, 0.8
#: At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8**4)**20 = 3e-5.
BANDS, ROWS = 20, 4
BATCH_BYTES = 1_000_000
#: Slack of comparisons in floating point; it only lets more candidates through.
SLACK = 1e-6


def prob_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m registers (uint32 parts of the winning keys) of elements (doc, key, weight)."""
    reg = np.full(n_docs * m, np.iinfo(np.uint64).max, np.uint64)
    time, last = np.zeros(len(key)), np.full(n_docs, np.inf)
    tag = key & np.uint64(0xFFFFFFFF)
    r = 0
    while len(key):
        r += 1
        u = mix64(key + np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((u >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / weight
        on = time < last[doc]
        doc, key, weight, time, tag, u = doc[on], key[on], weight[on], time[on], tag[on], u[on]
        at = doc * m + (mix64(u ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(reg, at, time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | tag)
        top = reg.reshape(n_docs, m).max(axis=1)
        full = top != np.iinfo(np.uint64).max
        # Rounded up by one unit in the last place: no arrival is left out for the rounding of a register.
        last[full] = ((top[full] >> np.uint64(32)).astype(np.uint32) + np.uint32(1)).view(np.float32)
    return (reg & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, m)


def _bands(reg: np.ndarray, bands: int, rows: int) -> np.ndarray:
    reg = reg.astype(np.uint64).reshape(len(reg), bands, rows)
    out = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(reg), 1))  # a band's number is part of its hash
    for j in range(rows):
        out = mix64(out ^ reg[:, :, j] + np.uint64((j + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
    return out.view(np.int64)


def sketch(texts: list[bytes], bands: int = BANDS, rows: int = ROWS, k: int = WORDS) -> list[np.ndarray | None]:
    """The band hashes of each text: those by weights, then those by weights of 1 if some shingle is repeated; None without words."""
    words = Words(texts)
    doc, h = shingles(words, k)
    order = np.argsort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(h)))
    doc, h = doc[new], h[new]
    out = _bands(prob_minhash(doc, h, 1.0 + np.log(np.maximum(count, 1)), len(texts), bands * rows), bands, rows)
    # Equal weights give the same registers as weights of 1.
    repeats = np.zeros(len(texts), bool)
    repeats[doc[count > 1]] = True
    also, number = repeats[doc], np.cumsum(repeats) - 1
    plain = _bands(prob_minhash(number[doc[also]], h[also], np.ones(int(also.sum())), int(repeats.sum()), bands * rows), bands, rows)
    some = np.diff(words.first) > 0
    return [None if not some[i] else np.unique(np.concatenate([out[i], plain[number[i]]])) if repeats[i] else out[i] for i in range(len(texts))]


def _column(batch: pa.RecordBatch, k: int) -> Iterator[bytes | None]:
    return (x.as_buffer().to_pybytes() if x.is_valid else None for x in batch.column(k))


def _in_groups(batches: Iterator[pa.RecordBatch], make, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text bytes) as (key, *make(texts)), a few megabytes of text at a time."""
    for batch in batches:
        done = 0
        for some in sub_batches(range(batch.num_rows), _column(batch, 1), BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(some)), *make([t for _, t in some])], names=names)
            done += len(some)


def _sketches(docs: DataFrame, ident: str, text: str) -> DataFrame:
    def make(texts: list[bytes]) -> list[pa.Array]:
        keys = pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts], pa.binary())
        return [keys, pa.array(sketch(texts), pa.list_(pa.int64()))]

    kind = dict(docs.dtypes)[ident]
    return docs.select(F.col(ident).alias("id"), F.col(text).alias("t")).mapInArrow(lambda b: _in_groups(b, make, ["id", "text_key", "bands"]), f"id {kind}, text_key binary, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(uid, t) -> (uid, s): distinct shingle hashes."""

    def make(texts: list[bytes]) -> list[pa.Array]:
        doc, h = shingles(Words(texts), WORDS)
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [pa.array([np.unique(h[a:b]).view(np.int64) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.list_(pa.int64()))]

    return texts.mapInArrow(lambda b: _in_groups(b, make, ["uid", "s"]), "uid long, s array<long>")


def _text_key(text: Column) -> Column:
    """As `_sketches` has it: a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def paired(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the sets sa and sb; b may be one hot key, and skewed joins are split on either side."""
    right = pairs.join(sets.select(F.col("uid").alias(a), F.col("s").alias("sa")), a)
    return right.join(sets.select(F.col("uid").alias(b), F.col("s").alias("sb")), b)


def _similar(threshold: float) -> Column:
    shared = F.size(F.array_intersect("sa", "sb"))
    return shared >= F.lit(threshold) * (F.size("sa") + F.size("sb") - shared)


def differences(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts with one hub and different labels, among them all that reach the threshold.

    placed: (uid, hub, linked, label). With c = (1 - t) / (1 + t), sets are similar if their
    symmetric difference has at most c * (|a| + |b|) elements. Let D be a set's symmetric
    difference from its hub's set and e = |D| - c * |set|. Then a and b are similar just if
    2 * |Da & Db| >= ea + eb, and a is linked with its hub just if ea <= c * |hub|. As e is at least
    -c * |hub|, the sum is positive unless both are linked, when their labels are equal. So a pair that
    is sought shares an element of its differences; and the first one that it shares, in any
    order, leaves each of the two so many elements that 2 * (|D| - place) - e reaches the other's e. The
    order is by the number of texts of the hub that have the element, rare ones first, so
    that what a whole family has in common is hardly ever looked at.
    """
    c = (1 - threshold) / (1 + threshold)
    both = paired(placed, sets, "uid", "hub")
    found = both.select("uid", "hub", "linked", "label", (F.size("sa") * F.lit(c)).alias("own"), (F.size("sb") * F.lit(c)).alias("far"), F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa")).alias("d"))
    found = cut(found)
    named = found.select("uid", "hub", "linked", "label", F.size("d").alias("n"), (F.size("d") - F.col("own")).alias("e"), "far", F.explode("d").alias("x"))
    often = cut(named.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    # Elements of one text alone come first in the order and meet nothing: only their number counts.
    listed = named.join(often, ["hub", "x"]).groupBy("uid", "hub", "linked", "label", "n", "e", "far").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("xs"))
    first = listed.select("uid", "hub", "linked", "label", "e", "far", (F.col("n") - F.size("xs")).alias("alone"), "n", F.posexplode("xs").alias("i", "y"))
    first = first.withColumn("reach", 2 * (F.col("n") - F.col("alone") - F.col("i")) - F.col("e") + SLACK)
    # A linked text only seeks others that are not.
    first = cut(first.where(F.col("reach") >= F.when(F.col("linked"), F.col("far")).otherwise(-F.col("far"))).select("uid", "hub", "linked", "label", "e", "reach", F.col("y.x").alias("x")))
    apart = ~F.col("linked")
    ends = first.groupBy("hub", "x").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("e").alias("e_all"), F.max("reach").alias("r_all"),
        F.min(F.when(apart, F.col("e"))).alias("e_apart"), F.max(F.when(apart, F.col("reach"))).alias("r_apart"),
    ).where("lo <> hi AND e_apart IS NOT NULL")
    near = first.join(cut(ends.drop("lo", "hi")), ["hub", "x"])
    near = near.where(F.when(F.col("linked"), (F.col("reach") >= F.col("e_apart")) & (F.col("e") <= F.col("r_apart"))).otherwise((F.col("reach") >= F.col("e_all")) & (F.col("e") <= F.col("r_all"))))
    near = cut(near.select("uid", "hub", "linked", "label", "e", "reach", "x"))
    other = near.select("hub", "x", F.col("uid").alias("b"), F.col("linked").alias("linked_b"), F.col("label").alias("label_b"), F.col("e").alias("e_b"), F.col("reach").alias("reach_b"))
    one_way = F.col("linked_b") | (F.col("uid") < F.col("b"))
    met = near.where(apart).join(other, ["hub", "x"]).where(one_way & (F.col("label") != F.col("label_b")) & (F.col("e_b") <= F.col("reach")) & (F.col("e") <= F.col("reach_b")))
    return met.select(F.col("uid").alias("a"), "b").distinct()


def _classes(docs: DataFrame, ident: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, text_key) of every row, and (text_key, label, n_copies, first) of every distinct text; first: (id is null, id, text_key)."""
    found = cut(_sketches(docs, ident, text))
    # One representative per distinct text, numbered once it is written, before anything is compared.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_key"))).alias("first")
    reps = cut(found.groupBy("text_key").agg(F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"), first))
    reps = reps.withColumn("uid", F.monotonically_increasing_id())
    rows = reps.select("uid", F.explode("bands").alias("h"))
    shared = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # The text that meets most others in all its bands is the hub that a bucket's texts are compared with.
    members = cut(rows.join(shared, "h").withColumn("degree", F.sum("n").over(Window.partitionBy("uid"))).drop("n"))
    hubs = cut(members.groupBy("h").agg(F.max(F.struct("degree", (-F.col("uid")).alias("minus"))).alias("top")).select("h", (-F.col("top.minus")).alias("hub")))
    star = cut(members.join(hubs, "h").select("uid", "hub").distinct())
    needed = star.where("uid <> hub").select("uid").union(star.select("hub")).distinct().join(reps.select("uid", "text_key", "first.id"), "uid")
    texts = docs.select(F.col(ident).alias("__id"), F.col(text).alias("t"), _text_key(F.col(text)).alias("text_key")).join(needed, ["text_key"]).where(F.col("__id").eqNullSafe(F.col("id")))
    sets = cut(_sets(texts.select("uid", "t")).dropDuplicates(["uid"]))
    links = cut(paired(star.where("uid <> hub"), sets, "uid", "hub").select("uid", "hub", _similar(threshold).alias("linked")))
    labels = components(links.where("linked").select("uid", "hub"))
    placed = cut(links.join(labels, links["uid"] == labels["node"], "left").select("uid", "hub", "linked", F.coalesce("label", "uid").alias("label")))
    mixed = placed.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_and("linked").alias("all")).where("lo <> hi AND NOT all")
    open_ = cut(placed.join(mixed.select("hub"), "hub", "left_semi"))
    if not open_.isEmpty():
        more = paired(differences(open_, sets, threshold), sets, "a", "b").where(_similar(threshold)).select("a", "b")
        of = placed.select("uid", "label").distinct()
        more = more.join(of.select(F.col("uid").alias("a"), F.col("label").alias("u")), "a").join(of.select(F.col("uid").alias("b"), F.col("label").alias("v")), "b").select("u", "v").distinct()
        joined = components(cut(more)).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(joined.select(F.col("label").alias("node"), F.col("to").alias("label")))
        labels = labels.groupBy("node").agg(F.min("label").alias("label"))
    classes = reps.join(labels, reps["uid"] == labels["node"], "left").select("text_key", F.coalesce("label", "uid").alias("label"), "n_copies", "first")
    return found.select("id", "text_key"), classes


def near_duplicate_classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: ident, ``class_id`` (the smallest id of its class) and ``n_copies`` (rows with this very text).

    Texts are in one class if they are equal or linked by verified pairs. A null text counts
    as empty; texts without words are only linked to equal ones. Rows are judged by their own
    texts: ids may be of any type that has an order, be null or repeat. A class in which no row
    has an id has a null class_id.
    """
    found, classes = _classes(docs, ident, text, threshold)
    named = classes.groupBy("label").agg(F.min("first").alias("lead")).select("label", F.col("lead.id").alias("class_id"))
    got = classes.select("text_key", "label", "n_copies").join(named, "label")
    return found.join(got, "text_key").select(F.col("id").alias(ident), "class_id", F.col("n_copies").cast("long"))


def distinct_rows(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with the columns of docs: that with the smallest id, of several such ids the text with the smallest MD5.

    A row without an id stays only if its class has no row with one. Rows that share id and
    text are copies, of which any one stays.
    """
    _, classes = _classes(docs, ident, text, threshold)
    lead = classes.groupBy("label").agg(F.min("first").alias("lead")).select(F.col("lead.id").alias("__sg_id"), F.col("lead.text_key").alias("__sg_lead"))
    lead = cut(lead)
    keyed = docs.withColumn("__sg_key", _text_key(F.col(text)))
    kept = keyed.join(lead, (keyed["__sg_key"] == lead["__sg_lead"]) & keyed[ident].eqNullSafe(lead["__sg_id"]), "left_semi")
    return kept.dropDuplicates(["__sg_key"]).drop("__sg_key")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near-duplicates."""
    got = near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return got.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_first"), "n_copies")
