"""Exact Jaccard join of shingle sets, as a join in a metric space by pivots.

The Jaccard distance of two sets is a metric, so the distances of two documents from a pivot
differ by no more than their own. The join works down through regions of the space:

1. **Far documents.** Nearly all documents are at a distance of 1, or close to it, from all others,
   where no pivot tells them apart. A shingle that no other document has is in no intersection: a
   document of n shingles with u such ones is at u / n or more from every other, and leaves the
   join if that is beyond the radius. For this, chunks of texts ask buckets of shingles
   how often each occurs.
2. **Pivots.** The shingles of what remains are ordered by how often they occur. Two documents
   within the radius share one of their first n - need + 1 shingles (need: the smallest
   intersection that a document can have with a partner). Each such shingle names a pivot, the document that
   meets most others, so that a few pivots stand for all shingles of a family, and every document's
   distance from its pivots is measured. Documents within the radius of their pivot are linked with it.
3. **Windows.** A region holds what is left to be joined: documents that no links join with
   their pivot, and those joined ones that are within the radius of one of them by their distance from the pivot.
4. **Voronoi regions.** A region too large for a task draws new pivots from its own documents. A
   document belongs to the cell of its nearest pivot and is replicated to each other one
   that is no further than twice the radius beyond: if x has its home at p and y is within the radius r of x, then
   d(y, p) <= d(x, p) + r <= d(x, q) + r <= d(y, q) + 2r for the home q of y. The cells are joined in the same way,
   without what the new pivots' links have joined. Pivots are drawn from documents that nothing joins with the old
   one; as they are measured against their whole region, all their links are known and they leave it. A region that hardly
   gets smaller by cells draws again as it is.
5. **Leaves.** A region that fits is joined in one task, all sets at once. One that still does not, after all draws, holds
   documents that are all about as far from each other as from their pivots, which distances cannot split: what
   no pivot joined is sought by the differences from the pivot (`probminhash.differences`, exact).

Only links that join components are kept, so no step emits all pairs of a region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_bytes
from .components import components, contract
from .probminhash import differences
from .repeats import MESSAGE, blocks, messages, pack, split_by, unpack
from .sql import SPLIT
from .textunits import Words, shingles

WORDS, PERCENT = 3, 90
#: Text in a chunk, and so about what a bucket of shingles gets.
CHUNK_BYTES = 4_000_000
#: Documents and shingles of a region that one task joins (it holds a number for each pair of them, about 100 MB at most).
LEAF, LEAF_SHINGLES = 2048, 1_000_000
#: Pivots that a large region draws at a time, and how often regions draw.
PIVOTS, ROUNDS = 32, 4
#: Shingles of a leaf that are compared at a time.
STRIPE = 4096
#: Slack of comparisons in floating point; it only keeps more documents.
SLACK = 1e-9


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of a set of n with a partner, as the union has n elements at least."""
    return -(-percent * n // 100)


class Sets:
    """The distinct shingles of some texts: doc (index), h, n (by text)."""

    def __init__(self, texts: list[bytes], k: int):
        parts = [(at, shingles(Words(some, lower=True), k)) for at, some in blocks(texts)]
        doc = np.concatenate([np.zeros(0, np.int64), *(d + at for at, (d, _) in parts)])
        h = np.concatenate([np.zeros(0, np.uint64), *(h for _, (_, h) in parts)])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        self.doc, self.h = doc[new], h[new]
        self.n = np.bincount(self.doc, minlength=len(texts))

    def asked(self, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, which, count): bucket and class (upper half of the hash) of all shingles, sorted; each shingle's place among them; how often each occurs."""
        return np.unique((self.h % np.uint64(n_buckets)) << np.uint64(32) | self.h >> np.uint64(32), return_inverse=True, return_counts=True)


def _leads(rows: pa.Table, keys: set[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Keys and texts of a chunk that it answers for, each distinct text once."""
    found = {}
    for key, text in zip(rows.column("text_key").to_pylist(), rows.column("t").cast(pa.binary()), strict=True):
        if key in keys and key not in found:
            found[key] = text.as_py() or b""
    return sorted(found), [found[k] for k in sorted(found)]


def _announce(n: int, k: int) -> Callable:
    def run(key: tuple, rows: pa.Table, leads: pa.Table) -> pa.Table:
        if not rows.num_rows or not leads.num_rows:
            return messages([])
        _, texts = _leads(rows, set(leads.column("msg").to_pylist()))
        keys, _, count = Sets(texts, k).asked(n)
        some = split_by((keys >> np.uint64(32)).astype(np.int64))
        return messages([(d, key[0].as_py(), pack(0, keys[i].astype(np.uint32), np.minimum(count[i], 255).astype(np.uint8))) for d, i in some])

    return run


def _answer(key: tuple, rows: pa.Table) -> pa.Table:
    """How often each class of shingles occurs, in the order asked: 0 for once, else a number that grows with it."""
    got = [unpack(m.as_py()) for m in rows.column("msg")]
    every, count = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
    _, which = np.unique(every, return_inverse=True)
    total = np.bincount(which, weights=count)
    code = np.where(total > 1, np.minimum(1 + np.floor(4 * np.log2(np.maximum(total, 2))), 255), 0).astype(np.uint8)[which]
    at = np.cumsum([0, *(len(g[1]) for g in got)])
    return messages([(o, key[0].as_py(), pack(0, code[a:b])) for o, a, b in zip(rows.column("origin").to_pylist(), at[:-1], at[1:], strict=True)])


def _keep(n: int, k: int, percent: int) -> Callable:
    """Of each text the number of shingles and, unless it is far from all others, those that others have, rare ones first."""
    kinds = [("text_key", pa.binary()), ("n", pa.int64()), ("n_keys", pa.int32()), ("s", pa.list_(pa.int64()))]

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        origin, msgs = told.column("origin").to_pylist(), told.column("msg").to_pylist()
        ids, texts = _leads(rows, {m for o, m in zip(origin, msgs, strict=True) if o < 0}) if rows.num_rows else ([], [])
        if not ids:
            return pa.table({c: pa.array([], kind) for c, kind in kinds})
        sets = Sets(texts, k)
        keys, which, _ = sets.asked(n)
        replies = {o: unpack(m)[1] for o, m in zip(origin, msgs, strict=True) if o >= 0}
        code = np.concatenate([np.zeros(0, np.uint8), *(replies[d] for d in sorted(replies))])[which]
        alone = np.bincount(sets.doc, weights=code == 0, minlength=len(ids)).astype(np.int64)
        first = sets.n - need(sets.n, percent) + 1
        near = (sets.n > 0) & (alone < first)
        shared = (code > 0) & near[sets.doc]
        doc, h, code = sets.doc[shared], sets.h[shared], code[shared]
        order = np.lexsort((h, code, doc))
        edge = np.searchsorted(doc[order], np.arange(len(ids) + 1))
        listed = [h[order[a:b]].view(np.int64) if ok else None for a, b, ok in zip(edge[:-1], edge[1:], near, strict=True)]
        values = (ids, sets.n, (first - alone).astype(np.int32), listed)
        return pa.table({c: pa.array(v, kind) for (c, kind), v in zip(kinds, values, strict=True)})

    return run


def _sets(docs: DataFrame, ident: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, text_key) of all rows, and one row (text_key, first, n, n_keys, s) for each distinct text; first: (no id, smallest id); s is null for far texts."""
    n = int(max(1, -(-text_bytes(docs, text) // CHUNK_BYTES)))
    found = docs.select(F.col(ident).alias("id"), _text_key(F.col(text)).alias("text_key"))
    lead = cut(found.groupBy("text_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"))).alias("first")))
    dest = lambda i: F.pmod(F.xxhash64(i, "text_key"), F.lit(n)).cast("int").alias("dest")
    rows = docs.select(F.col(ident).alias("id"), _text_key(F.col(text)).alias("text_key"), F.col(text).alias("t")).select(dest("id"), "text_key", "t")
    leads = lead.select(dest(F.col("first.id")), F.lit(-1).alias("origin"), F.col("text_key").alias("msg"))
    chunks = rows.groupBy("dest")
    asked = chunks.cogroup(leads.groupBy("dest")).applyInArrow(_announce(n, k), MESSAGE)
    told = asked.groupBy("dest").applyInArrow(_answer, MESSAGE).unionByName(leads)
    sets = chunks.cogroup(told.groupBy("dest")).applyInArrow(_keep(n, k, percent), "text_key binary, n long, n_keys int, s array<long>")
    return found, cut(lead.join(sets, "text_key"))


def _measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (uid, pid, ...) with n, the shingles of uid, d, their distance, and linked."""
    both = pairs.join(sets.select("uid", F.col("n").alias("na"), F.col("s").alias("sa")), "uid").join(sets.select(F.col("uid").alias("pid"), F.col("n").alias("nb"), F.col("s").alias("sb")), "pid")
    got = both.select(*pairs.columns, F.col("na").alias("n"), (F.col("na") + F.col("nb")).alias("both"), F.when(F.col("uid") == F.col("pid"), F.col("na")).otherwise(F.size(F.array_intersect("sa", "sb"))).alias("shared"))
    every = F.col("both") - F.col("shared")
    return got.select(*pairs.columns, "n", (1 - F.col("shared") / every).alias("d"), (100 * F.col("shared") >= percent * every).alias("linked"))


def _open(placed: DataFrame, labels: DataFrame, radius: float) -> DataFrame:
    """Of placed (rid, uid, pid, n, d, ...) what is still to be joined, with label, joined (same label as the pivot), and the region's count and shingles.

    A document with another label than the pivot's is apart from it. All pairs with different labels hold such a one, so a
    joined document matters only if an apart one is within the radius of it by their distances from the pivot.
    """
    named = labels.select(F.col("node").alias("uid"), "label")
    known = placed.drop("label", "joined", "count", "shingles").join(named, "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    known = known.join(named.select(F.col("uid").alias("pid"), F.col("label").alias("of_pivot")), "pid", "left")
    known = cut(known.withColumn("joined", F.col("label") == F.coalesce("of_pivot", "pid")).drop("of_pivot"))
    ends = known.groupBy("rid").agg(F.min(F.when(~F.col("joined"), F.col("d"))).alias("near"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi AND near IS NOT NULL")
    kept = cut(known.join(ends.select("rid", "near"), "rid").where(~F.col("joined") | (F.col("d") >= F.col("near") - radius - SLACK)).drop("near"))
    size = kept.groupBy("rid").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles")).where("count > 1")
    return cut(kept.join(size, "rid"))


def _drawn(regions: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """(parent, uid, pid, n, d, linked): the distances of all documents of a region from new pivots, some of those that are apart from the old one."""
    order = F.xxhash64("uid", F.lit(turn))
    pivots = regions.where("NOT joined").groupBy("rid", F.pmod(order, F.lit(PIVOTS)).alias("part")).agg(F.min(F.struct(order.alias("o"), F.col("uid"))).alias("p"))
    pivots = pivots.select(F.col("rid").alias("parent"), F.col("p.uid").alias("pid"))
    return cut(_measured(regions.select(F.col("rid").alias("parent"), "uid").join(pivots, "parent"), sets, percent))


def _cells(measured: DataFrame, radius: float) -> DataFrame:
    """(rid, parent, uid, pid, n, d): the Voronoi cells of the pivots with their windows, without the pivots."""
    home, drawn = F.min("d").over(Window.partitionBy("parent", "uid")), F.max(F.col("uid") == F.col("pid")).over(Window.partitionBy("parent", "uid"))
    near = measured.withColumns({"home": home, "drawn": drawn}).where(~F.col("drawn") & (F.col("d") <= F.col("home") + 2 * radius + SLACK))
    return near.select(F.xxhash64("parent", "pid").alias("rid"), "parent", "uid", "pid", "n", "d")


def _leaf_links(leaves: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) that join all linked documents of each region, joined in one task."""

    def join(rows: pa.Table) -> pa.Table:
        uid, label, n = (rows.column(c).to_numpy() for c in ("uid", "label", "n"))
        doc = np.repeat(np.arange(len(n)), [len(x) for x in rows.column("s")])
        h = np.concatenate([np.asarray(c.flatten()) for c in rows.column("s").chunks])
        _, which, times = np.unique(h, return_inverse=True, return_counts=True)
        place = np.cumsum(times > 1) - 1  # what one document alone has is in no intersection
        doc, which = doc[times[which] > 1], place[which[times[which] > 1]]
        order = np.argsort(which, kind="stable")
        doc, which = doc[order], which[order]
        shared = np.zeros((len(n), len(n)), np.float64)
        for start in range(0, int(which[-1]) + 1 if len(which) else 0, STRIPE):
            a, b = np.searchsorted(which, (start, start + STRIPE))
            has = np.zeros((len(n), STRIPE), np.float32)
            has[doc[a:b], which[a:b] - start] = 1.0
            shared += has @ has.T
        close = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
        i, j = np.nonzero(np.triu(close & (label[:, None] != label[None, :]), 1))
        node, root = contract(uid[i], uid[j]) if len(i) else (uid[:0], uid[:0])
        return pa.table({"u": pa.array(node, pa.int64()), "v": pa.array(root, pa.int64())})

    full = leaves.select("rid", "uid", "label").join(sets.select("uid", "n", "s"), "uid")
    return full.groupBy("rid").applyInArrow(join, "u long, v long")


def _links(near: DataFrame, percent: int) -> DataFrame:
    """(u, v) that join all linked texts of near (uid, n, n_keys, s)."""
    radius = 1 - percent / 100
    sets = near.select("uid", "n", "s")
    keys = near.select("uid", F.explode(F.slice("s", F.lit(1), F.col("n_keys"))).alias("h"))
    often = cut(keys.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    members = cut(keys.join(often, "h").withColumn("degree", F.sum("k").over(Window.partitionBy("uid"))).drop("k"))
    named = cut(members.groupBy("h").agg(F.max(F.struct("degree", (-F.col("uid")).alias("minus"))).alias("top")).select("h", (-F.col("top.minus")).alias("pid")))
    star = members.join(named, "h").select(F.col("pid").alias("rid"), "uid", "pid").distinct()
    placed = cut(_measured(star, sets, percent))
    linked = lambda df: df.where("linked AND uid <> pid").select(F.col("uid").alias("u"), F.col("pid").alias("v"))
    links = [linked(placed)]
    labels = components(links[0])

    fits = (F.col("count") <= 2) | (F.col("count") <= LEAF) & (F.col("shingles") <= LEAF_SHINGLES)
    now = _open(placed.select("rid", "uid", "pid", "n", "d"), labels, radius)
    leaves, regions = [now.where(fits)], now.where(~fits)
    for turn in range(ROUNDS):
        if regions.isEmpty():
            break
        measured = _drawn(regions, sets, percent, turn)
        links.append(linked(measured).distinct())
        # What new pivots link is joined from now on, in all regions.
        labels = components(cut(labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(links[-1])))
        drawn = measured.where("uid = pid").select(F.col("parent").alias("rid"), "uid")
        whole = _open(regions.join(drawn, ["rid", "uid"], "left_anti"), labels, radius)
        cells = _open(_cells(measured, radius), labels, radius)
        # Where a cell is hardly smaller than its region, distances do not split it: the region stays as it is and draws other pivots.
        before = whole.select(F.col("rid").alias("parent"), F.col("count").alias("all")).distinct()
        largest = cells.groupBy("parent").agg(F.max("count").alias("most"))  # none open: nothing is left of the region
        split = cut(before.join(largest, "parent", "left").where("4 * coalesce(most, 0) <= 3 * all").select("parent"))
        kept = whole.join(split.select(F.col("parent").alias("rid")), "rid", "left_anti")
        now = cut(cells.join(split, "parent", "left_semi").drop("parent").unionByName(kept))
        leaves.append(now.where(fits))
        regions = now.where(~fits)
    for some in leaves:
        links.append(_leaf_links(some, sets, percent))
    if not regions.isEmpty():
        hubs = regions.select("uid", F.col("pid").alias("hub"), F.col("joined").alias("linked"), "label").distinct()
        links.append(linked(_measured(differences(hubs, sets, percent / 100).select(F.col("a").alias("uid"), F.col("b").alias("pid")), sets, percent)))
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = root = np.zeros(0, np.int64)
        for b in batches:
            node, root = contract(*(np.concatenate([x, b.column(c).to_numpy(zero_copy_only=False)]) for x, c in ((node, 0), (root, 1))))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    return cut(every.mapInArrow(contracted, "u long, v long"))


def jaccard_components(docs: DataFrame, ident: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: ident, ``n_shingles`` and ``component_id``, the smallest ident that links lead to.

    Two texts are linked if percent (1 to 100) of all their distinct runs of k words are in both; letters A to Z
    count as a to z. A text of fewer words is one run. Null, empty and blank texts have none: they
    are linked with nothing, not even with each other, and stand for themselves. Rows are judged by their own texts: equal
    texts are linked, rows may repeat and ids be shared or null. A component in which no row has an ident has none.
    """
    found, texts = _sets(docs, ident, text, k, percent)
    near = cut(texts.where(F.col("s").isNotNull()).select("text_key", "first", "n", "n_keys", "s")).withColumn("uid", F.monotonically_increasing_id())
    labels = components(_links(near, percent))
    label = near.select("text_key", "first", "uid").join(labels, F.col("uid") == labels["node"], "left").select("text_key", "first", F.coalesce("label", "uid").alias("label"))
    label = cut(label)
    lead = label.groupBy("label").agg(F.min("first").alias("lead"))
    lead = label.join(lead, "label").select("text_key", F.col("lead.id").alias("lead"))
    got = texts.select("text_key", "n", F.col("first.id").alias("own")).join(lead, "text_key", "left")
    every = found.join(got.select("text_key", "n", F.coalesce("lead", "own").alias("component")), "text_key")
    return every.select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of links of 90 % of all runs of three words."""
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_OP11 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, md5(coalesce(text, '')) AS k, {SPLIT} AS w FROM docs),
reps AS (SELECT k, min(doc_id) AS id FROM d WHERE len(w) > 0 GROUP BY k),
t AS (SELECT doc_id AS id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d WHERE doc_id IN (SELECT id FROM reps)),
g AS (SELECT id, i, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o) AS s FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
s AS (SELECT DISTINCT id, s FROM g WHERE i + 2 <= n OR (n < 3 AND i = 1)),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 100 * p.n >= 90 * (x.n + y.n - p.n)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS root FROM reps UNION SELECT two.b, r.root FROM r JOIN two ON two.a = r.id),
l AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN reps USING (k) LEFT JOIN c ON c.id = reps.id LEFT JOIN l ON l.id = reps.id
"""
