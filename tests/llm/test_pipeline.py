"""The pipeline's stages on hard rows, and the whole of it."""

from collections import Counter, defaultdict

import corpus_pipeline
from sweepgrid.llm import decontam, fertility, probminhash
from sweepgrid.llm.queries import ORACLE, QUERIES

from .test_operators import brute_classes, empty, hard, hard_rows, shingle_set  # noqa: F401


def test_stages_keep_columns(spark, sf_dir, hard, empty):  # noqa: F811
    """Rows leave a stage as they came in, those whose columns bear the operators' own names too."""
    clash = {"source_size": "long", "target": "string", "copies": "int", "shards": "array<int>", "linked": "int", "uid": "string", "item": "string", "key": "binary", "n_item": "int"}
    values = {"source_size": "7L", "target": "'MINE'", "copies": "9", "shards": "array(4, 5)", "linked": "3", "uid": "'u'", "item": "'i'", "key": "X'00'", "n_item": "2"}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (hard, empty):
            docs = docs.selectExpr("*", *(f"CAST({values[c]} AS {kind}) AS `{c}`" for c, kind in clash.items() if c not in docs.columns))
            got = stage(spark, docs, sf_dir)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert got.dtypes == docs.dtypes
            else:
                assert {"shard", "slot"} <= set(got.columns)
                got, docs = got.drop("shard", "slot"), docs.drop("shard", "slot")
                assert got.count() == docs.count()
            came = {repr(sorted(r.asDict().items())) for r in docs.collect()}
            assert {repr(sorted(r.asDict().items())) for r in got.collect()} <= came


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in fertility.quality(docs).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    classes = brute_classes([(i, texts[i]) for i in kept])
    first = set(classes.values())
    leaks = {r["doc_id"] for r in decontam.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in got}
    assert ids <= first - leaks
    times, slots = defaultdict(int), defaultdict(list)
    for r in got:
        times[r["doc_id"]] += 1
        slots[r["shard"]].append(r["slot"])
    assert max(times.values()) <= 3
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_duplicate_stage_keeps_the_smallest(spark, hard):  # noqa: F811
    want = brute_classes([r[:2] for r in hard_rows() if r[0] is not None])
    got = [r["doc_id"] for r in probminhash.distinct_rows(hard).collect()]
    assert sorted(got) == sorted(set(want.values()))


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(ORACLE) <= set(QUERIES)


def linked_pairs(texts):
    """All pairs of distinct texts whose sets of five-word shingles have a similarity of 0.8 or more, by an index of all shingles."""
    holders, pairs, sets = defaultdict(list), set(), {}
    for t in sorted(texts):
        sets[t] = shingle_set(t)
        shared = Counter(u for x in sets[t] for u in holders[x])
        pairs |= {(u, t) for u, n in shared.items() if n >= 0.8 * (len(sets[t]) + len(sets[u]) - n)}
        for x in sets[t]:
            holders[x].append(t)
    return pairs


def test_near_duplicates_find_all_pairs(spark):
    """Every link of the whole table at sf0.01 lies inside a class, and classes are no larger than links make them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicate_classes(docs).collect()}
    of = {texts[i]: c for i, c in got.items()}
    pairs = linked_pairs(set(texts.values()))
    assert pairs and all(of[a] == of[b] for a, b in pairs)
    classes = len(set(of.values()))
    parent = {t: t for t in of}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in pairs:
        parent[find(a)] = find(b)
    assert classes == len({find(t) for t in of})
