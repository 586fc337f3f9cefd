"""The training-data operators against brute force, and on hard rows: nulls, empty and very long texts, ties, repeats,
empty tables, and columns whose names clash with the operators' own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepgrid.llm import common, ctxmix, decontam, fertility, fim, metricjoin, mixing, probminhash, repeats, shards, substr_tree, suffixsort, textunits, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, kept string, doc string, t string, h string, band string, copies int, n_words string"


def hard_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé漢") for _ in range(rnd.randint(1, 7)))
    prose = [" ".join(word() for _ in range(rnd.randint(1, 120))) for _ in range(25)]
    passage = " ".join(word() for _ in range(60))
    # The Thue-Morse word over a and b and its complement: equal under any polynomial hash modulo 2**64.
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    around = [word() for _ in range(20)]
    steered = [" ".join([*around[:10], w, *around[10:]]) for w in (thue, thue.translate(str.maketrans("ab", "ba")))]
    texts = [None, "", " ", "\n\t \x0b", "one", "a b c d", *prose, *prose[:5], prose[6] + " tail", passage, passage + " x", "y " + passage + "\nz\tz", "ab " * 20_000, "x" * 50_000, "Zeile\nZeile\n\nZeile", "<|endoftext|> it's 12 %%% ##", passage, *steered]
    rows = [(i, t, rnd.choice(["en", "de", None, "xx"]), rnd.choice(["s1", "s2", None, "é"]), None) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, prose[3], None, None, 5), (None, None, None, None, None)]
    return [(*r, None, "s", "k", "d", "t", "h", "b", 7, "w") for r in rows]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def by_id(frame, *cols):
    return sorted((repr(r["doc_id"]), *(r[c] for c in cols)) for r in frame.collect())


def test_tokens_match_the_library(spark, hard, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((repr(r[0]), len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in hard_rows())
    got = tokens.count_tokens(hard)
    assert by_id(got, "n_bytes", "n_tokens") == want
    assert got.where("over_limit <> (n_tokens > 1024)").count() == 0
    assert tokens.count_tokens(empty).count() == 0


@pytest.mark.parametrize("run", ["aaaaaaa", "abababab", "    ", "!!!!!!??", "ééé", "0000000000"])
def test_overlapping_merges(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, count = Tokenizer.from_file(path), tokens.token_counter(path)
    for n in range(1, 40):
        assert count([run * n]) == [len(lib.encode(run * n, add_special_tokens=False).ids)]


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import public_tokenizers

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}):
        p = tmp_path / "v.json"
        p.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="vocabulary"):
            tokens.Merges(str(p))


def brute_words(rows, window=20):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode())):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((repr(d), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot,chunk", [(4000, 8_000_000), (2, 20_000)])
def test_word_repeats(spark, hard, empty, hot, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    got = substr_tree.remove_repeated_words(hard, hot=hot)
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == brute_words([r[:2] for r in hard_rows()])
    assert substr_tree.remove_repeated_words(empty).count() == 0


def brute_bytes(rows, window=200):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        step = np.zeros(len(t) + 1, int)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                step[i] += 1
                step[i + window] -= 1
        gone = np.cumsum(step)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((repr(d), len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot,chunk", [(4000, 8_000_000), (2, 20_000)])
def test_byte_repeats(spark, hard, empty, hot, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    got = suffixsort.remove_repeated_bytes(hard, hot=hot)
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes([r[:2] for r in hard_rows()])
    assert suffixsort.remove_repeated_bytes(empty).count() == 0


def test_suffix_sort_is_a_sort():
    rnd = random.Random(3)
    data = bytes(rnd.choice(b"ab") for _ in range(400))
    start = np.array([rnd.randrange(300) for _ in range(120)])
    length = np.array([rnd.randrange(1, 100) for _ in range(120)])
    group = np.array([rnd.randrange(4) for _ in range(120)])
    order = suffixsort.Suffixes(data, start, length).sort(group)
    keys = [(group[i], data[start[i] : start[i] + length[i]]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(120))


def test_results_survive_collisions(monkeypatch):
    """With hashes that nearly always collide, words and suffixes are told apart by their content."""
    weak = suffixsort.Suffixes.hash
    monkeypatch.setattr(suffixsort.Suffixes, "hash", lambda self, at, n: weak(self, at, n) & np.uint64(1))
    rnd = random.Random(9)
    data = bytes(rnd.choice(b"ab") for _ in range(300))
    start, length = np.arange(0, 200), np.full(200, 60)
    order, common = suffixsort.Suffixes(data, start, length).sorted_and_common(np.zeros(200, np.int64))
    texts = [data[i : i + 60] for i in order]
    assert texts == sorted(texts)
    assert common[1:].tolist() == [next((k for k in range(60) if a[k] != b[k]), 60) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    words_ = textunits.Words([b"aa bb aa cc ddd aa", b"bb  ddd e"])
    words_.h = words_.h & np.uint64(1)
    n = substr_tree.word_numbers(words_).tolist()
    want = ["aa", "bb", "aa", "cc", "ddd", "aa", "bb", "ddd", "e"]
    assert all((n[i] == n[j]) == (want[i] == want[j]) for i in range(9) for j in range(9))


def test_tree_nodes_are_runs_of_words():
    rnd = random.Random(2)
    number = np.array([rnd.randrange(3) for _ in range(300)])
    runs = substr_tree.run_numbers(number, 4)
    at = np.arange(280)
    alive, node = substr_tree.grow(runs, at, np.zeros(280, np.int64), 8, 4)
    kind = {i: tuple(number[i : i + 8]) for i in range(280)}
    many = Counter(kind.values())
    assert sorted(alive.tolist()) == [i for i in range(280) if many[kind[i]] > 1]
    of = dict(zip(alive.tolist(), node.tolist(), strict=True))
    assert all((of[a] == of[b]) == (kind[a] == kind[b]) for a in of for b in of)


def test_collisions_are_cut_short():
    s = suffixsort.Suffixes(b"abcdxabcey", np.array([0, 5]), np.array([5, 5]))
    assert s.checked(np.array([0]), np.array([1]), np.array([5])).tolist() == [3]
    assert s.common(np.array([0]), np.array([1])).tolist() == [3]


def test_scores(spark, hard, empty):
    rows = hard_rows()
    low = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter()
    for r in rows:
        if not held(r[0]):
            count.update(low(r[1]))
            count[b""] += 1
    n, v = sum(count.values()), len(count)
    want = []
    for r in rows:
        w = [*low(r[1]), b""]
        want.append((repr(r[0]), held(r[0]), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)))
    got = ctxmix.score_documents(hard)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got.collect()) == sorted(want)
    assert got.where("score > 0 OR isnan(score)").count() == 0
    assert ctxmix.score_documents(empty).count() == 0


def test_mixing_predicts_better_than_counts(spark, sf_dir):
    got = ctxmix.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base, score = got.where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def test_mixing_step_by_step():
    """Texts of several lengths against plain loops: what is learned holds through the whole text and no further, all weights are gated by context."""
    rng = np.random.default_rng(3)
    t = ctxmix.Tokens([" ".join(f"w{k}" for k in rng.integers(0, 30, n)).encode() for n in (40, 700, 0, 41)])
    logits = lambda bits: rng.normal(0, 1, 1 << bits).astype(np.float16)
    tables = {"node": logits(ctxmix.CLASS_BITS), "ending": logits(ctxmix.ENDING_BITS), "word": logits(ctxmix.WORD_BITS), "known": rng.integers(0, 3, 1 << ctxmix.WORD_BITS).astype(np.uint8)}
    ending, word = (list(ctxmix.bit_slots(t.cls, c, b)) for c, b in ((t.ending, ctxmix.ENDING_BITS), (t.word, ctxmix.WORD_BITS)))
    want = []
    for k in range(len(t.cls)):
        if k == 0 or t.doc[k] != t.doc[k - 1]:
            w, own = defaultdict(lambda: list(ctxmix.START_WEIGHTS)), tables["node"].astype(float)
        p_token = 1.0
        for i in range(ctxmix.CLASS_BITS):
            node, e, c = (1 << i) | int(t.cls[k]) >> (ctxmix.CLASS_BITS - i), ending[i][0][k], word[i][0][k]
            sign = 2.0 * int(ending[i][1][k]) - 1
            v = [float(tables["node"][node]), float(tables["ending"][e]), float(tables["word"][c]), own[node]]
            mine = w[i, int(tables["known"][c])]
            p = 1 / (1 + math.exp(-sign * sum(a * b for a, b in zip(mine, v, strict=True))))
            p_token *= p
            mine[:] = [a + ctxmix.LEARN * sign * (1 - p) * b for a, b in zip(mine, v, strict=True)]
            own[node] += ctxmix.LEARN_OWN * sign / (1 + math.exp(sign * own[node]))
        want.append(math.log10(p_token))
    assert np.allclose(ctxmix.mixed_log10(t, ctxmix.unpacked(tables)), want, atol=1e-2)


def test_words_are_compared_by_content():
    rnd = random.Random(7)
    listed = ["".join(rnd.choice("ab") for _ in range(rnd.choice([1, 2, 7, 8, 9, 15, 16, 17, 30]))) for _ in range(400)] + ["a" * 8, "a" * 9, "a" * 8 + "b", "b"]
    w = textunits.Words([" ".join(listed).encode()])
    other = np.array([rnd.randrange(len(listed)) for _ in listed])
    assert w.as_listed(other).tolist() == [listed[i] == x for i, x in zip(other.tolist(), listed, strict=True)]
    assert w.as_listed(np.arange(len(listed))).all() and textunits.Words([b""]).as_listed(np.zeros(0, np.int64)).tolist() == []


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    """With hashes of three bits, what a chunk asks for and how counts come back are those of the words."""
    hashes = textunits.Words.hashes
    monkeypatch.setattr(textunits.Words, "hashes", lambda self, which=0: hashes(self, which) % np.uint64(8))
    texts = [b"a bb c a dd e f", b"g h a i j bb", b"", b"k l m n o p q r a"]
    ids, n = [1, 2, 3, 4], 3
    h, listed, count = ctxmix._chunk_words(ids, texts)
    train = Counter(w for i, t in zip(ids, texts, strict=True) if not ctxmix.held_out(i) for w in t.split())
    assert dict(zip(listed[:-1], count[:-1].tolist(), strict=True)) == {w: train[w] for t in texts for w in t.split()}
    replies = [(d, repeats.pack(0, count[i].astype(np.uint64))) for d, i in repeats.split_by((common.mix64(h) % np.uint64(n)).astype(np.int64))]
    got = ctxmix._known_counts([(ids, texts, ctxmix.Tokens(texts))], replies, n, ids, texts)[0]
    ends = sum(not ctxmix.held_out(i) for i in ids)
    assert got.tolist() == [c for t in texts for c in [*(train[w] for w in t.split()), ends]]


def test_scores_and_repeats_with_text_ids(spark, hard):
    """Ids that are no numbers are carried as they are; so are rows that share one, or have none."""
    rows = [(None if r[0] is None else f"id{r[0]}", r[1]) for r in hard_rows()]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    scored = ctxmix.score_documents(docs)
    assert sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"])) for r in scored.collect()) == sorted(repr((i, zlib.crc32((i or "").encode()) % 7 == 2, len(words(t)) + 1)) for i, t in rows)
    assert by_id(suffixsort.remove_repeated_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_bytes(rows)
    cut = substr_tree.remove_repeated_words(docs).collect()
    assert sorted(repr((r["doc_id"], r["n_words"])) for r in cut) == sorted(repr((i, len(words(t)))) for i, t in rows)
    assert any(r["n_removed"] for r in cut)  # which copy stays depends on the order of the ids' hashes


def test_class_bits_are_a_distribution():
    """The probabilities of all classes at one place sum to 1."""
    t = ctxmix.Tokens([b"a b c a b c a b"])
    tables = ctxmix.unpacked({"node": np.random.default_rng(0).normal(size=1 << 12).astype(np.float16), "ending": np.zeros(1 << 20, np.float16), "word": np.zeros(1 << 21, np.float16), "known": np.zeros(1 << 21, np.uint8)})
    total = 0.0
    for c in range(0, 1 << 12):
        t.cls[3] = c
        total += 10 ** ctxmix.mixed_log10(t, tables)[3] if c % 64 == 0 else 0
    full = [10 ** ctxmix.mixed_log10(t, tables)[3] for t.cls[3] in range(1 << 12)]
    assert sum(full) == pytest.approx(1, abs=1e-4) and total <= 1


def shingle_set(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_classes(rows):
    rows = [(i, t or "") for i, t in rows if i is not None]
    first, parent = {}, {}
    for i, t in sorted(rows):
        parent.setdefault(i, i)
        first.setdefault(t, i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    sets = {i: shingle_set(t) for t, i in first.items()}
    for i, t in rows:
        union(i, first[t])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                union(a, b)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates(spark, hard, empty):
    got = probminhash.near_duplicate_classes(hard)
    rows = hard_rows()
    want = brute_classes([r[:2] for r in rows if r[0] is not None])
    by_text = {(r[1] or ""): want[r[0]] for r in rows if r[0] is not None}
    # Rows without an id are judged by their texts like all others.
    assert sorted((repr(r["doc_id"]), r["class_id"]) for r in got.collect()) == sorted((repr(r[0]), by_text[r[1] or ""]) for r in rows)
    assert probminhash.near_duplicate_classes(empty).count() == 0
    one = probminhash.distinct_rows(hard)
    assert one.columns == hard.columns
    assert sorted(map(tuple, one.collect()), key=repr) == sorted({r for r in rows if r[0] in want and want[r[0]] == r[0]}, key=repr)


def test_near_duplicates_ids_of_any_kind(spark):
    """Text ids, one id on different texts, and a class without any id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [("x", a), ("x", b), ("y", b), (None, c), (None, c), ("z", None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = probminhash.near_duplicate_classes(docs).collect()
    assert sorted(map(repr, ((r[0], r[1], r[2]) for r in got))) == sorted(map(repr, [("x", "x", 1), ("x", "x", 2), ("y", "x", 2), (None, None, 2), (None, None, 2), ("z", "z", 2), (None, "z", 2)]))
    assert sorted(map(tuple, probminhash.distinct_rows(docs).collect()), key=repr) == sorted([("x", a), ("x", b), (None, c), ("z", None)], key=repr)


def test_repeats_do_not_hide_a_pair(spark):
    """The sets are similar by 0.8 or more, though one text repeats some shingles a hundred times."""
    rnd = random.Random(23)
    rows = []
    for k in range(30):
        w = [f"k{k}w{i}" for i in range(204)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[:100]] * 60 + w[:190] + [f"{rnd.random()}"]))]
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {i: i - i % 2 for i in range(60)}


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """All texts in one bucket, most pairs of them just below the threshold: the classes are those of all pairs, and few pairs are looked at."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(60)] = word()
        rows.append((i, " ".join(w)))
    one = lambda docs, ident, text: docs.select(F.col(ident).alias("id"), F.unhex(F.md5(text)).alias("text_key"), F.array(F.lit(7).cast("long")).alias("bands"))
    monkeypatch.setattr(probminhash, "_sketches", one)
    looked, search = [], probminhash.differences

    def counted(*args):
        looked.append(search(*args))
        return looked[-1]

    monkeypatch.setattr(probminhash, "differences", counted)
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert looked[0].count() < 0.03 * len(rows) ** 2 / 2


@pytest.mark.parametrize("limit", [500_000, 40])
def test_components(spark, monkeypatch, limit):
    from sweepgrid.llm import components

    monkeypatch.setattr(components, "LINKS_PER_TASK", limit)
    rnd = random.Random(limit)
    links = [(i, i + 1) for i in range(0, 90)] + [(200 + rnd.randrange(60), 200 + rnd.randrange(60)) for _ in range(40)] + [(500, 500 + i) for i in range(50)]
    rnd.shuffle(links)
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x in sorted(near):
        todo = [x] if x not in want else []
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(5))
    assert {r["node"]: r["label"] for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_by_hubs(spark, sf_dir):
    """A family larger than any bucket that is compared pair by pair, with members that only meet through their base."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        w[rnd.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"z{rnd.random()}" for _ in range(40))) for i in range(20)]
    got = probminhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == brute_classes(rows)


def test_near_duplicates_settle_large_buckets(spark, monkeypatch):
    """One bucket holds all texts: separate ones, classes that hubs leave apart, and a chain whose ends are far apart."""
    texts = [" ".join(f"lone{k}x{i}" for i in range(100)) for k in range(14)]
    for k in range(3):
        texts += [" ".join(f"fam{k}x{i}" for i in range(shift, shift + 100)) for shift in (0, 10, 20, 30, 40)]
    texts += [" ".join(f"pair{i}" for i in range(shift, shift + 100)) for shift in (0, 3)]
    one = lambda docs, ident, text: docs.select(F.col(ident).alias("id"), F.unhex(F.md5(text)).alias("text_key"), F.array(F.lit(7).cast("long")).alias("bands"))
    monkeypatch.setattr(probminhash, "_sketches", one)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicate_classes(docs).collect()}
    want = {k: k for k in range(14)} | {14 + 5 * k + j: 14 + 5 * k for k in range(3) for j in range(5)} | {29: 29, 30: 29}
    assert got == want


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    b[:300] = a[:300]
    reg = probminhash.prob_minhash(np.repeat([0, 1], 400), np.concatenate([a, b]), np.ones(800), 2, 512)
    assert (reg[0] == reg[1]).mean() == pytest.approx(300 / 500, abs=0.08)


def test_quality_counts(spark, hard, empty):
    want = []
    for r in hard_rows():
        t = r[1] or ""
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                inside.update((i, i + 1, i + 2))
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want.append((repr(r[0]), len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed))
    got = fertility.quality(hard)
    assert by_id(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want)
    assert got.where("kept AND base_failed").count() == 0
    assert fertility.quality(empty).count() == 0
    rows = fertility.quality_rows(hard)
    assert rows.columns == hard.columns and rows.exceptAll(hard).count() == 0


def test_quality_keeps_labelled_good_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = fertility.quality(docs).where("NOT base_failed").join(labels, "doc_id")
    kept, n = got.where("quality = 1").agg(F.sum(F.col("kept").cast("int")), F.count("*")).first()
    assert kept >= 0.98 * n


def test_archives_round_trip(spark, tmp_path):
    pages = [(5, "http://a b/é", "<p>\r\n\r\nWARC/1.0</p>"), (2, None, "same"), (9, "u", "same"), (7, "u", None), (8, "v", ""), (None, "w", "same"), (1, "x", "漢" * 30_000)]
    df = spark.createDataFrame([(*p, "zz") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    for version in (1, 2, None):
        at = f"file://{tmp_path}/{version}"
        warc.write_arc(df, f"{at}/arc", version)
        warc.arc_to_warc(spark, f"{at}/arc", f"{at}/warc")
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, f"{at}/warc").collect()}
        first = {}
        for i, _, h in sorted(p for p in pages if p[0] is not None):
            first.setdefault(h or "", i)
        want = {}
        for i, _, h in pages:
            raw = (h or "").encode()
            of = None if i is None or first[h or ""] == i else first[h or ""]
            want[i] = (len(raw), warc.payload_digest(raw), "revisit" if of is not None else "response", of)
        assert got == want
    warc.write_arc(df.limit(0), f"file://{tmp_path}/none/arc")


def test_arc_errors():
    whole = warc.arc_open(2, "n") + warc.arc_record(2, "u", "20240101000000", b"HTTP/1.1 200 OK\r\n\r\nabc", 0, "n")
    (head, content), = warc.parse_arc(whole)
    assert head["Archive-length"] == str(len(content)) and warc.split_http(content)[1] == b"abc"
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(whole[:-4]))
    with pytest.raises(ValueError, match="header line"):
        list(warc.parse_arc(whole + b"junk\n"))


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Rounds of sharing by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, held = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return held | got
        held |= {s: float(cap * sizes[s]) for s in over}


def test_mix_targets(spark, hard, empty):
    sized = hard.withColumn("size", common.word_count(F.col("text")))
    got = mixing.mix(sized, ident=["doc_id"]).collect()
    assert len(got) == hard.count()
    sizes = defaultdict(int)
    for r in hard_rows():
        sizes[r[3]] += len(words(r[1]))
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3 and len(r["shards"]) == r["copies"]
        taken[r["source"]] += r["copies"] * r["size"]
    big = max(len(words(r[1])) for r in hard_rows())
    assert all(abs(taken[s] - want[s]) <= big for s in sizes)
    assert mixing.mix(empty.withColumn("size", F.lit(0).cast("long"))).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 1}, {"a": 0, "b": 5}, {chr(97 + i): 3**i for i in range(9)}])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame([(s or "", s is None, n) for s, n in sizes.items()], "src string, null_last boolean, source_size long")
    got = {None if r["null_last"] else r["src"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_reruns_agree_and_fill_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("size", common.word_count(F.col("text"))).select("doc_id", "source", "size")
    runs = [sorted((r["doc_id"], r["copies"], tuple(r["shards"])) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mixed_rows(whole, common.word_count(F.col("text")), ident=["doc_id"])
    assert rows.columns == whole.columns and rows.count() == sum(c for _, c, _ in runs[0])


def test_mix_of_large_sources(spark, monkeypatch):
    """More blocks for larger sources, nodes of the tree ranked in parts, the plan joined by a shuffle: targets are still met."""
    for name, value in (("BLOCKS", 8), ("BLOCK_DOCS", 4), ("PART_TOKENS", 20), ("BROADCAST_ROWS", 0), ("POOL", 16)):
        monkeypatch.setattr(mixing, name, value)
    rnd = random.Random(8)
    rows = [(i, rnd.choice("aaaab"), rnd.randint(0, 30)) for i in range(1500)] + [(i, "c", 3) for i in range(1500, 1520)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    sizes, taken = Counter(), Counter()
    for _, s, n in rows:
        sizes[s] += n
    got = mixing.mix(docs).collect()
    for r in got:
        assert r["copies"] <= 3 and len(r["shards"]) == r["copies"]
        taken[r["source"]] += r["copies"] * r["size"]
    want = brute_targets(sizes)
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    given = Counter(k for r in got for k in r["shards"])
    assert set(given) == set(range(mixing.SHARDS)) and max(given.values()) < 2 * min(given.values())


@pytest.mark.parametrize("a,b", [([100_000], [10] * 3900), ([1000], [100] * 16), ([700, 400, 300], [9] * 60), ([50], [1000, 1])])
def test_mix_of_few_large_documents(spark, a, b):
    """A source of few documents, one of them a little larger than what is wanted, comes as near as one document lets it."""
    sizes = {"a": a, "b": b}
    rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, several in sizes.items() for n in several)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    want = brute_targets({s: sum(n) for s, n in sizes.items()})
    for s in sizes:
        assert abs(sum(r["copies"] * r["size"] for r in got if r["source"] == s) - want[s]) <= max(sizes[s]) / 2, s
    assert max(r["copies"] for r in got) <= 3


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_split_tree_is_exact(spark, most):
    tokens_ = spark.range(103).select((F.col("id") % 3).alias("s"), F.col("id").alias("i"))
    got = [r["count"] for r in mixing.split_tree(tokens_, 8, 1, most).groupBy("shard").count().collect()]
    assert sum(got) == 103 and max(got) - min(got) <= 2 and len(got) == 8


def test_shards(spark, hard, empty):
    got = shards.feistel_shards(hard, ["doc_id"], 24)
    again = shards.feistel_shards(hard.repartition(5), ["doc_id"], 24)
    assert got.exceptAll(again).count() == 0
    slots = defaultdict(list)
    for r in got.collect():
        slots[r["shard"]].append(r["slot"])
    n = [len(slots[k]) for k in range(24)]
    assert max(n) - min(n) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.feistel_shards(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_permutation(spark, n):
    got = [r["o"] for r in shards.permute(spark.range(n), "id", "o", n, 3).collect()]
    assert sorted(got) == list(range(n))
    fake = lambda v, i: (v * 2654435761 + i * 97) >> 3
    assert sorted(shards.feistel_position(i, n, fake) for i in range(n)) == list(range(n))


def test_containment(spark, hard, empty):
    rows = hard_rows()
    passage = next(r[1] for r in rows if r[1] and len(words(r[1])) == 60)
    items = [(1, passage), (2, " ".join(passage.split()[5:20])), (3, None), (4, ""), (5, "a b c d"), (6, "never seen here at all today"), (7, " ".join(passage.split()[:50]) + " q1 q2 q3 q4 q5 q6"), (None, "one")]
    items += [(5, passage), (5, " ".join(passage.split()[20:40])), (None, " ".join(passage.split()[2:30])), (None, "no such words in any of them"), (5, passage)]  # ids that are shared or missing
    bench = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, doc string")
    holds = lambda text, t: (q := shingle_set(t)) and len(q & shingle_set(text)) >= 0.8 * len(q)
    want = [(d, i) for d, text in {(r[0], r[1]) for r in rows} for i, t in set(items) if holds(text, t)]
    got = decontam.contained(hard, bench)
    assert sorted(repr((r["doc_id"], r["item_id"])) for r in got.collect()) == sorted(map(repr, want))
    assert decontam.contained(empty, bench).count() == 0 and decontam.contained(hard, bench.limit(0)).count() == 0
    clean = decontam.clean_rows(hard, bench)
    assert clean.columns == hard.columns and sorted(map(repr, map(tuple, clean.collect()))) == sorted(repr(r) for r in rows if not any(holds(r[1], t) for _, t in items))


@pytest.mark.parametrize("limit", [500_000, 0])
def test_sketches_lose_no_item(spark, monkeypatch, limit):
    """Items of every size, documents that hold just enough of them or just too little, scattered over the text; joined by broadcast and by shuffle."""
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    rnd = random.Random(4)
    items, docs = [], []
    for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 16, 17, 20, 33, 40, 64, 65, 130, 300, 700]):
        w = [f"i{k}x{j}" for j in range(n + 4)]
        items.append((k, " ".join(w)))
        for absent in (int(n * 0.2 + 1e-9), int(n * 0.2 + 1e-9) + 1):
            for _ in range(3):
                kept = sorted(rnd.sample(range(n), max(n - absent, 0)))
                # Each shingle that is kept stands alone, so that no other comes with it.
                docs.append((len(docs), " ".join(" ".join(w[j : j + 5]) + f" gap{rnd.random()}" for j in kept)))
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(d, i): len(q & shingle_set(text)) for d, text in docs for i, t in items if len((q := shingle_set(t)) & shingle_set(text)) >= 0.8 * len(q)}
    got = decontam.contained(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_shared"] for r in got} == want and len(want) >= 3 * len(items) - 6
    sketch = decontam.item_shingles(bench).where("in_sketch").count()
    assert sketch < 0.35 * sum(len(shingle_set(t)) for _, t in items)


def test_word_hashes_are_of_words_alone():
    a, b = textunits.Words([b"aa bb", b"bb  aa"]), textunits.Words([b"\n\naa\x0bbb", b""])
    assert a.h[0] == a.h[3] == b.h[0] and a.h[1] == a.h[2] == b.h[1] and a.h[0] != a.h[1]
    assert a.doc.tolist() == [0, 0, 1, 1] and b.doc.tolist() == [0, 0]


GRAMMARS = {
    "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "line": r"[^\n]*\n|[^\n]+",
    "run": r"[^\W_]+|(?:\W|_)+",
}


def brute_fim(ident, text, grammar="word"):
    t = text or ""
    w = re.findall(GRAMMARS[grammar], t)
    h = hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()
    k = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, z = sorted((k[0] % (len(w) + 1), k[1] % (len(w) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or k[2] % 100 >= 50:
        return len(w), "plain", None, None, t
    p, m, s = "".join(w[:a]), "".join(w[a:z]), "".join(w[z:])
    return (len(w), "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if k[3] % 100 < 80 else (len(w), "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("grammar", sorted(GRAMMARS))
def test_fill_in_middle(spark, hard, empty, grammar):
    rows = [r[:2] for r in hard_rows()]
    rnd = random.Random(9)
    rows += [(100 + i, "".join(rnd.choice(["<", "P", "S", "M", ">", " ", "\n", "a", "\u00a0", "\U0001f600", "é", "x\x1c"]) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    rows += [(500, "a<P>b c d"), (501, "<S"), (502, "x <M> y"), (503, "<<<>>> <"), (504, " \t lead and trail \r\n ")]
    if grammar == "run":  # \\w of the other library knows other marks
        rows = [(i, t) for i, t in rows if not t or t.isascii()]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), grammar=grammar)
    back = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["output"])) for r in back) == sorted(repr((i, *brute_fim(i, t, grammar))) for i, t in rows)
    assert sorted(repr((r["doc_id"], r["back"])) for r in back) == sorted(repr((i, t or "")) for i, t in rows)
    assert {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(hard).count() == len(hard_rows()) and fim.fill_in_middle(empty).count() == 0


def test_sentences_join_to_their_text(spark):
    rows = [("One. Two! Three?\nFour 4.5 e.g. five.",), ("...",), (" . ",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", fim.units(F.col("t"), "sentence").alias("u")).collect()
    assert all("".join(r["u"]) == (r["t"] or "") for r in got) and got[0]["u"] == ["One.", " Two!", " Three?", "\n", "Four 4.5 e.g.", " five."] and not got[3]["u"] and not got[4]["u"]


def runs_of_three(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute_components(rows):
    """All pairs of distinct texts, by union and find; each row's shingles and the smallest id of its component."""
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    sets = {t: runs_of_three(t) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    listed = sorted(texts)
    links = 0
    for x in range(len(listed)):
        for y in range(x):
            a, b = sets[listed[x]], sets[listed[y]]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                links += 1
                root[find(listed[x])] = find(listed[y])
    lowest = defaultdict(list)
    for t, ids in texts.items():
        lowest[find(t)] += [i for i in ids if i is not None]
    return links, sorted(repr((i, len(sets[t or ""]), i if not sets[t or ""] else min(lowest[find(t or "")], default=None))) for i, t in rows)


def families(rnd):
    """Texts in families: stars around a base, chains of small steps, groups at all distances about the radius, and variants that share their edits."""
    texts = []
    for n in (8, 9, 10, 11, 12, 30, 60, 200, 400):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, n // 40))):
                w[rnd.randrange(n)] = f"e{rnd.randrange(10**6)}"
            texts.append(w)
        w = list(base)
        for _ in range(20):  # each within the radius of the one before, the ends far apart
            w = list(w)
            w[rnd.randrange(n)] = f"c{rnd.randrange(10**6)}"
            texts.append(w)
        edits = [(rnd.randrange(n), f"s{j}") for j in range(8)]
        for _ in range(25):  # variants by edits that several have
            w = list(base)
            for at, x in rnd.sample(edits, rnd.randint(1, 5)):
                w[at] = x
            texts.append(w)
        texts.append([x.upper() for x in base])
    rnd.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("leaf,pivots,rounds,chunk", [(2048, 32, 4, 4_000_000), (3, 2, 2, 20_000)])
def test_jaccard_join(spark, monkeypatch, leaf, pivots, rounds, chunk):
    for name, value in (("LEAF", leaf), ("PIVOTS", pivots), ("ROUNDS", rounds), ("CHUNK_BYTES", chunk), ("STRIPE", 64)):
        monkeypatch.setattr(metricjoin, name, value)
    rows = families(random.Random(12))
    rows += rows[:40] + [(5000, None), (5001, ""), (None, " \n"), (None, rows[3][1]), (7, "other text"), (7, "Other Text"), (None, "alone"), (5002, "a b"), (5003, "A  B")]
    links, want = brute_components(rows)
    got = metricjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert links > 500 and sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect()) == want


def test_jaccard_join_of_hard_rows(spark, hard, empty):
    rows = [r[:2] for r in hard_rows()]
    got = metricjoin.jaccard_components(hard)
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect()) == brute_components(rows)[1]
    assert metricjoin.jaccard_components(empty).count() == 0


def test_jaccard_join_splits_by_cells(spark, monkeypatch):
    """A large region is split by pivots: far fewer pairs are measured than it has, and no cell is left to the differences."""
    monkeypatch.setattr(metricjoin, "LEAF", 12)
    monkeypatch.setattr(metricjoin, "PIVOTS", 8)
    rnd, rows = random.Random(2), []
    base = [f"b{i}" for i in range(400)]
    for g in range(12):  # groups around a common base, at 0.3 of it and further from each other
        centre = [f"g{g}x{i}" if i % 40 < 3 + g % 3 else w for i, w in enumerate(base)]
        for _ in range(10):
            w = list(centre)
            for _ in range(2):
                w[rnd.randrange(400)] = rnd.choice(["p", "q", "r"])
            rows.append((len(rows), " ".join(w)))
    counted, measured = [], metricjoin._measured

    def count(pairs, sets, percent):
        counted.append(pairs.count())
        return measured(pairs, sets, percent)

    monkeypatch.setattr(metricjoin, "_measured", count)
    got = metricjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got.collect()) == brute_components(rows)[1]
    assert sum(counted) < len(rows) * (len(rows) - 1) / 4, counted
