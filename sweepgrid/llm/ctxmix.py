"""Language-model scores by online logistic context mixing.

A token is coded as the bits of its class (a hash of the word), then as itself among the
words of its class. Each class bit is predicted by several hashed-context predictors: the
bits so far alone (order 0), with the endings of the two words before, with the whole word
before, and a predictor that learns within the text. Their logits are combined by gated
weights (a set for each bit and for how well its word context is known), which are refined
after every bit by the error of the prediction, through the whole text. The context tables are counted over all
training texts, and so are the words; word counts are exact and reach the texts by an
exchange of messages between chunks of texts and buckets of words, so nothing that grows
with the corpus is held in one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, table, text_bytes
from .repeats import MESSAGE, messages, order_number, pack, rows_of, split_by, unpack
from .textunits import Words

CLASS_BITS = 12
#: Slots of the tables (as powers of two): endings, word before. Their sizes bound what is broadcast (about 8 MB).
ENDING_BITS, WORD_BITS = 20, 21
#: Texts worked on at once; each holds a predictor of 16 KB, so the number of texts is bounded too.
BATCH_BYTES, BATCH_TEXTS = 2_000_000, 2000
#: Parts of the tables, and tables added up by one task.
RANGES, FAN = 64, 64
#: Text in a chunk: the larger, the less often a frequent word is asked for.
CHUNK_BYTES = 8_000_000
#: Of order 0, endings, word before and the learning predictor; chosen, as the rates, on the texts of remainder 3, a training
#: fold, of sf0.1, by tables of the training folds but that one.
START_WEIGHTS = (0.3, 0.4, 0.3, 0.3)
LEARN, LEARN_OWN = 0.04, 0.7
FOLDS, HELD = 7, 2
END, END_HASH = b"", np.uint64(0x1234567)


def held_out(ident: object) -> bool:
    return zlib.crc32(("" if ident is None else str(ident)).encode()) % FOLDS == HELD


class Tokens:
    """Words and ends of some texts as arrays: h (hash), cls, ending and word (contexts), doc."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts, lower=True)
        n = len(w.h) + w.n_docs
        self.doc = np.repeat(np.arange(w.n_docs), np.diff(w.first) + 1)
        self.is_end = np.zeros(n, bool)
        self.is_end[w.first[1:] + np.arange(w.n_docs)] = True
        self.h = np.empty(n, np.uint64)
        self.h[~self.is_end] = w.h
        self.h[self.is_end] = END_HASH
        self.cls = (mix64(self.h + np.uint64(99)) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
        raw = np.frombuffer(w.data, np.uint8)
        last = np.zeros(n, np.uint64)
        if len(w.h):
            tail = raw[w.end - 1].astype(np.uint64)
            last[~self.is_end] = tail << np.uint64(8) | np.where(w.end - w.start > 1, raw[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)

        def before(x: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            out[k:] = np.where(self.doc[k:] == self.doc[:-k], x[:-k], np.uint64(0)) if n > k else 0
            return out

        self.ending = mix64(before(last, 1) << np.uint64(16) | before(last, 2))
        self.word = before(self.h, 1)


def bit_slots(tokens_cls: np.ndarray, context: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot, bit) of each class bit, most significant first."""
    cls, low = tokens_cls.astype(np.uint32), (context >> np.uint64(32)).astype(np.uint32)
    for i in range(CLASS_BITS):
        x = cls >> np.uint32(CLASS_BITS - i)
        x |= np.uint32(1 << i)
        x *= np.uint32(0x9E3779B1)
        x ^= low
        x *= np.uint32(0x85EBCA6B)
        x >>= np.uint32(32 - bits)
        yield x.astype(np.int64), (cls >> np.uint32(CLASS_BITS - 1 - i)) & np.uint32(1)


def count_tables(t: Tokens) -> list[np.ndarray]:
    """Counts of zero and one bits by slot: order 0, endings, word."""
    n = len(t.cls)
    at = np.empty((CLASS_BITS, n), np.int64)
    for i in range(CLASS_BITS):
        at[i] = (np.int64(2) << i) | t.cls >> (CLASS_BITS - 1 - i)  # the node and then the bit
    out = [np.bincount(at.ravel(), minlength=2 << CLASS_BITS)]
    for context, bits in ((t.ending, ENDING_BITS), (t.word, WORD_BITS)):
        for i, (slot, bit) in enumerate(bit_slots(t.cls, context, bits)):
            np.left_shift(slot, 1, out=at[i])
            at[i] |= bit.astype(np.int64)
        out.append(np.bincount(at.ravel(), minlength=2 << bits))
    return out


def trained_tables(docs: DataFrame) -> dict[str, np.ndarray]:
    """The context tables over all training texts of docs (doc, t)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, got, used = None, [], 0

        def add() -> None:
            nonlocal sums, got, used
            part = count_tables(Tokens(got))
            if sums is None:
                sums = [p.astype(np.uint32) for p in part]
            else:
                for s, p in zip(sums, part, strict=True):
                    s += p.astype(np.uint32)
            got, used = [], 0

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held_out(ident):
                    continue
                got.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                used += len(got[-1])
                if used > BATCH_BYTES:
                    add()
        if got:
            add()
        if sums is not None:
            rows = [(r, pack(0, *(np.array_split(s.reshape(-1, 2), RANGES)[r] for s in sums))) for r in range(RANGES)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([m for _, m in rows], pa.binary())], names=["part", "msg"])

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        sums = None
        for m in rows.column("msg"):
            _, *arrays = unpack(m.as_py())
            sums = [a.astype(np.uint64) for a in arrays] if sums is None else [s + a for s, a in zip(sums, arrays, strict=True)]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "msg": pa.array([pack(0, *sums)], pa.binary())})

    scanned = docs.select("doc", "t")
    tasks = scanned.rdd.getNumPartitions()
    counted = scanned.mapInArrow(count, "part int, msg binary").withColumn("of", F.spark_partition_id())
    while tasks > FAN:  # so that one task never holds more than FAN parts
        tasks = -(-tasks // FAN)
        summed = counted.groupBy("part", F.pmod("of", F.lit(tasks)).alias("of")).applyInArrow(lambda k, r: total(k, r).append_column("of", pa.array([k[1].as_py()], pa.int32())), "part int, msg binary, of int")
        counted = cut(summed)
    parts = counted.groupBy("part").applyInArrow(total, "part int, msg binary").collect()
    if not parts:
        sums = [np.zeros((1 << b, 2), np.uint64) for b in (CLASS_BITS, ENDING_BITS, WORD_BITS)]
    else:
        got = [unpack(bytes(r["msg"]))[1:] for r in sorted(parts, key=lambda r: r["part"])]
        sums = [np.concatenate(x).reshape(-1, 2) for x in zip(*got, strict=True)]

    def logit(n: np.ndarray) -> np.ndarray:
        return np.clip(np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)), -9, 9).astype(np.float16)

    seen = sums[2].sum(axis=1)
    return {"node": logit(sums[0]), "ending": logit(sums[1]), "word": logit(sums[2]), "known": (seen > 0).astype(np.uint8) + (seen > 8)}


def unpacked(tables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Tables with the predictors in single precision."""
    return tables | {k: tables[k].astype(np.float32) for k in ("node", "ending", "word")}


def mixed_log10(t: Tokens, tables: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of each token's class probability."""
    n = len(t.h)
    size = np.bincount(t.doc)
    place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    # Texts, the longest first; tokens in the order of their place in the text, then of the text.
    by = np.argsort(-size, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    # At each step the active texts are those of the first ranks, so a token's place follows without a sort.
    many, order = np.bincount(place), np.empty(n, np.int64)
    order[(np.cumsum(many) - many)[place] + rank[t.doc]] = np.arange(n)
    cls, row = t.cls[order], rank[t.doc][order]
    texts = len(by)
    # For each token and bit: the inputs from tables, the sign of the bit, the places of its weights and of the learning
    # predictor. The bits of a token use weights and predictors of their own, so one step takes all bits of its tokens
    # at once. All weights are chosen by how well the word context is known (3 cases).
    inputs = np.empty((4, CLASS_BITS, n), np.float32)
    sign, place_own = np.empty((CLASS_BITS, n), np.float32), np.empty((CLASS_BITS, n), np.int32)
    place_weight = np.empty((CLASS_BITS, n), np.int32)
    slots = zip(bit_slots(cls, t.ending[order], ENDING_BITS), bit_slots(cls, t.word[order], WORD_BITS), strict=True)
    for i, ((ending, bit), (word, _)) in enumerate(slots):
        node = (np.int64(1) << i) | (cls >> (CLASS_BITS - i))
        # All places are inside their tables; "clip" only spares the check.
        tables["node"].take(node, out=inputs[0, i], mode="clip")
        tables["ending"].take(ending, out=inputs[1, i], mode="clip")
        tables["word"].take(word, out=inputs[2, i], mode="clip")
        place_weight[i] = (tables["known"].take(word, mode="clip") + np.int64(3 * i)) * np.int64(texts) + row
        np.subtract(np.multiply(bit, np.float32(2)), np.float32(1), out=sign[i])
        place_own[i] = row << CLASS_BITS | node
    weights = np.repeat(np.array(START_WEIGHTS, np.float32)[:, None], 3 * CLASS_BITS * texts, axis=1)
    own = np.tile(tables["node"], texts)
    prob = np.empty(n)
    one, low, rate, own_rate = np.float32(1), np.float32(-25), np.float32(LEARN), np.float32(LEARN_OWN)
    at = 0
    for k in many.tolist():
        here = slice(at, at + k)
        x, s, g = place_own[:, here].astype(np.int64), sign[:, here], place_weight[:, here].astype(np.int64)
        d = own.take(x, mode="clip")
        v = inputs[:, :, here]
        v[3] = d
        w = weights.take(g, axis=1, mode="clip")
        dot = np.add.reduce(w * v, axis=0)
        dot *= s
        np.maximum(dot, low, out=dot)
        p = np.exp(np.negative(dot, out=dot), out=dot)  # of the bit that comes: 1 / (1 + exp(-dot))
        p += one
        np.reciprocal(p, out=p)
        prob[here] = np.multiply.reduce(p, axis=0)
        err = one - p
        err *= s
        err *= rate
        w += err * v
        for j in range(4):
            weights[j][g] = w[j]
        move = np.exp(s * d)
        move += one
        np.divide(s, move, out=move)
        move *= own_rate
        move += d
        own[x] = move
        at += k
    out = np.empty(n)
    out[order] = np.log10(prob)
    return out


def _batches(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Texts of similar length together, as a batch has as many steps as its longest text has tokens."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    start, used = 0, 0
    for i, t in enumerate(texts):
        if i > start and (used + len(t) > BATCH_BYTES or i - start >= BATCH_TEXTS):
            yield ids[start:i], texts[start:i]
            start, used = i, 0
        used += len(t)
    if start < len(texts):
        yield ids[start:], texts[start:]


def _vocabulary(texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Distinct words of some texts by hash: hashes, words, counts in training texts. Words that share a hash stand next to each other."""
    words = Words(texts, lower=True)
    order = np.argsort(words.h, kind="stable")
    sorted_ = words.h[order]
    head = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(order) else np.zeros(0, np.int64)
    listed = np.empty(len(order), np.int64)
    listed[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    if not words.as_listed(listed).all():
        return _vocabulary_by_content(words, train)
    h, first = sorted_[head], order[head]
    flags = np.array(train, np.int64)[words.doc[order]] if len(order) else np.zeros(0, np.int64)
    count = np.add.reduceat(flags, head) if len(head) else np.zeros(0, np.int64)
    return h, [words.data[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)], count


def _vocabulary_by_content(words: Words, train: list[bool]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """As `_vocabulary`, where different words share a hash."""
    count: dict[tuple[int, bytes], int] = {}
    for h, doc, a, b in zip(words.h.tolist(), words.doc.tolist(), words.start.tolist(), words.end.tolist(), strict=True):
        key = h, words.data[a:b]
        count[key] = count.get(key, 0) + train[doc]
    listed = sorted(count)
    return np.array([h for h, _ in listed], np.uint64), [w for _, w in listed], np.array([count[k] for k in listed], np.int64)


def _known_counts(batches: list[tuple[list, list[bytes], "Tokens"]], replies: list[tuple[int, bytes]], n: int, ids: list, texts: list[bytes]) -> list[np.ndarray]:
    """The training count of each token of the batches, from the buckets' replies to what `_chunk_words` listed."""
    h = np.append(np.unique(np.concatenate([t.words.h for _, _, t in batches]) if batches else np.zeros(0, np.uint64)), END_HASH)
    told = {bucket: unpack(m)[1] for bucket, m in replies}
    listed = None
    if sum(map(len, told.values())) != len(h):  # more words than hashes: told apart by content
        h, listed, _ = _chunk_words(ids, texts)
    count = np.zeros(len(h))
    for d, i in split_by((mix64(h) % np.uint64(n)).astype(np.int64)):
        count[i] = told[d]
    if listed is None:
        by = np.argsort(h)
        h, count = h[by], count[by]
        return [count[np.searchsorted(h, t.h)] for _, _, t in batches]
    of = dict(zip(listed, count.tolist(), strict=True))
    out = []
    for _, _, t in batches:
        c = np.full(len(t.h), of[END])
        c[~t.is_end] = [of[t.words.data[a:b]] for a, b in zip(t.words.start.tolist(), t.words.end.tolist(), strict=True)]
        out.append(c)
    return out


def _chunk_words(ids: list, texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    h, words, count = _vocabulary(texts, [not held_out(i) for i in ids])
    ends = sum(not held_out(i) for i in ids)
    return np.append(h, END_HASH), [*words, END], np.append(count, ends)


def _ask(n: int) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        h, words, count = _chunk_words(*rows_of(rows)[:2])
        cls = (mix64(h + np.uint64(99)) >> np.uint64(64 - CLASS_BITS)).astype(np.uint16)
        out = []
        for d, i in split_by((mix64(h) % np.uint64(n)).astype(np.int64)):
            listed = [words[k] for k in i.tolist()]
            out.append((d, key[0].as_py(), pack(0, count[i].astype(np.uint32), cls[i], np.fromiter(map(len, listed), np.uint32, len(listed)), b"".join(listed))))
        return messages(out)

    return run


def _tell(key: tuple, rows: pa.Table) -> pa.Table:
    """Global counts, in the order asked; with origin -1 the sums by class of this bucket."""
    total: dict[bytes, int] = {}
    asked, kinds = [], {}
    for origin, m in zip(rows.column("origin").to_pylist(), rows.column("msg"), strict=True):
        _, count, cls, length, data = unpack(m.as_py())
        end = np.cumsum(length.astype(np.int64))
        words = [data[a:b] for a, b in zip((end - length).tolist(), end.tolist(), strict=True)]
        for w, c in zip(words, count.tolist(), strict=True):
            total[w] = total.get(w, 0) + c
        kinds.update(zip(words, cls.tolist(), strict=True))
        asked.append((origin, words))
    out = [(origin, key[0].as_py(), pack(0, np.fromiter((total[w] for w in words), np.uint64, len(words)))) for origin, words in asked]
    c = np.fromiter(total.values(), np.int64, len(total))
    k = np.fromiter((kinds[w] for w in total), np.int64, len(total))
    tokens, words = np.bincount(k, weights=c, minlength=1 << CLASS_BITS).astype(np.int64), np.bincount(k[c > 0], minlength=1 << CLASS_BITS)
    out.append((-1, key[0].as_py(), pack(0, tokens, words)))
    return messages(out)


def _class_sums(told: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training words by class (2**CLASS_BITS rows reach the driver)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(1 << CLASS_BITS, np.int64), np.zeros(1 << CLASS_BITS, np.int64)
        for batch in batches:
            for m in batch.column(0):
                _, a, b = unpack(m.as_py())
                tokens, words = tokens + a, words + b
        some = np.flatnonzero(tokens)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(tokens[some]), pa.array(words[some])], names=["k", "tokens", "words"])

    got = told.where("dest = -1").select("msg").mapInArrow(rows, "k long, tokens long, words long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    tokens, words = np.zeros(1 << CLASS_BITS), np.zeros(1 << CLASS_BITS)
    for r in got:
        tokens[r["k"]], words[r["k"]] = r["tokens"], r["words"]
    return tokens, words


def score_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: ident, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A null text counts as empty: one end token. A null id counts as the empty string for the
    fold. Ids may be of any type and repeat. Without training texts all counts are 0. Scores do not
    depend on how rows are dealt out.
    """
    spark = docs.sparkSession
    n = int(max(1, -(-text_bytes(docs, text) // CHUNK_BYTES)))
    rows = docs.select(F.pmod(F.xxhash64(F.col(ident), F.col(text)), F.lit(n)).cast("int").alias("dest"), F.col(ident).alias("doc"), order_number(docs, ident).alias("num"), F.col(text).alias("t"))
    chunks = rows.groupBy("dest")
    told = cut(chunks.applyInArrow(_ask(n), MESSAGE).groupBy("dest").applyInArrow(_tell, MESSAGE))
    class_tokens, class_words = _class_sums(told)
    n_train, n_words = int(class_tokens.sum()), int(class_words.sum())
    model = spark.sparkContext.broadcast(trained_tables(rows) | {"size": class_tokens + class_words + 1.0})

    def run(key: tuple, table_: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts, _ = rows_of(table_)
        kinds = [("doc", table_.schema.field("doc").type), *KINDS]
        tables = unpacked(model.value)
        batches = [(some, batch, Tokens(batch)) for some, batch in _batches(ids, texts)]
        counts = _known_counts(batches, [(b, m.as_py()) for b, m in zip(replies.column("origin").to_pylist(), replies.column("msg"), strict=True)], n, ids, texts)
        out = []
        for (some, batch, t), c in zip(batches, counts, strict=True):
            base = np.log10((c + 1.0) / (n_train + n_words + 1.0))
            inside = np.log10((c + 1.0) / tables["size"][t.cls])
            score = mixed_log10(t, tables) + inside
            add = lambda x: np.bincount(t.doc, weights=x, minlength=len(batch))  # noqa: B023, E731
            total = add(score)
            size = np.maximum(np.fromiter(map(len, batch), np.int64, len(batch)), 1)
            out.append((some, [held_out(i) for i in some], np.bincount(t.doc, minlength=len(batch)), add(c > 0).astype(np.int64), np.full(len(batch), n_train), add(base), total, -total * np.log2(10.0) / size))
        if not out:
            return pa.table({x: pa.array([], k) for x, k in kinds})
        return pa.table({x: pa.array(np.concatenate(v) if not isinstance(v[0], list) else sum(v, []), k) for (x, k), v in zip(kinds, zip(*out, strict=True), strict=True)})

    answers = told.where("dest >= 0").groupBy("dest")
    schema = f"doc {dict(docs.dtypes)[ident]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return chunks.cogroup(answers).applyInArrow(run, schema).withColumnRenamed("doc", ident)


KINDS = [
    ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64()),
]


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
