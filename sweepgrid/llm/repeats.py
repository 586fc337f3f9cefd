"""How repeated windows are found without comparing every suffix with every other.

Texts are dealt into chunks of a few megabytes, and chunks exchange packed messages with
buckets, all through plain shuffles:

1. Each window of W units (words or bytes) is represented by an anchor, the smallest hash
   among its runs of K units, so that equal windows have equal anchors at equal offsets.
   Chunks tell each anchor's bucket how often they hold it.
2. Buckets answer which anchors occur twice or more; only these matter any further. The
   rest of the text, nearly all of it, is never sent.
3. Chunks send the contexts of repeated anchors, all windows that an anchor represents, to
   its bucket, where a memory-sized group of suffixes is resolved (suffix tree or suffix
   sort). An anchor with more than HOT contexts is split: its windows travel one by one,
   by a 128-bit hash of their whole content, one for each distinct window of a chunk, so that
   no group grows with the number of copies.
4. Buckets answer with the windows to be removed, and chunks cut their texts.

Everything sent is a row (dest, origin, msg); messages are packed arrays.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_bytes
from .textunits import BYTE_VALUE, Words, prefix_hashes, span_hashes

MESSAGE = "dest int, origin int, msg binary"
#: Text in a chunk, and so about what a bucket gets: it bounds the memory of a task.
CHUNK_BYTES = 4_000_000
BLOCK_BYTES = 1_000_000
HOT = 4000
BITS = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Plan:
    """window and gram lengths in units; n: chunks and buckets."""

    unit: str
    window: int
    gram: int
    n: int
    hot: int = HOT


#: What a message may hold: bytes, or arrays of these types.
KINDS = ("bytes", "|u1", "<u2", "<u4", "<u8", "<i4", "<i8", "|b1")
#: Messages above so many bytes are compressed.
SQUEEZE = 512


def pack(kind: int, *arrays: np.ndarray | bytes) -> bytes:
    """A message of a kind with some arrays: a few bytes of head, as most messages are short when there are many buckets."""
    parts, head = [], [struct.pack("<BB", kind, len(arrays))]
    for a in arrays:
        raw = a if isinstance(a, bytes) else a.tobytes()
        head.append(struct.pack("<BI", 0 if isinstance(a, bytes) else KINDS.index(a.dtype.str), len(raw)))
        parts.append(raw)
    body = b"".join(parts)
    if len(body) <= SQUEEZE:
        return b"\0" + b"".join(head) + body
    return b"\1" + b"".join(head) + pa.Codec("zstd", 1).compress(body, asbytes=True)


def unpack(msg: bytes) -> tuple:
    kind, n = struct.unpack_from("<BB", msg, 1)
    heads = [struct.unpack_from("<BI", msg, 3 + 5 * i) for i in range(n)]
    body, at, out = msg[3 + 5 * n :], 0, [kind]
    if msg[0]:
        body = pa.Codec("zstd").decompress(body, sum(size for _, size in heads), asbytes=True)
    for code, size in heads:
        out.append(body[at : at + size] if code == 0 else np.frombuffer(body, KINDS[code], size // np.dtype(KINDS[code]).itemsize, at))
        at += size
    return tuple(out)


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    d, o, m = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"dest": pa.array(d, pa.int32()), "origin": pa.array(o, pa.int32()), "msg": pa.array(m, pa.binary())})


def split_by(dest: np.ndarray) -> Iterable[tuple[int, np.ndarray]]:
    """(value, indices) for each value of dest, in order."""
    order = np.argsort(dest, kind="stable")
    d = dest[order]
    cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1], [True]))) if len(d) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(d[a]), order[a:b]


class ByteUnits:
    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        self.first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        self.n = len(self.data)
        self.values = BYTE_VALUE[np.frombuffer(self.data, np.uint8)]
        self.prefix = prefix_hashes(self.values)

    def grams(self, k: int) -> np.ndarray:
        at = np.arange(max(self.n - k + 1, 0))
        return span_hashes(self.prefix, at, at + k)

    def wide(self, s: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows at s."""
        return span_hashes(self.prefix, s, s + w), span_hashes(prefix_hashes(self.values, 1), s, s + w, 1)

    def span(self, a: int, b: int) -> bytes:
        return self.data[a:b]


class WordUnits:
    def __init__(self, texts: list[bytes]):
        self.words = Words(texts)
        self.first = self.words.first
        self.n = len(self.words.h)

    def grams(self, k: int) -> np.ndarray:
        at = np.arange(max(self.n - k + 1, 0))
        return span_hashes(prefix_hashes(self.words.h), at, at + k)

    def wide(self, s: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows at s, of other values of the bytes and by another base."""
        return span_hashes(prefix_hashes(self.words.h), s, s + w), span_hashes(prefix_hashes(self.words.hashes(1), 1), s, s + w, 1)

    def span(self, a: int, b: int) -> bytes:
        return self.words.data[self.words.start[a] : self.words.end[b - 1]]


UNITS = {"byte": ByteUnits, "word": WordUnits}


def anchors(units: ByteUnits | WordUnits, window: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors p of all windows inside texts, with the first and last window start (a, b) that
    each represents, the text and the hash of its gram. Positions are in units of the block."""
    n, w = units.n, window - gram + 1
    none = {k: np.zeros(0, np.int64) for k in ("doc", "p", "a", "b")} | {"h": np.zeros(0, np.uint64)}
    if n < window:
        return none
    h = units.grams(gram)
    keyed = (h >> BITS << BITS) | np.arange(len(h), dtype=np.uint64)
    pad = -len(keyed) % w
    grid = np.concatenate([keyed, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(h) - w + 1  # window starts
    low = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & LOW).astype(np.int64)
    length = np.diff(units.first)
    many = np.maximum(length - window + 1, 0)
    doc = np.repeat(np.arange(len(length)), many)
    if not len(doc):
        return none
    s = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(units.first[:-1], many)
    p = low[s]
    head = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (doc[1:] != doc[:-1]))))
    tail = np.append(head[1:], len(p)) - 1
    return {"doc": doc[head], "p": p[head], "a": s[head], "b": s[tail], "h": h[p[head]]}


def order_number(docs: DataFrame, ident: str) -> Column:
    """What rows are ordered by: the id, or its hash if it is not a whole number."""
    whole = dict(docs.dtypes)[ident] in ("tinyint", "smallint", "int", "bigint")
    return F.col(ident).cast("long") if whole else F.when(F.col(ident).isNotNull(), F.xxhash64(F.col(ident)))


def rows_of(table: pa.Table) -> tuple[list, list[bytes], np.ndarray]:
    """Ids, texts and order numbers of a chunk in a fixed order: by number, then text; null ids last, null texts empty."""
    ids, numbers = table.column("doc").to_pylist(), table.column("num").to_pylist()
    texts = [b"" if t is None else t for t in table.column("t").cast(pa.binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (numbers[i] is None, numbers[i] or 0, texts[i]))
    last = np.iinfo(np.int64).max
    return [ids[i] for i in order], [texts[i] for i in order], np.array([last if numbers[i] is None else numbers[i] for i in order], np.int64)


def blocks(texts: list[bytes]) -> Iterable[tuple[int, list[bytes]]]:
    """(index of the first, texts) with about BLOCK_BYTES each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > BLOCK_BYTES:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]


def _announce(plan: Plan) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, texts, _ = rows_of(table)
        found = [anchors(UNITS[plan.unit](some), plan.window, plan.gram)["h"] for _, some in blocks(texts)]
        h, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        count = np.minimum(count, 65535).astype(np.uint16)
        return messages([(d, key[0].as_py(), pack(0, h[i], count[i])) for d, i in split_by((h % np.uint64(plan.n)).astype(np.int64))])

    return run


def _answer(plan: Plan) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = [unpack(m) for m in table.column("msg").to_pylist()]
        origin = np.repeat(table.column("origin").to_numpy(), [len(g[1]) for g in got])
        h, count = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]).astype(np.int64)
        _, which = np.unique(h, return_inverse=True)
        total = np.bincount(which, weights=count)[which]
        twice = total > 1
        h, origin, hot = h[twice], origin[twice], (total > plan.hot)[twice]
        return messages([(c, key[0].as_py(), pack(0, h[i], hot[i])) for c, i in split_by(origin)])

    return run


def _send(plan: Plan, first_stays: bool) -> Callable:
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        if not table.num_rows or not replies.num_rows:
            return messages([])
        _, texts, numbers = rows_of(table)
        got = [unpack(m) for m in replies.column("msg").to_pylist()]
        known, hot = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        out, wide = [], []
        for at, some in blocks(texts):
            units = UNITS[plan.unit](some)
            found = anchors(units, plan.window, plan.gram)
            if not len(found["h"]):
                continue
            place = np.minimum(np.searchsorted(known, found["h"]), len(known) - 1)
            here = known[place] == found["h"]
            split = here & hot[place]
            keep = np.flatnonzero(here & ~split)
            start = units.first[found["doc"]]
            for d, i in split_by((found["h"][keep] % np.uint64(plan.n)).astype(np.int64)):
                i = keep[i]
                a, b = found["a"][i], found["b"][i]
                parts = [units.span(x, y) for x, y in zip(a.tolist(), (b + plan.window).tolist(), strict=True)]
                out.append((d, chunk, pack(1, found["h"][i], (found["doc"][i] + at).astype(np.uint32), (a - start[i]).astype(np.uint32), (b - a).astype(np.uint16), (found["p"][i] - a).astype(np.uint16), np.fromiter(map(len, parts), np.uint32, len(parts)), numbers[found["doc"][i] + at], b"".join(parts))))
            if split.any():
                i = np.flatnonzero(split)
                many = found["b"][i] - found["a"][i] + 1
                s = np.repeat(found["a"][i], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                doc = np.repeat(found["doc"][i], many)
                wide.append((*units.wide(s, plan.window), (doc + at).astype(np.int64), s - np.repeat(start[i], many)))
        if wide:
            x, y, doc, s = (np.concatenate(c) for c in zip(*wide, strict=True))
            order = np.lexsort((s, doc, y, x))
            x, y, doc, s = x[order], y[order], doc[order], s[order]
            new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(x)))
            gone = ~new if first_stays else np.repeat(size > 1, size)
            # What this chunk can tell itself comes back by way of a bucket, as it is.
            if gone.any():
                out.append((chunk % plan.n, chunk, pack(3, doc[gone].astype(np.uint32), s[gone].astype(np.uint32))))
            for d, i in split_by((x[head] % np.uint64(plan.n)).astype(np.int64)):
                j = head[i]
                out.append((d, chunk, pack(2, x[j], y[j], doc[j].astype(np.uint32), s[j].astype(np.uint32), np.minimum(size[i], 2).astype(np.uint8), numbers[doc[j]])))
        return messages(out)

    return run


@dataclass
class Contexts:
    """The contexts in one bucket: key, origin chunk, row, id, first window start, further windows, anchor offset, content."""

    key: np.ndarray
    origin: np.ndarray
    row: np.ndarray
    number: np.ndarray
    start: np.ndarray
    more: np.ndarray
    anchor: np.ndarray
    length: np.ndarray
    data: bytes


def _resolve(plan: Plan, first_stays: bool, resolver: Callable[[Contexts, Plan], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """resolver: contexts -> (context, window) indices to be removed."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ctx, wide, out = [], [], []
        for origin, msg in zip(table.column("origin").to_pylist(), table.column("msg").to_pylist(), strict=True):
            kind, *arrays = unpack(msg)
            if kind == 3:
                out.append((np.full(len(arrays[0]), origin), *arrays))
            elif kind == 2:
                wide.append((np.full(len(arrays[0]), origin), *arrays))
            else:
                ctx.append((np.full(len(arrays[0]), origin), *arrays))
        if wide:
            origin, x, y, row, s, many, number = (np.concatenate(c) for c in zip(*wide, strict=True))
            order = np.lexsort((s, row, origin, number, y, x))
            x, y = x[order], y[order]
            new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
            if first_stays:
                gone = order[~new]
            else:
                size = np.diff(np.append(np.flatnonzero(new), len(x)))
                gone = order[np.repeat(size > 1, size)]
            out.append((origin[gone], row[gone], s[gone]))
        if ctx:
            origin, h, row, start, more, anchor, length, number = (np.concatenate(c) for c in list(zip(*ctx, strict=True))[:8])
            got = Contexts(h, origin, row, number, start.astype(np.int64), more.astype(np.int64), anchor.astype(np.int64), length.astype(np.int64), b"".join(c[8] for c in ctx))
            i, j = resolver(got, plan)
            out.append((origin[i], row[i], (got.start[i] + j).astype(np.uint32)))
        if not out:
            return messages([])
        origin, row, s = (np.concatenate(c) for c in zip(*out, strict=True))
        rows = []
        for c, i in split_by(origin):
            i = i[np.lexsort((s[i], row[i]))]
            r, t = row[i].astype(np.int64), s[i].astype(np.int64)
            new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (t[1:] != t[:-1] + 1))))
            last = np.append(new[1:], len(t)) - 1
            rows.append((c, key[0].as_py(), pack(0, r[new].astype(np.uint32), t[new].astype(np.uint32), t[last].astype(np.uint32))))
        return messages(rows)

    return run


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units lie in one of the spans [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(plan: Plan, cutter: Callable, made: list[tuple[str, pa.DataType]]) -> Callable:
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts, _ = rows_of(table)
        names = [("doc", table.schema.field("doc").type), *made]
        got = [unpack(m) for m in replies.column("msg").to_pylist()]
        if got:
            row, a, b = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in (1, 2, 3))
        else:
            row = a = b = np.zeros(0, np.int64)
        order = np.argsort(row, kind="stable")
        row, a, b = row[order], a[order], b[order]
        edge = np.searchsorted(row, np.arange(len(texts) + 1))
        done = [(i, *cutter(t, a[edge[k] : edge[k + 1]], b[edge[k] : edge[k + 1]] + plan.window)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return pa.table({n: pa.array(c, kind) for (n, kind), c in zip(names, zip(*done, strict=True) if done else [()] * len(names), strict=True)})

    return run


def remove_repeats(docs: DataFrame, ident: str, text: str, unit: str, window: int, gram: int, first_stays: bool, resolver: Callable, cutter: Callable, columns: str, hot: int = HOT) -> DataFrame:
    """Runs the exchange over docs; cutter(text, span starts, span ends) gives the columns of a text."""
    n = max(1, -(-text_bytes(docs, text) // CHUNK_BYTES))
    plan = Plan(unit, window, gram, int(n), hot)
    rows = docs.select(F.pmod(F.xxhash64(F.col(ident), F.col(text)), F.lit(plan.n)).cast("int").alias("dest"), F.col(ident).alias("doc"), order_number(docs, ident).alias("num"), F.col(text).alias("t"))
    chunks = rows.groupBy("dest")
    told = chunks.applyInArrow(_announce(plan), MESSAGE)
    known = told.groupBy("dest").applyInArrow(_answer(plan), MESSAGE)
    sent = chunks.cogroup(known.groupBy("dest")).applyInArrow(_send(plan, first_stays), MESSAGE)
    gone = sent.groupBy("dest").applyInArrow(_resolve(plan, first_stays, resolver), MESSAGE)
    made = [(c.split()[0], {"long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in columns.split(", ")]
    return chunks.cogroup(gone.groupBy("dest")).applyInArrow(_cut(plan, cutter, made), f"doc {dict(docs.dtypes)[ident]}, {columns}").withColumnRenamed("doc", ident)
