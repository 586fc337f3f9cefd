"""Suffix-array deduplication of bytes by a hash-compared suffix sort.

The contexts of a repeated anchor (see repeats.py) are sorted by the suffix that starts at
the anchor, in a mergesort whose comparisons find the common extension of two suffixes by
binary search over prefix polynomial hashes: a few hash probes for each comparison, however
long the extension. Neighbours in the sorted order get their common length and their order
checked byte by byte against collisions. A window that starts q bytes before its anchor is repeated if some
context in the same run of common length WINDOW - q or more has the same q bytes before the
anchor. All occurrences of a repeated window go.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import mix64, table
from .repeats import Contexts, Plan, covered, remove_repeats
from .textunits import BYTE_VALUE, powers, prefix_hashes

WINDOW, GRAM = 200, 64


class Suffixes:
    """Suffixes of a byte string, each with a length of its own, compared by hashes."""

    def __init__(self, data: bytes, start: np.ndarray, length: np.ndarray):
        self.raw = np.frombuffer(data, np.uint8)
        self.prefix = prefix_hashes(BYTE_VALUE[self.raw])
        self.down = powers(len(self.prefix), "down")
        self.start, self.length = start, length
        self.collisions = 0

    def hash(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.prefix[at + n] - self.prefix[at]) * self.down[at]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffixes x and y, by binary search."""
        low = np.zeros(len(x), np.int64)
        high = np.minimum(self.length[x], self.length[y])
        top = int(high.max()) if len(high) else 0
        a, b = self.start[x], self.start[y]
        for _ in range(top.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hash(a, mid) == self.hash(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """x < y, or x <= y where or_equal is set; a suffix that ends is smaller."""
        n = self.common(x, y)
        end = len(self.raw) - 1
        cx = np.where(n < self.length[x], self.raw[np.minimum(self.start[x] + n, end)].astype(np.int16), -1)
        cy = np.where(n < self.length[y], self.raw[np.minimum(self.start[y] + n, end)].astype(np.int16), -1)
        return (cx < cy) | or_equal & (cx == cy)

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order by (group, suffix): a mergesort, all pairs of runs of a level at once."""
        order = np.argsort(group, kind="stable")
        g = group[order]
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(g)))
        level = 0
        while len(size) and (1 << level) < size.max():
            run = 1 << level
            use = np.flatnonzero(size > run)
            at = np.repeat(head[use], size[use])
            many = np.repeat(size[use], size[use])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(size[use]) - size[use], size[use])
            block = inside >> level
            left = block % 2 == 0
            # The other run of this element's pair, within its group.
            lo = np.where(left, (block + 1) << level, (block - 1) << level)
            hi = np.minimum(lo + run, many)
            lo = np.minimum(lo, many)
            first = lo.copy()
            mine = order[at + inside]
            last = hi.copy()
            open_ = np.flatnonzero(first < last)
            while len(open_):
                mid = (first[open_] + last[open_]) >> 1
                other = order[at[open_] + mid]
                # Elements of the left run go before equal ones of the right run.
                before = self.less(other, mine[open_], ~left[open_])
                first[open_] = np.where(before, mid + 1, first[open_])
                last[open_] = np.where(before, last[open_], mid)
                open_ = open_[first[open_] < last[open_]]
            pair = np.where(left, block, block - 1) << level
            own = inside - (block << level)
            new = order.copy()
            new[at + pair + own + (first - lo)] = mine
            order = new
            level += 1
        return order

    def checked(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n, with those cut short that only a collision of hashes had made so long."""
        n = n.copy()
        for k in range(0, len(x), 4096):
            i = slice(k, k + 4096)
            width = np.arange(int(n[i].max())) if len(n[i]) else np.zeros(0, np.int64)
            end = len(self.raw) - 1
            differs = (self.raw[np.minimum(self.start[x[i], None] + width, end)] != self.raw[np.minimum(self.start[y[i], None] + width, end)]) & (width < n[i, None])
            bad = np.flatnonzero(differs.any(axis=1))
            if len(bad):
                self.collisions += len(bad)
                n[k + bad] = differs[bad].argmax(axis=1)
        return n


    def sorted_and_common(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order by (group, suffix) and each suffix's common beginning with the one before it in its group, both of the bytes themselves.

        Hashes may only find a beginning too long, so an order whose neighbours are in order byte by byte is right;
        another, which a collision led astray, is sorted again by the bytes.
        """
        order = self.sort(group)
        for again in (False, True):
            common = np.zeros(len(order), np.int64)
            x, y = order[:-1], order[1:]
            one = group[x] == group[y]
            found = np.minimum(self.length[x], self.length[y]) if again else self.common(x, y)
            n = np.where(one, self.checked(x, y, np.where(one, found, 0)), 0)
            end = len(self.raw) - 1
            cx = np.where(n < self.length[x], self.raw[np.minimum(self.start[x] + n, end)].astype(np.int16), -1)
            cy = np.where(n < self.length[y], self.raw[np.minimum(self.start[y] + n, end)].astype(np.int16), -1)
            common[1:] = n
            if again or not (one & (cx > cy)).any():
                break
            raw = self.raw.tobytes()
            order = np.array(sorted(range(len(order)), key=lambda i: (group[i], raw[self.start[i] : self.start[i] + self.length[i]])), np.int64)
        return order, common


def resolve(ctx: Contexts, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """All windows that occur in two contexts or more."""
    w = plan.window
    begin = np.cumsum(ctx.length) - ctx.length
    right = Suffixes(ctx.data, begin + ctx.anchor, ctx.length - ctx.anchor)
    order, common = right.sorted_and_common(ctx.key)
    least, most = (ctx.anchor - ctx.more)[order], ctx.anchor[order]
    at = (begin + ctx.anchor)[order]
    out_i, out_j, out_rep = [], [], []
    for q in range(int(most.max()) + 1 if len(most) else 0):
        has = np.flatnonzero((least <= q) & (q <= most))
        if len(has) < 2:
            continue
        run = np.cumsum(common < w - q)[has]
        label = mix64(run.astype(np.uint64) ^ mix64(right.hash(at[has] - q, np.full(len(has), q))))
        by = np.argsort(label, kind="stable")
        lab = label[by]
        same = np.zeros(len(lab) + 1, bool)
        same[1:-1] = lab[1:] == lab[:-1]
        twice = by[same[:-1] | same[1:]]
        if len(twice):
            first = np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(lab))))[same[:-1] | same[1:]]
            out_i.append(has[twice])
            out_j.append(np.full(len(twice), q))
            out_rep.append(has[by[first]])
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, q, rep = np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_rep)
    good = _same_before(right.raw, at, i, rep, q)
    i, q = i[good], q[good]
    return order[i], ctx.anchor[order[i]] - q


def _same_before(raw: np.ndarray, at: np.ndarray, i: np.ndarray, rep: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q bytes before the anchors of i and rep really are the same; looked at once for each pair, at its largest q."""
    if not len(i):
        return np.zeros(0, bool)
    pair = i * np.int64(len(at)) + rep
    order = np.lexsort((q, pair))
    p = pair[order]
    tail = np.flatnonzero(np.concatenate((p[1:] != p[:-1], [True])))
    x, y, n = i[order[tail]], rep[order[tail]], q[order[tail]]
    far = np.zeros(len(tail), np.int64)  # common bytes before the anchors
    for k in range(0, len(tail), 8192):
        s = slice(k, k + 8192)
        width = np.arange(1, int(n[s].max()) + 1)
        differs = (raw[np.maximum(at[x[s], None] - width, 0)] != raw[np.maximum(at[y[s], None] - width, 0)]) & (width <= n[s, None])
        far[s] = np.where(differs.any(axis=1), differs.argmax(axis=1), n[s])
    size = np.diff(np.concatenate(([-1], tail)))
    good = np.empty(len(i), bool)
    good[order] = q[order] <= np.repeat(far, size)
    return good


def cut_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    if not len(starts):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    gone = covered(len(text), starts, ends)
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def remove_repeated_bytes(docs: DataFrame, ident: str = "doc_id", text: str = "text", **tuning: int) -> DataFrame:
    """One row per row of docs: ident, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty. Rows that share an id, or have none, are texts of their own.
    """
    return remove_repeats(docs, ident, text, "byte", WINDOW, GRAM, False, resolve, cut_bytes, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", **tuning)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document without strings of 200 bytes that occur elsewhere."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text"))
