"""Substring deduplication by prefix-partitioned suffix trees over words.

Suffixes are grouped by the anchor that their first 20 words share (see repeats.py), a
prefix that is as long as it must be: groups that would outgrow memory are split by all
20 words. In each group the suffix tree is grown from the root, four words at a time:
suffixes that share a node's words move on together, and a node with one suffix left is
a leaf and is dropped. Words, runs of words and nodes are numbered by their content, not
by hashes alone, so equal numbers are equal words. The nodes at depth 20 are internal nodes
that are deep enough, and consecutive ones are the maximal repeats; all but the first
suffix below them go.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import mix64, table
from .repeats import Contexts, Plan, covered, remove_repeats
from .textunits import Words

WINDOW, GRAM = 20, 8
#: Words by which the tree is grown at once, a power of two.
STEP = 4


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each pair (a, b) of numbers by a number of its own, from 0."""
    if not len(a):
        return np.zeros(0, np.int64)
    pair = a * np.int64(int(b.max()) + 1) + b
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], pair[1:] != pair[:-1])))
    return out


def word_numbers(words: Words) -> np.ndarray:
    """Equal words have equal numbers, and no others; words of one hash are compared byte by byte."""
    _, number = np.unique(words.h, return_inverse=True)
    length = words.end - words.start
    order = np.argsort(number, kind="stable")
    x, y = order[:-1], order[1:]
    same = number[x] == number[y]
    x, y = x[same], y[same]
    differs = length[x] != length[y]
    raw = np.frombuffer(words.data, np.uint8)
    n = np.where(differs, 0, length[x])
    at = np.repeat(np.arange(len(x)), n)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    differs[at[raw[words.start[x[at]] + inside] != raw[words.start[y[at]] + inside]]] = True
    if differs.any():
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(words.data[a:b], len(seen)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)], np.int64)
    return number


def run_numbers(number: np.ndarray, step: int) -> np.ndarray:
    """Numbers of the runs of step words (a power of two) that start at each word, by doubling."""
    width = 1
    while width < step:
        ahead = np.concatenate([number[width:], np.zeros(min(width, len(number)), np.int64)])
        number, width = numbered(number, ahead), 2 * width
    return number


def grow(runs: np.ndarray, at: np.ndarray, node: np.ndarray, depth: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes (indices into at) that share depth words with another below their root node, and their nodes at that depth."""
    alive = np.arange(len(at))
    for deep in range(0, depth, step):
        node = numbered(node, runs[at[alive] + deep])
        inner = np.bincount(node)[node] > 1 if len(node) else np.zeros(0, bool)
        alive, node = alive[inner], node[inner]
    return alive, node


def resolve(ctx: Contexts, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """All but the first of each set of equal windows."""
    end = np.cumsum(ctx.length)
    parts = [ctx.data[a:b] for a, b in zip((end - ctx.length).tolist(), end.tolist(), strict=True)]
    words = Words(parts)
    many = ctx.more + 1
    i = np.repeat(np.arange(len(many)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    # Equal windows have their anchor at the same place: a root for each anchor and offset.
    _, root = np.unique(mix64(ctx.key[i] + (ctx.anchor[i] - j).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)), return_inverse=True)
    step = STEP if plan.window % STEP == 0 else 1
    alive, node = grow(run_numbers(word_numbers(words), step), words.first[i] + j, root, plan.window, step)
    i, j = i[alive], j[alive]
    order = np.lexsort((ctx.start[i] + j, ctx.row[i], ctx.origin[i], ctx.number[i], node))
    later = order[1:][node[order][1:] == node[order][:-1]]
    return i[later], j[later]


def cut_words(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    words = text.split()
    if not len(starts):
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    gone = covered(len(words), starts, ends)
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def remove_repeated_words(docs: DataFrame, ident: str = "doc_id", text: str = "text", **tuning: int) -> DataFrame:
    """One row per row of docs: ident, n_words, n_removed, kept_sha256.

    A null text has no words. Rows with a null id come last in the order of documents; rows that
    share an id are ordered by their text, and equal rows are copies of each other like any others.
    """
    return remove_repeats(docs, ident, text, "word", WINDOW, GRAM, True, resolve, cut_words, "n_words long, n_removed long, kept_sha256 string", **tuning)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of each document without repeats of 20 words."""
    return remove_repeated_words(table(spark, sf_dir, "documents", "doc_id", "text"))
