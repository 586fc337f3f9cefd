"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct pre-tokens of a batch that were not seen
before lie end to end in one ragged array of symbols. In each round every sequence
applies its own lowest-rank pair, at all places at once, and drops out when it has no
pair left; what survives is its token count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.json"
#: The pattern of this vocabulary's pre-tokenizer; the classes are Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
#: Text worked on at once, and pre-tokens remembered by a worker (both bound memory, not results).
BATCH_BYTES = 2_000_000
CACHE = 400_000
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def require_known(spec: dict) -> None:
    """An error for a vocabulary that is not counted as this module counts: by bytes, with PATTERN, and merges alone."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    by_bytes = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    special = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec.get("added_tokens", []))
    if spec.get("normalizer") is not None or not (by_bytes and plain and special):
        raise ValueError("a vocabulary with another normalizer, pre-tokenizer, model or kind of added tokens")


class Merges:
    """A byte-pair vocabulary as arrays: ranks and results of pairs, found by hash."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        require_known(spec)
        letters = byte_letters()
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = set(letters)
        for a, b in pairs:
            # A pair is only of symbols made before it, so that no merge brings up a lower rank.
            if a not in made or b not in made:
                raise ValueError("merges are not in the order of their parts")
            made.add(a + b)
        key = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.uint64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.bits = 20
        self.keys = np.full(1 << self.bits, np.uint64(2**63), np.uint64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.tries = 0
        left = np.arange(len(key))
        while len(left):
            slot = self._slot(key[left], self.tries)
            first = np.full(1 << self.bits, -1, np.int64)
            first[slot[::-1]] = left[::-1]
            wins = (first[slot] == left) & (self.ranks[slot] == NONE)
            self.keys[slot[wins]], self.ranks[slot[wins]] = key[left[wins]], left[wins]
            left = left[~wins]
            self.tries += 1

    def _slot(self, key: np.ndarray, k: int) -> np.ndarray:
        return ((key + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(17) | b.astype(np.uint64)
        slot = self._slot(key, 0)
        hit = self.keys[slot] == key
        out = np.where(hit, self.ranks[slot], NONE)
        miss = np.flatnonzero(~hit & (self.ranks[slot] != NONE))
        for k in range(1, self.tries):
            if not len(miss):
                break
            slot = self._slot(key[miss], k)
            hit = self.keys[slot] == key[miss]
            out[miss[hit]] = self.ranks[slot[hit]]
            miss = miss[~hit & (self.ranks[slot] != NONE)]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word (none is empty) when no pair can be merged."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), lengths)
        if not len(sym):
            return out

        def pair_ranks(s: np.ndarray, q: np.ndarray) -> np.ndarray:
            r = np.full(len(s), NONE, np.int32)
            r[:-1] = self.rank(s[:-1], s[1:])
            r[:-1][q[:-1] != q[1:]] = NONE
            return r

        rank = pair_ranks(sym, seq)
        while len(sym):
            head = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            length = np.diff(np.append(head, len(sym)))
            low = np.minimum.reduceat(rank, head)
            done = low == NONE
            if done.any():
                out[seq[head[done]]] = length[done]
                stay = np.repeat(~done, length)
                sym, seq, rank = sym[stay], seq[stay], rank[stay]
                if not len(sym):
                    break
                low, length = low[~done], length[~done]
            hit = rank == np.repeat(low, length)
            # Of overlapping hits (a run of one symbol), the first, third and so on count.
            at = np.flatnonzero(hit)
            if len(at) > 1:
                step = np.diff(at) == 1
                if step.any():
                    start = np.concatenate(([True], ~step))
                    offset = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                    at = at[offset % 2 == 0]
            sym[at] = self.result[rank[at]]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            fresh = np.zeros(len(sym), bool)
            fresh[at] = True
            stay = ~gone
            sym, seq, rank, fresh = sym[stay], seq[stay], rank[stay], fresh[stay]
            # Only pairs that touch a merged symbol have changed.
            at = np.flatnonzero(fresh)
            at = np.union1d(at, np.maximum(at - 1, 0))
            nxt = np.minimum(at + 1, len(sym) - 1)
            r = self.rank(sym[at], sym[nxt])
            r[(seq[at] != seq[nxt]) | (nxt == at)] = NONE
            rank[at] = r
        return out


_loaded: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def token_counter(path: str):
    """texts -> token counts, with a bounded memory of pre-tokens."""
    bpe, words, known = merges(path), regex.compile(PATTERN), {}
    special = regex.compile("|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True)))) if bpe.special else None

    def count(texts: list[str]) -> list[int]:
        nonlocal known
        parts, extra = [], []
        for t in texts:
            if special and (cut := special.split(t)) and len(cut) > 1:
                extra.append(len(cut) - 1)
                parts.append([w for c in cut for w in words.findall(c)])
            else:
                extra.append(0)
                parts.append(words.findall(t))
        new = {w for p in parts for w in p if w not in known}
        if new:
            if len(known) + len(new) > CACHE:
                known = {}
                new = {w for p in parts for w in p}
            new = list(new)
            known.update(zip(new, bpe.counts([w.encode() for w in new]).tolist(), strict=True))
        get = known.__getitem__
        return [e + sum(map(get, p)) for e, p in zip(extra, parts, strict=True)]

    return count


def count_tokens(docs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: ident, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens). Rows may repeat, ident may be null,
    other columns are not read. Texts of any length are counted whole.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    name = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary)
        for batch in batches:
            texts, sizes = batch.column(1), batch.column(2).to_pylist()
            start = 0
            while start < len(sizes):
                end, held = start, 0
                while end < len(sizes) and (end == start or held + sizes[end] <= BATCH_BYTES):
                    held += sizes[end]
                    end += 1
                n = count(texts.slice(start, end - start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), batch.column(2).slice(start, end - start), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    names=["ident", "n_bytes", "n_tokens", "over_limit"],
                )
                start = end

    rows = docs.select(F.col(ident).alias("ident"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b"))
    return rows.mapInArrow(run, f"ident {name}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("ident", ident)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
