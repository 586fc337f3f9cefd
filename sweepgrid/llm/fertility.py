"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback measures each text: characters per token, the share
of tokens that fall back to bytes, and the entropy of the token distribution. Prose stays
inside a band that depends on its language (or script, where the language is unknown);
junk, encoded data and repetition leave it. Counts that need no vocabulary are taken beside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, sub_batches, table

VOCABULARY = "piece_bpe_32k.model"
BATCH_BYTES = 1_000_000
CACHE = 300_000
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Bands by language, or by script where the language is unknown. Characters per token of n words scatter around a
#: language's centre with spread / sqrt(n), so a band is in units of that (n counts up to LENGTH_CAP): a text is
#: rejected below ``far`` units whatever its entropy, below ``near`` units if its token entropy (bits) is under
#: ``entropy`` as well, above ``top`` characters per token, and beyond ``fallback`` as share of byte-fallback tokens.
#: Centres and spreads are medians over the labelled good rows of the sf0.1 corpus (3,243 rows); the other figures leave
#: all but about 1 in 1,000 of those inside. A null centre switches the two lower limits off.
BANDS = {
    "en": {"centre": 2.219, "spread": 0.557, "far": -7.0, "near": -3.5, "entropy": 6.2, "top": 6.0, "fallback": 0.10},
    "de": {"centre": 2.243, "spread": 0.600, "far": -7.0, "near": -3.5, "entropy": 6.2, "top": 6.0, "fallback": 0.12},
    "fr": {"centre": 1.979, "spread": 0.572, "far": -7.0, "near": -3.5, "entropy": 6.2, "top": 6.0, "fallback": 0.12},
    "es": {"centre": 1.940, "spread": 0.547, "far": -7.0, "near": -3.5, "entropy": 6.2, "top": 6.0, "fallback": 0.12},
    "latin": {"centre": None, "spread": 1.0, "far": 0.0, "near": 0.0, "entropy": 0.0, "top": 8.0, "fallback": 0.20},
    "other": {"centre": None, "spread": 1.0, "far": 0.0, "near": 0.0, "entropy": 0.0, "top": 8.0, "fallback": 0.90},
}
LENGTH_CAP = 1000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_fallback long, token_entropy double, latin_share double"


class Pieces:
    """Words -> token ids, each word on its own, with a bounded memory."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) or self.model.is_unknown(i) for i in range(n)), bool, n)
        self.known: dict[bytes, np.ndarray] = {}

    def ids(self, words: list[bytes]) -> list[np.ndarray]:
        new = {w for w in words if w not in self.known}
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known, new = {}, set(words)
            listed = list(new)
            coded = self.model.encode([w.decode() for w in listed], num_threads=1)
            self.known.update((w, np.array(c, np.uint16)) for w, c in zip(listed, coded, strict=True))
        return [self.known[w] for w in words]


_pieces: dict[str, Pieces] = {}


def measure(texts: list[bytes], pieces: Pieces) -> list[np.ndarray | list]:
    """The measures of each text, as columns in the order of MEASURES."""
    n = len(texts)
    words = [t.split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, n)
    doc = np.repeat(np.arange(n), n_words)
    flat = [w for ws in words for w in ws]
    vocab: dict[bytes, int] = {}
    wid = np.fromiter((vocab.setdefault(w, len(vocab)) for w in flat), np.int64, len(flat))

    # Bytes: symbols, letters of the Latin script and code points in words.
    size = np.fromiter(map(len, texts), np.int64, n)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate(([0], np.cumsum(size)))

    def per_text(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flags)))
        return run[at[1:]] - run[at[:-1]]

    n_symbols, word_chars = per_text(SYMBOLS[raw]), per_text(~SPACE[raw] & ((raw & 0xC0) != 0x80))
    letters = (raw | 0x20) - np.uint8(97) < 26
    latin = per_text(letters | (raw >= 0xC3) & (raw <= 0xC9))  # lead bytes of U+00C0 to U+027F
    others = per_text(raw >= 0xCA)

    # Lines that have a word and equal an earlier one.
    dup_lines = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if not x.isspace() and x]
        dup_lines[i] = len(lines) - len(set(lines))

    # Words in windows of three that occur twice or more in the text.
    repeat = np.zeros(n, np.int64)
    if len(flat) >= 3:
        same = doc[2:] == doc[:-2]
        a, b, c = (mix64(wid[k : len(wid) - 2 + k].astype(np.uint64) + np.uint64((k + 1) << 40)) for k in range(3))
        gram = mix64(a ^ mix64(b ^ mix64(c ^ mix64(doc[:-2].astype(np.uint64)))))
        where = np.flatnonzero(same)
        order = where[np.argsort(gram[where], kind="stable")]
        g = gram[order]
        eq = np.zeros(len(g) + 1, bool)
        eq[1:-1] = g[1:] == g[:-1]
        twice = order[eq[:-1] | eq[1:]]
        covered = np.zeros(len(flat), bool)
        for k in range(3):
            covered[twice + k] = True
        repeat = np.bincount(doc[covered], minlength=n)

    # Tokens: each distinct word is tokenised once.
    coded = pieces.ids(list(vocab))
    length = np.fromiter(map(len, coded), np.int64, len(coded))
    back = np.fromiter((int(pieces.is_byte[c].sum()) for c in coded), np.int64, len(coded))
    n_tokens = np.bincount(doc, weights=length[wid], minlength=n).astype(np.int64)
    fallback = np.bincount(doc, weights=back[wid], minlength=n).astype(np.int64)
    entropy = np.zeros(n)
    if len(flat):
        start = np.concatenate(([0], np.cumsum(length)))
        ids = np.concatenate(coded).astype(np.int64)
        reps = length[wid]
        first = np.repeat(start[wid] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps)
        tokens = ids[first + np.arange(len(first))]
        key = np.sort(np.repeat(doc, reps) << 17 | tokens)
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(edge, len(key))).astype(float)
        of = key[edge] >> 17
        total = n_tokens[of].astype(float)
        entropy = np.bincount(of, weights=-count / total * np.log2(count / total), minlength=n)
    share = latin / np.maximum(latin + others, 1)
    return [n_words, word_chars, n_symbols, dup_lines, repeat, n_tokens, fallback, np.abs(entropy), share]


def quality(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str | None = "lang", bands: dict | None = None, vocabulary: str | None = None, keep: tuple[str, ...] = (), only_kept: bool = False) -> DataFrame:
    """One row per row of docs: ident (and the columns in keep), the counts, ``base_failed``, the
    fertility measures, ``reject_reason`` and ``kept``.

    A null or blank text has no words, so it fails the base rule. Null and unknown languages
    get the band of the text's script. Repeated rows are judged alike, each on its own.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    bands = bands or BANDS
    own = list(dict.fromkeys([ident, *keep]))
    kept = [f"__sg_k{i}" for i in range(len(own))]  # names of their own: a column of docs may be called as a measure
    fields = [f"`{k}` {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, own, strict=True)]
    language = F.col(lang) if lang else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _pieces:
            _pieces[vocabulary] = Pieces(vocabulary)
        pieces = _pieces[vocabulary]
        for batch in batches:
            col, done = batch.column(len(kept) + 1), 0
            for some in sub_batches(range(len(col)), (x.as_buffer().to_pybytes() if x.is_valid else None for x in col), BATCH_BYTES):
                got = measure([t for _, t in some], pieces)
                part = batch.slice(done, len(some))
                done += len(some)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept) + 1], *map(pa.array, got)], names=[*kept, "__sg_lang", *(x.split()[0] for x in MEASURES.split(", "))])

    rows = docs.select(*(F.col(f"`{c}`").alias(k) for k, c in zip(kept, own, strict=True)), language.alias("__sg_lang"), F.col(text).alias("__sg_text"))
    got = rows.mapInArrow(run, ", ".join([*fields, "__sg_lang string", MEASURES]))
    named = [b for b in bands if b not in ("latin", "other")]
    band = F.when(F.col("__sg_lang").isin(named), F.col("__sg_lang")).when(F.col("latin_share") >= 0.5, "latin").otherwise("other")

    def limit(k: str):
        out = F.lit(None).cast("double")
        for name, values in bands.items():
            out = F.when(F.col("band") == name, F.lit(values[k]).cast("double")).otherwise(out)
        return out

    got = got.withColumn("band", band)
    got = got.withColumns({"chars_per_token": F.col("word_chars") / F.greatest("n_tokens", F.lit(1)), "fallback_share": F.col("n_fallback") / F.greatest("n_tokens", F.lit(1))})
    units = (F.col("chars_per_token") - limit("centre")) * F.sqrt(F.least("n_words", F.lit(LENGTH_CAP)).cast("double")) / limit("spread")
    got = got.withColumn("fertility_units", units)
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))
    reason = (
        F.when(failed, "base")
        .when(F.col("fertility_units") < limit("far"), "few characters per token")
        .when((F.col("fertility_units") < limit("near")) & (F.col("token_entropy") < limit("entropy")), "few characters per token at low entropy")
        .when(F.col("chars_per_token") > limit("top"), "many characters per token")
        .when(F.col("fallback_share") > limit("fallback"), "byte fallback")
    )
    got = got.withColumns({"base_failed": failed, "reject_reason": reason}).withColumn("kept", F.col("reject_reason").isNull()).drop("__sg_lang")
    if only_kept:
        return got.where("kept").select(*(F.col(k).alias(c) for k, c in zip(kept, own, strict=True)))
    return got.withColumnsRenamed(dict(zip(kept, own, strict=True)))


def quality_rows(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str | None = "lang", bands: dict | None = None, vocabulary: str | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    got = quality(docs, ident, text, lang, bands, vocabulary, tuple(docs.columns), only_kept=True)
    return got.select(*(f"`{c}`" for c in docs.columns))


def op5_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, measures and verdict of every document."""
    got = quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "fertility_units", "band", "reject_reason",
    )
