"""Fill-in-middle transformation by lookaround splitting.

A unit grammar is stated as the pairs of neighbouring character classes between which a unit
ends and the next begins. Each pair becomes a zero-width regular expression, a look behind for
the one class and a look ahead for the other, so that a split at its matches takes nothing
away: the pieces, joined, are the text. The cut points are hashed from the document's id, the
pieces are put in another order between sentinels, and the text is rebuilt from the output for
control. An empty text has no unit, where a split would give one empty piece.

All of it is one projection over a document: no row is moved, and reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed value: what separates words, as the body of a character class.
SPACE = r"\x20\x09-\x0D"
#: Unit grammars: between which neighbouring classes a unit ends.
GRAMMARS = {
    # Spaces and the word after them; spaces at the end stand alone.
    "word": ((f"[^{SPACE}]", f"[{SPACE}]"),),
    # A line with its line feed.
    "line": ((r"\n", r"[\s\S]"),),
    # A sentence with its stop; the spaces after it open the next one.
    "sentence": ((r"[.!?]", f"[{SPACE}]"), (r"\n", r"[\s\S]")),
    # Runs of letters or digits, and each run of anything else.
    "run": ((r"[\p{L}\p{M}\p{N}]", r"[^\p{L}\p{M}\p{N}]"), (r"[^\p{L}\p{M}\p{N}]", r"[\p{L}\p{M}\p{N}]")),
}
#: Sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"


@dataclass(frozen=True)
class Rates:
    """Of 100 texts so many are transformed, and of 100 of these so many begin with the suffix (spm)."""

    transformed: int = 50
    spm: int = 80


def boundary(grammar: str) -> str:
    """The zero-width regular expression of a grammar's boundaries."""
    return "|".join(f"(?<={left})(?={right})" for left, right in GRAMMARS[grammar])


def units(text: Column, grammar: str = "word") -> Column:
    """The units of a text; their concatenation is the text. A null or empty text has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _hashed(ident: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _joined(pieces: Column, start: Column, end: Column) -> Column:
    """Pieces start + 1 to end as one text."""
    return F.array_join(F.slice(pieces, start + 1, end - start), "")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from.

    Texts that hold a sentinel stay plain, and no sentinel can begin in one piece and end in the
    sentinel after it, so the output splits at its three sentinels alone.
    """
    part = F.split(output, SENTINEL, -1)
    at = lambda *order: F.concat(*[F.get(part, F.lit(i)) for i in order])
    return F.when(form == "psm", at(1, 3, 2)).when(form == "spm", at(2, 3, 1)).otherwise(output)


def fill_in_middle(docs: DataFrame, ident: str = "doc_id", text: str = "text", grammar: str = "word", seed: int = 42, rates: Rates = Rates()) -> DataFrame:
    """One row per row of docs: ident, n (units), form, prefix, middle, suffix, output.

    form is plain, psm or spm; prefix, middle and suffix are null where it is plain, which it is for
    empty texts and for those that hold a sentinel already. A null text counts as empty, a null id
    as the empty string: rows that share an id are cut by the same numbers. Prefix, middle
    and suffix may each be empty. Other columns are left out; an empty table stays empty.
    """
    h1, h2, h3, h4 = _hashed(F.col(ident), seed)
    t, n = F.col("t"), F.col("n")
    rows = docs.select(F.col(ident).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    cut = rows.withColumn("pieces", units(t, grammar))
    cut = cut.withColumn("n", F.size("pieces").cast("long"))
    cut = cut.withColumns({"a": F.least(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int"), "z": F.greatest(F.col("h1") % (n + 1), F.col("h2") % (n + 1)).cast("int")})
    plain = (t == "") | t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE) | (F.col("h3") % 100 >= rates.transformed)
    cut = cut.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < rates.spm, "spm").otherwise("psm"))
    some = lambda start, end: F.when(F.col("form") != "plain", _joined(F.col("pieces"), start, end))
    got = cut.select("id", "t", "n", "form", some(F.lit(0), F.col("a")).alias("prefix"), some(F.col("a"), F.col("z")).alias("middle"), some(F.col("z"), F.col("n").cast("int")).alias("suffix"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(t)
    return got.select(F.col("id").alias(ident), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op12_lookaround_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's transformation, as lengths and hashes of what it gives."""
    got = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    return got.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS k FROM d),
c AS (
  SELECT doc_id, t, w, len(w) AS n, least(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS a, greatest(k[1] % (len(w) + 1), k[2] % (len(w) + 1)) AS z,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 50 THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:z], '') AS middle, array_to_string(w[z + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
