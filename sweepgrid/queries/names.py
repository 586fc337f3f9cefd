"""Names, keys and text scalars, over documents, pages, orders and made-up folder names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, scalars
from ..functions.quantiles import ranked
from . import query
from .carriers import read, rnd

#: Made-up folder names; the number is a customer's.
FOLDERS = ["Lens 12 mm - Radial - OD - Secondary - 03-14-2021 - 08-05", "bulb_LEFT_pass 21-15", "model-9 MM--Primary OS", "L_left-globe", "bare name", "Secondary  Radial Primary", "set_OS_Radial_05-06-2023", "x _ y - 7mm radial"]
FOLDER_SQL = "fold AS (SELECT i, n || ' ' || k AS name FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(FOLDERS)) + ") t(i, n), (SELECT DISTINCT c_custkey AS k FROM customer))"


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct()
    return k.select(F.posexplode(F.array(*map(F.lit, FOLDERS))).alias("i", "n"), "k").select("i", F.concat("n", F.lit(" "), F.col("k").cast("string")).alias("name"))


@query(f"""WITH {FOLDER_SQL}, w AS (SELECT i, name, list_filter(regexp_split_to_array(upper(name), '[-_\\s]+'), lambda x: x IN ('OD', 'RIGHT', 'R', 'OS', 'LEFT', 'L'))[1] AS t FROM fold)
SELECT i, name, CASE WHEN t IN ('OD', 'RIGHT', 'R') THEN 'OD' WHEN t IS NOT NULL THEN 'OS' END AS eye FROM w""")
def eye_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir).select("i", "name", names.eye_token(F.col("name")).alias("eye"))


_NOISE = ", ".join(f"'{w.lower()}'" for w in names.NOISE_WORDS)
_PARTS = f"list_filter(regexp_extract_all(name, '{names.NAME_PARTS}'), lambda p: NOT regexp_full_match(p, '\\d{{2}}-\\d{{2}}(-\\d{{4}})?') AND lower(p) NOT IN ({_NOISE}))"
_CLEAN = f"regexp_replace(array_to_string(list_transform({_PARTS}, lambda p: CASE WHEN regexp_full_match(p, '\\d+\\s*[mM][mM]') THEN regexp_extract(p, '^\\d+') || 'mm' ELSE p END), ' '), ' ?_ ?', '_', 'g')"


@query(f"WITH {FOLDER_SQL} SELECT i, name, {_CLEAN} AS base FROM fold")
def clean_folder_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir).select("i", "name", names.clean_base(F.col("name")).alias("base"))


@query(f"""WITH {FOLDER_SQL}, w AS (SELECT i, name, list_filter(regexp_split_to_array(upper(name), '[-_\\s]+'), lambda x: x IN ('OD', 'RIGHT', 'R', 'OS', 'LEFT', 'L'))[1] AS t FROM fold)
SELECT i, name, {_CLEAN} || '_' || CASE WHEN t IN ('OD', 'RIGHT', 'R') THEN 'OD' WHEN t IS NOT NULL THEN 'OS' ELSE 'OS' END || '_EYE_VOL' AS prefix FROM w""")
def volume_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir).select("i", "name", names.volume_prefix(F.col("name"), F.lit("left eye")).alias("prefix"))


@query("""WITH f AS (SELECT o_custkey, 'vol_r' || printf('%02d', o_orderkey % 120) || '.nrrd' AS name FROM orders)
SELECT o_custkey, printf('r%02d', max(coalesce(TRY_CAST(nullif(regexp_extract(name, '_r(\\d{2})\\.nrrd$', 1), '') AS INT), 0)) + 1) AS suffix FROM f GROUP BY 1""")
def next_run_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.format_string("vol_r%02d.nrrd", F.col("o_orderkey") % 120).alias("name"))
    return rows.groupBy("o_custkey").agg(F.max(names.run_number(F.col("name"))).alias("n")).select("o_custkey", names.run_suffix(F.col("n")).alias("suffix"))


@query("""WITH s AS (SELECT page_id, regexp_replace(list_last(string_split(split_part(url, '?', 1), '/')), '\\.[^.]*$', '') AS stem FROM pages)
SELECT page_id, stem, row_number() OVER (ORDER BY CASE WHEN TRY_CAST(stem AS BIGINT) IS NULL THEN 1 ELSE 0 END, TRY_CAST(stem AS BIGINT), stem, page_id) AS rank FROM s""")
def numeric_name_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = names.stem(F.element_at(F.split("url", r"\?"), 1))
    rows = read(spark, sf_dir, "pages").select("page_id", stem.alias("stem"))
    return ranked(rows, [*names.numeric_first_key(F.col("stem")), "page_id"], "rank").select("page_id", "stem", "rank")


@query("SELECT doc_id, coalesce(substr(sha1(text), 1, 12), '') AS sha FROM documents")
def content_sha1_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", names.sha1_12(F.col("text")).alias("sha"))


@query("SELECT p_partkey, 'slice_' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '.tif' AS slice, 'vol_' || printf('%.3f', p_size / 10.0) || 'mm.nrrd' AS vol FROM part")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", names.slice_name("slice", F.col("p_size")).alias("slice"), names.volume_name("vol", F.col("p_size") / 10.0).alias("vol"))


@query("""WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, CASE WHEN s // 86400 = 0 THEN '' WHEN s // 86400 = 1 THEN '1 day, ' ELSE (s // 86400) || ' days, ' END || ((s % 86400) // 3600) || ':' || lpad(CAST((s % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS t FROM s""")
def elapsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.hms(F.col("o_totalprice")).alias("t"))


@query("SELECT event_id, round((value / 7 + pi()) - floor((value / 7 + pi()) / (2 * pi())) * 2 * pi() - pi(), 6) + 0.0 AS a FROM events")
def angle_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", rnd(scalars.ang_norm(F.col("value") / 7)).alias("a"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS x1, l_discount AS y1, cos(l_quantity) AS a1, sin(l_quantity) AS b1, l_tax AS x2, 1.0 AS y2, cos(l_quantity * (l_linenumber % 3)) AS a2, sin(l_quantity * (l_linenumber % 3)) AS b2 FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(a1 * b2 - b1 * a2) >= 1e-9 THEN round(x1 + ((x2 - x1) * b2 - (y2 - y1) * a2) / (a1 * b2 - b1 * a2) * a1, 4) + 0.0 END AS x FROM l""")
def line_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("l_quantity"), F.col("l_quantity") * (F.col("l_linenumber") % 3)
    meet = scalars.line_intersection((q, F.col("l_discount"), F.cos(q), F.sin(q)), (F.col("l_tax"), F.lit(1.0), F.cos(t), F.sin(t)))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rnd(meet["x"], 4).alias("x"))


@query("SELECT l_orderkey, l_linenumber, round(-0.5 * l_quantity + 10, 6) + 0.0 AS r, round(-2.0 * l_discount - 5, 6) + 0.0 AS a, round(1.5 * l_tax + 2, 6) + 0.0 AS s FROM lineitem")
def ijk_to_ras(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scalars.ijk_to_ras((0.5, 2.0, 1.5), (-10.0, 5.0, 2.0))
    at = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(rnd(scalars.affine(row, *at)).alias(n) for row, n in zip(m, "ras", strict=False)))
