"""The jobs as queries: each runs twice into one new folder and gives what then stands there. With the same questions in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.functions.session import shared_dir
from sweepgrid.queries.carriers import POLAR

from . import page_catalogue, scan_volumes


def job1_scan_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the volumes of all scans. SQL states no phase correlation, so frames are not registered here."""
    out = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        scan_volumes.run(spark, f"{sf_dir}/embeddings.parquet", f"{out}/volumes", f"{out}/reports", registration=False)
    got = spark.read.parquet(f"{out}/volumes").join(spark.read.parquet(f"{out}/reports").select("scan_id", "cut", "cells"), "scan_id")
    return got.select("scan_id", "slab", "cut", "cells", "ix", "iy", "iz", (F.round("v", 5) + 0.0).alias("v"))


def job2_page_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of all pages, with the figures of their hosts."""
    out = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        page_catalogue.run(spark, f"{sf_dir}/pages.parquet", f"{out}/catalogue", f"{out}/hosts", f"{out}/checkpoint")
    hosts = spark.read.parquet(f"{out}/hosts").select("host", F.col("pages").alias("host_pages"), F.col("new_contents").alias("host_contents"))
    rows = page_catalogue.catalogue_of(spark, f"{out}/catalogue").join(hosts, "host")
    return rows.select("page_id", "host", "folder", "name", "number", "n_bytes", "digest", "first_id", "is_new", "host_pages", "host_contents")


QUERIES = {f.__name__: f for f in (job1_scan_volumes, job2_page_catalogue)}

PI2, FAN = "2 * pi()", "radians(CAST(52 AS DOUBLE))"
CORR = "(sum(x.v * y.v) - sum(x.v) * sum(y.v) / count(*)) / (sqrt(greatest(sum(x.v * x.v) - sum(x.v) * sum(x.v) / count(*), 0) * greatest(sum(y.v * y.v) - sum(y.v) * sum(y.v) / count(*), 0)) + 1e-12)"

ORACLE_JOB1 = f"""
WITH {POLAR},
st AS (SELECT CAST(k // 8 AS INT) AS scan_id, CAST(k % 8 AS INT) AS k, r, p, v FROM pol),
lab AS (SELECT CAST(vec_id // 128 AS INT) AS scan_id, coalesce(min(label), 0) AS lab FROM embeddings GROUP BY 1),
sc AS (SELECT scan_id, n, CAST(CASE ((lab % 3) + 3) % 3 WHEN 0 THEN 16 WHEN 1 THEN 18 ELSE 20 END AS DOUBLE) AS depth FROM (SELECT scan_id, max(k) + 1 AS n FROM st GROUP BY 1) JOIN lab USING (scan_id)),
dp AS (SELECT *, depth / CAST(16 AS DOUBLE) AS dr, CAST(ceil(2 * depth / CAST(2 AS DOUBLE)) AS INT) AS side FROM sc),
r0 AS (SELECT *, least(greatest(round_even(CAST(15 AS DOUBLE) / dr, 0), 0), 15) AS r0 FROM dp),
roi AS (SELECT *, least(greatest(round_even(CAST(35 AS DOUBLE) / dr, 0), r0 + 1), 16) AS r1 FROM r0),
adj AS (
  SELECT y.scan_id AS scan_id, y.k AS k, {CORR} AS corr
  FROM st x JOIN st y ON x.scan_id = y.scan_id AND x.r = y.r AND x.p = y.p AND y.k = x.k + 1 JOIN roi ON roi.scan_id = x.scan_id
  WHERE x.r >= r0 AND x.r < r1 AND x.p % 4 = 0 GROUP BY 1, 2
),
ct AS (
  SELECT dp.scan_id AS scan_id, n, depth, dr, side, coalesce(arg_max(k, (corr, -k)) FILTER (n >= 6 AND k >= 2 AND k <= n - 2), 0) AS cut
  FROM dp LEFT JOIN adj ON adj.scan_id = dp.scan_id GROUP BY 1, 2, 3, 4, 5
),
rl AS (SELECT scan_id, CAST((k - cut + n) % n AS INT) AS k, r, p, v, n FROM st JOIN ct USING (scan_id)),
bl AS (SELECT *, CASE WHEN n > 4 AND k < 2 THEN k WHEN n > 4 AND k >= n - 2 THEN k - n + 2 END AS slot FROM rl),
mt AS (SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w) AS other, 0.5 - 0.5 * cos(pi() * slot / 2) AS w FROM bl WINDOW w AS (PARTITION BY scan_id, slot, r, p ORDER BY k)),
fin AS (SELECT scan_id, k, r, p, n, CASE WHEN slot IS NULL THEN v ELSE (1 - w) * v + w * other END AS v FROM mt),
padded AS (
  SELECT scan_id, k + 1 AS k, r, p, v FROM fin UNION ALL SELECT scan_id, k - n + 1, r, p, v FROM fin WHERE k >= n - 1 UNION ALL SELECT scan_id, k + n + 1, r, p, v FROM fin WHERE k < 1
),
kn AS (SELECT scan_id, i, {PI2} * i / greatest(n - 1, 1) AS t FROM ct, range(8) q(i) WHERE i < n),
kl AS (SELECT scan_id, list(t ORDER BY i) AS ts, greatest(max(t) - min(t), 1e-6) AS span, min(t) AS first FROM kn GROUP BY 1),
kp AS (SELECT scan_id, list_concat(list_concat([ts[-1] - span], ts), [ts[1] + span]) AS ts, span, first FROM kl),
ax AS (SELECT scan_id, CAST(i AS INT) AS i, CAST(CAST(-depth + CAST(2 AS DOUBLE) * depth * i / (side - 1) AS FLOAT) AS DOUBLE) AS x FROM ct, range(64) q(i) WHERE i < side),
g AS (SELECT a.scan_id, a.i AS ix, b.i AS iy, c.i AS iz, a.x AS x, b.x AS y, c.x AS z, sqrt(b.x ** 2 + c.x ** 2) AS rho FROM ax a JOIN ax b ON a.scan_id = b.scan_id JOIN ax c ON a.scan_id = c.scan_id),
ce AS (
  SELECT g.scan_id, ix, iy, iz, sqrt(x ** 2 + rho ** 2) AS r_mm, atan2(rho, x) AS phi, CASE WHEN atan2(z, y) < 0 THEN atan2(z, y) + {PI2} ELSE atan2(z, y) END AS psi, depth, dr, n
  FROM g JOIN ct USING (scan_id) WHERE sqrt(x ** 2 + rho ** 2) <= depth AND atan2(rho, x) >= 0 AND atan2(rho, x) <= {FAN}
),
th AS (SELECT ce.*, ts, least(greatest(psi / ({PI2}) * span + first, ts[1]), ts[n + 2]) AS theta FROM ce JOIN kp USING (scan_id)),
att AS (SELECT *, len(list_filter(ts, lambda x: x <= theta)) AS j FROM th),
pos AS (
  SELECT scan_id, ix, iy, iz, least(greatest(r_mm / dr, 0), 15 - 1e-3) AS ri, least(greatest(phi / ({FAN} / 63), 0), 63 - 1e-3) AS pi_,
    least(greatest(CASE WHEN j = 0 THEN 0 WHEN j >= n + 2 THEN n + 1 ELSE (j - 1) + (theta - ts[j]) / CASE WHEN ts[j + 1] > ts[j] THEN ts[j + 1] - ts[j] ELSE 1 END END, 0), n + 1 - 1e-6) AS ki
  FROM att
),
cor AS (
  SELECT scan_id, ix, iy, iz, CAST(floor(ri) AS INT) + a AS r, CAST(floor(pi_) AS INT) + b AS p, CAST(floor(ki) AS INT) + c AS k,
    (CASE a WHEN 1 THEN ri - floor(ri) ELSE 1 - (ri - floor(ri)) END) * (CASE b WHEN 1 THEN pi_ - floor(pi_) ELSE 1 - (pi_ - floor(pi_)) END) * (CASE c WHEN 1 THEN ki - floor(ki) ELSE 1 - (ki - floor(ki)) END) AS w
  FROM pos, range(2) t1(a), range(2) t2(b), range(2) t3(c)
),
vox AS (SELECT scan_id, ix, iy, iz, sum(w * coalesce(v, 0)) AS v FROM cor LEFT JOIN padded USING (scan_id, r, p, k) GROUP BY 1, 2, 3, 4)
SELECT scan_id, CAST(ix // 8 AS INT) AS slab, CAST(cut AS INT) AS cut, count(*) OVER (PARTITION BY scan_id) AS cells, ix, iy, iz, round(v, 5) + 0.0 AS v FROM vox JOIN ct USING (scan_id)
"""

ORACLE_JOB2 = r"""
WITH u AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '/+$', '') AS path FROM pages WHERE page_id IS NOT NULL),
s AS (SELECT page_id, html, regexp_extract(path, '^[A-Za-z]+://([^/]*)', 1) AS host, regexp_replace(path, '^[A-Za-z]+://[^/]*/?', '') AS rest FROM u),
n AS (SELECT page_id, html, host, regexp_replace(rest, '/?[^/]*$', '') AS folder, regexp_replace(string_split(rest, '/')[-1], '\.[^.]*$', '') AS name FROM s),
d AS (SELECT *, CASE WHEN regexp_matches(name, '^\s*[+-]?\d+\s*$') THEN regexp_extract(name, '^\s*([+-]?)0*(\d+)\s*$', 2) END AS number, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, substr(sha1(html), 1, 12) AS digest FROM n)
SELECT page_id, host, folder, name, number, n_bytes, digest, min(page_id) OVER c AS first_id, page_id = min(page_id) OVER c AS is_new, count(*) OVER h AS host_pages,
  count(*) FILTER (page_id = (SELECT min(page_id) FROM d e WHERE e.digest = d.digest)) OVER h AS host_contents
FROM d WINDOW c AS (PARTITION BY digest), h AS (PARTITION BY host)
"""

ORACLE = {"job1_scan_volumes": ORACLE_JOB1, "job2_page_catalogue": ORACLE_JOB2}
