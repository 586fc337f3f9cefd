"""Every query with SQL gives the rows that its SQL gives; the others give rows."""

import math
import os

import duckdb
import numpy as np
import pytest

from sweepgrid.queries import ORACLE, QUERIES
from sweepgrid.queries.mesh import LEVELS

from .conftest import DATA
from .test_engine import plain_distances

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_strictly_increasing_reads_all_users(spark, duck):
    want, last = [], {}
    for user, value in duck.execute("SELECT user_id, value FROM events ORDER BY user_id, ts, event_id").fetchall():
        i, before = last.get(user, (-1, None))
        v = float(value) if before is None or value > before else before + 1e-6
        last[user] = i + 1, v
        want.append((user, i + 1, v))
    got = sorted(map(tuple, QUERIES["strictly_increasing"](spark, DATA).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-6)


@pytest.fixture(scope="module")
def long_field(duck, tmp_path_factory):
    """A table whose height field is longer than the edges that the SQL follows, the last frame not full: its folder, corners, faces and links."""
    where, m = tmp_path_factory.mktemp("long"), 16
    duck.execute(f"COPY (SELECT vec_id + 500 * i AS vec_id, embedding, label FROM embeddings, range(4) t(i) WHERE vec_id + 500 * i < 1989) TO '{where}/embeddings.parquet' (FORMAT parquet)")
    heights = dict(duck.execute(f"SELECT vec_id, 40 * list_avg(embedding::DOUBLE[]) FROM read_parquet('{where}/embeddings.parquet')").fetchall())
    n = max(heights) // m + 1
    assert n > LEVELS and len(heights) % m
    at = {i * m + j: (float(i), float(j), heights.get(i * m + j, 0.0)) for i in range(n) for j in range(m)}
    tri = [t for i in range(n - 1) for j in range(m - 1) for a in [i * m + j] for t in ((a, a + m, a + 1), (a + 1, a + m, a + m + 1))]
    links = {}
    for t in tri:
        for a in t:
            links.setdefault(a, []).extend((b, math.dist(at[a], at[b])) for b in t if b != a)
    return str(where), at, tri, links


def test_area_vs_radius_over_a_field_longer_than_its_sql_follows(spark, long_field):
    folder, at, tri, links = long_field
    d, steps = plain_distances(links, {0}), {}
    for a, b, c in tri:
        radius = max(d[a], d[b], d[c])
        steps[radius] = steps.get(radius, 0.0) + float(np.linalg.norm(np.cross(np.subtract(at[b], at[a]), np.subtract(at[c], at[a])))) / 2
    got = sorted(map(tuple, QUERIES["area_vs_radius"](spark, folder).collect()))
    assert [r[0] for r in got] == pytest.approx(sorted(steps), abs=1e-5)
    assert [r[1] for r in got] == pytest.approx(np.cumsum([steps[r] for r in sorted(steps)]).tolist(), abs=1e-5)


def test_geodesic_single_over_a_field_longer_than_its_sql_follows(spark, long_field):
    """All vertices have their shortest way; the SQL has that of the ways of at most LEVELS edges and no other rows."""
    folder, at, _, links = long_field
    got = dict(map(tuple, QUERIES["geodesic_single"](spark, folder).collect()))
    assert got.keys() == at.keys()
    assert got == pytest.approx(plain_distances(links, {0}), abs=1e-6)
    con, near = duckdb.connect(), {0: 0.0}
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    for _ in range(LEVELS):
        for u, d in list(near.items()):
            for v, w in links[u]:
                near[v] = min(d + w, near.get(v, math.inf))
    short = dict(con.execute(ORACLE["geodesic_single"]).fetchall())
    assert short == pytest.approx(near, abs=1e-6)
    assert short.keys() < got.keys() and all(got[v] <= short[v] + 1e-6 for v in short)


@pytest.mark.parametrize("name", ["geodesic_single", "area_vs_radius"])
def test_long_field_gives_the_rows_of_the_sql_without_its_limit(spark, long_field, name):
    """The registered SQL with its LEVELS steps replaced by as many as change something gives what the query gives, row for row."""
    head, steps = ORACLE[name].split(", d0 AS (", 1)
    seed, tail = steps.split("), d1 AS (", 1)[0], steps.rsplit("GROUP BY vid)", 1)[1].replace(f"d{LEVELS}", "d")
    step = "SELECT dst, min(n.d + w) FROM d n JOIN u ON src = n.vid LEFT JOIN recurring.d o ON o.vid = dst WHERE o.d IS NULL OR n.d + w < o.d GROUP BY dst"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{long_field[0]}/embeddings.parquet')")
    want = con.execute(f"{head.replace('WITH', 'WITH RECURSIVE', 1)}, d(vid, d) USING KEY (vid) AS ({seed} UNION {step}){tail}").df()
    assert len(want) > len(con.execute(ORACLE[name]).df())
    assert rows(QUERIES[name](spark, long_field[0]).toPandas()) == rows(want)
