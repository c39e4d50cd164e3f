"""The registered queries and the SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cubewright.core.cube import KEY, Cube, cube_ev, cube_li
from cubewright.operators import fits, grid, maps, moments as M, preprocess as P

QUERIES: dict = {}
SQL: dict[str, str] = {}

LI = """
raw AS (SELECT CAST(l_suppkey % 8 AS INT) AS y, CAST(l_partkey % 8 AS INT) AS x, CAST(round(l_discount * 100) AS INT) AS i0,
               CAST(round(l_tax * 100) AS INT) AS i1, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL),
vox AS (SELECT 'li' AS scan_id, g.y, g.x, g.i0, g.i1, g.i0 * 0.01 AS c0, g.i1 * 0.01 AS c1, g.i0 * 9 + g.i1 AS frame, coalesce(r.v, 0) AS v
        FROM (SELECT CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x, CAST(c.i0 AS INT) AS i0, CAST(d.i1 AS INT) AS i1
              FROM range(8) a(y), range(8) b(x), range(11) c(i0), range(9) d(i1)) g LEFT JOIN raw r USING (y, x, i0, i1))"""
EV_ROWS = """
eraw AS (SELECT {scan} AS scan_id, CAST(user_id % 8 AS INT) AS y, CAST(floor(user_id / 8.0) % 8 AS INT) AS x, CAST(hour(ts) AS INT) AS i0,
                CAST(sum(round(value)) AS BIGINT) AS v FROM events GROUP BY ALL),
evox AS (SELECT g.scan_id, g.y, g.x, g.i0, CAST(g.i0 AS DOUBLE) AS c0, coalesce(r.v, 0) AS v
         FROM (SELECT s.scan_id, CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x, CAST(c.i0 AS INT) AS i0
               FROM (SELECT DISTINCT scan_id FROM eraw) s, range(8) a(y), range(8) b(x), range(24) c(i0)) g LEFT JOIN eraw r USING (scan_id, y, x, i0))"""
EV = EV_ROWS.format(scan="'ev'")
EV3 = EV_ROWS.format(scan="strftime(ts, '%Y-%m-%d')")
DARK = """
tot AS (SELECT frame, sum(v) AS t FROM vox GROUP BY frame),
dark AS (SELECT frame FROM tot ORDER BY t, frame LIMIT 5),
bg AS (SELECT y, x, CAST(round_even(avg(v), 0) AS BIGINT) AS bg FROM vox WHERE frame IN (SELECT frame FROM dark) GROUP BY y, x)"""
CLEAN = DARK + """,
sub AS (SELECT vox.* EXCLUDE (v), greatest(v, bg) - bg AS v FROM vox JOIN bg USING (y, x))"""
MOM = """
m1 AS (SELECT y, x, sum(v) AS s, CASE WHEN sum(v) > 0 THEN sum(v * c0) / sum(v) ELSE 0 END AS mu0, CASE WHEN sum(v) > 0 THEN sum(v * c1) / sum(v) ELSE 0 END AS mu1 FROM {t} GROUP BY y, x),
mom AS (SELECT y, x, any_value(s) AS s, any_value(mu0) AS mu0, any_value(mu1) AS mu1,
               CASE WHEN any_value(s) > 0 THEN sum(v * (c0 - mu0) * (c0 - mu0)) / any_value(s) ELSE 0 END AS v00,
               CASE WHEN any_value(s) > 0 THEN sum(v * (c0 - mu0) * (c1 - mu1)) / any_value(s) ELSE 0 END AS v01,
               CASE WHEN any_value(s) > 0 THEN sum(v * (c1 - mu1) * (c1 - mu1)) / any_value(s) ELSE 0 END AS v11
        FROM {t} JOIN m1 USING (y, x) GROUP BY y, x)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


def sql6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def clean_li(spark: SparkSession, sf_dir: str) -> Cube:
    cube = cube_li(spark, sf_dir)
    return P.subtract(cube, P.estimate_background(cube))


def _c(array: str, *at: int) -> Column:
    out = F.col(array)
    for i in at:
        out = F.get(out, F.lit(i))
    return out


@query(f"WITH {LI}, {CLEAN}, {MOM.format(t='sub')}, z AS (SELECT y, x, sum(v) AS z FROM sub GROUP BY y, x) "
       f"SELECT y, x, {sql6('mu0', 'mu0')}, {sql6('mu1', 'mu1')}, {sql6('sqrt(greatest(v00 + v11, 0))', 'mosaicity')} FROM mom JOIN z USING (y, x) WHERE z > 0.05 * (SELECT max(z) FROM z)")
def flagship(spark, sf_dir):
    """Background, clamped subtraction, grain mask, moments and mosaicity."""
    cube = clean_li(spark, sf_dir)
    mask = P.grain_mask(cube, close=0, fill=False)
    mom = M.moments(cube.masked(mask))
    return mom.join(maps.mosaicity(mom), list(KEY)).select("y", "x", r6(_c("mu", 0), "mu0"), r6(_c("mu", 1), "mu1"), r6("mosaicity", "mosaicity"))


@query(f"WITH {LI} SELECT y, x, CAST(sum(v) AS DOUBLE) AS zsum FROM vox GROUP BY y, x")
def z_sum(spark, sf_dir):
    return P.zsum(cube_li(spark, sf_dir)).select("y", "x", "zsum")


@query(f"WITH {LI}, {DARK} SELECT y, x, CAST(sum(v - bg) AS DOUBLE) AS zsum FROM vox JOIN bg USING (y, x) GROUP BY y, x")
def signed_z_sum(spark, sf_dir):
    cube = cube_li(spark, sf_dir)
    return P.signed_zsum(cube, P.estimate_background(cube)).select("y", "x", "zsum")


@query(f"WITH {LI}, {DARK} SELECT CAST(frame AS INT) AS frame FROM dark")
def darkest_frames(spark, sf_dir):
    return P.darkest_frames(cube_li(spark, sf_dir)).select(F.col("frame").cast("int").alias("frame"))


def _background(mode, **kw):
    def run(spark, sf_dir):
        return P.estimate_background(cube_li(spark, sf_dir), mode, **kw).select("y", "x", "bg")

    return run


for _mode, _expr, _where in (
    ("mean", "avg(v)", "WHERE frame IN (SELECT frame FROM dark)"),
    ("median", "median(v)", "WHERE frame IN (SELECT frame FROM dark)"),
    ("pmedian", "median(v)", ""),
    ("percentile", "quantile_cont(v, 0.1)", ""),
):
    QUERIES[f"background_{_mode}"] = _background(_mode)
    SQL[f"background_{_mode}"] = f"WITH {LI}, {DARK} SELECT y, x, CAST(round_even({_expr}, 0) AS BIGINT) AS bg FROM vox {_where} GROUP BY y, x"


@query(f"WITH {LI}, {CLEAN} SELECT y, x, i0, i1, CAST(v AS BIGINT) AS v FROM sub")
def background_subtract(spark, sf_dir):
    return clean_li(spark, sf_dir).voxels.select("y", "x", "i0", "i1", "v")


@query(f"WITH {LI} SELECT y, x, i0, i1, CAST(CASE WHEN v < 20 OR v > 400 THEN 0 ELSE v END AS BIGINT) AS v FROM vox")
def threshold_removal(spark, sf_dir):
    return P.threshold(cube_li(spark, sf_dir), 20, 400).voxels.select("y", "x", "i0", "i1", "v")


@query(f"""WITH {LI}, {DARK}, fl AS (SELECT y, x, quantile_cont(v, 0.1) AS f FROM vox GROUP BY y, x),
lit AS (SELECT y, x, bg, f, CASE WHEN v > f + 5 * sqrt(greatest(f, 1)) THEN greatest(v - bg, 0) END AS k, CASE WHEN v > f + 5 * sqrt(greatest(f, 1)) THEN v - f END AS s
        FROM vox JOIN bg USING (y, x) JOIN fl USING (y, x)),
px AS (SELECT y, x, any_value(bg) AS bg, any_value(f) AS f, sum(k) AS k, sum(s) AS s FROM lit GROUP BY y, x)
SELECT {sql6('sum(k) / sum(s)', 'retained')}, {sql6('median(bg - f)', 'overshoot_median')}, count(*) FILTER (WHERE bg - f > 0) AS floored_px, count(*) AS grain_px FROM px""")
def grain_signal_retained(spark, sf_dir):
    cube = cube_li(spark, sf_dir)
    return P.signal_retained(cube, P.estimate_background(cube)).select(r6("retained", "retained"), r6("overshoot_median", "overshoot_median"), "floored_px", "grain_px")


@query(f"""WITH {LI}, z AS (SELECT y, x, sum(v) AS z FROM vox GROUP BY y, x), l AS (SELECT * FROM z WHERE z > 0.8 * (SELECT max(z) FROM z))
SELECT CAST(greatest(0, coalesce(min(y) - 1, 0)) AS INT) AS r1, CAST(least(8, coalesce(max(y) + 2, 8)) AS INT) AS r2, CAST(greatest(0, coalesce(min(x) - 1, 0)) AS INT) AS c1, CAST(least(8, coalesce(max(x) + 2, 8)) AS INT) AS c2 FROM l""")
def auto_roi(spark, sf_dir):
    return P.auto_roi(cube_li(spark, sf_dir), 0.8, 1).select("r1", "r2", "c1", "c2")


@query(f"WITH {LI} SELECT CAST(y - 2 AS INT) AS y, CAST(x - 1 AS INT) AS x, CAST(sum(v) AS DOUBLE) AS zsum FROM vox WHERE y >= 2 AND y < 6 AND x >= 1 AND x < 8 GROUP BY y, x")
def roi_pushdown(spark, sf_dir):
    return P.zsum(cube_li(spark, sf_dir).roi(2, 6, 1, 8)).select("y", "x", "zsum")


OTSU = """
ends AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
hist AS (SELECT least(floor(({c} - lo) / ((hi - lo) / 256)), 255) AS bin, count(*) AS n FROM {t}, ends GROUP BY 1),
cum AS (SELECT bin, lo + (bin + 0.5) * (hi - lo) / 256 AS centre, sum(n) OVER (ORDER BY bin) AS w, sum(n * (lo + (bin + 0.5) * (hi - lo) / 256)) OVER (ORDER BY bin) AS m,
               sum(n) OVER () AS wt, sum(n * (lo + (bin + 0.5) * (hi - lo) / 256)) OVER () AS mt FROM hist, ends),
best AS (SELECT centre AS t FROM cum WHERE w < wt ORDER BY round(pow(mt * w / wt - m, 2) / (w * (wt - w)), 9) DESC, bin LIMIT 1)"""


@query(f"WITH {LI}, z AS (SELECT y, x, CAST(sum(v) AS DOUBLE) AS z FROM vox GROUP BY y, x), {OTSU.format(c='z', t='z')} SELECT {sql6('t', 'threshold')} FROM best")
def otsu_threshold(spark, sf_dir):
    return P.otsu(P.zsum(cube_li(spark, sf_dir)), "zsum").select(r6("threshold", "threshold"))


@query(f"WITH {LI}, z AS (SELECT y, x, sum(v) AS z FROM vox GROUP BY y, x) SELECT y, x FROM z WHERE z > 0.9 * (SELECT max(z) FROM z)")
def grain_mask_fraction(spark, sf_dir):
    return P.grain_mask(cube_li(spark, sf_dir), 0.9, close=0, fill=False).select("y", "x")


@query(f"WITH {LI}, z AS (SELECT y, x, CAST(sum(v) AS DOUBLE) AS z FROM vox GROUP BY y, x), {OTSU.format(c='z', t='z')} SELECT y, x FROM z, best WHERE z > t")
def grain_mask_otsu(spark, sf_dir):
    return P.grain_mask(cube_li(spark, sf_dir), method="otsu", close=0, fill=False).select("y", "x")


@query(f"WITH {LI}, z AS (SELECT y, x, CAST(sum(v) AS DOUBLE) AS z, max(v) AS p FROM vox GROUP BY y, x), {OTSU.format(c='z', t='z')} SELECT y, x FROM z, best WHERE z > t OR p > 300")
def grain_mask_robust(spark, sf_dir):
    return P.grain_mask_robust(cube_li(spark, sf_dir), peak_threshold=300, close=0, fill=False).select("y", "x")


CROSS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx)"


@query(f"""WITH RECURSIVE {LI}, z AS (SELECT y, x, sum(v) AS z FROM vox GROUP BY y, x), m0 AS (SELECT y, x FROM z WHERE z > 0.9 * (SELECT max(z) FROM z)),
d1 AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM m0, {CROSS} WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
d2 AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM d1, {CROSS} WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
e1 AS (SELECT a.y, a.x FROM d2 a, {CROSS} JOIN d2 b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x HAVING count(*) = 5),
e2 AS (SELECT a.y, a.x FROM e1 a, {CROSS} JOIN e1 b ON b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.y, a.x HAVING count(*) = 5),
free AS (SELECT a.y, b.x FROM range(-1, 9) a(y), range(-1, 9) b(x) WHERE (a.y, b.x) NOT IN (SELECT (y, x) FROM e2)),
flood AS (SELECT CAST(-1 AS BIGINT) AS y, CAST(-1 AS BIGINT) AS x UNION SELECT f.y, f.x FROM flood l, {CROSS} JOIN free f ON f.y = l.y + dy AND f.x = l.x + dx)
SELECT CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x FROM range(8) a(y), range(8) b(x) WHERE (a.y, b.x) NOT IN (SELECT (y, x) FROM flood)""")
def grain_mask_closed(spark, sf_dir):
    """The mask with closing and filled holes."""
    return P.grain_mask(cube_li(spark, sf_dir), 0.9).select("y", "x")


@query("SELECT CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x FROM range(8) a(y), range(8) b(x) WHERE b.x - a.y < 3.5 AND a.y < 5.5 AND b.x > 0.5")
def polygon_mask(spark, sf_dir):
    """The polygon whose sides are x = 0.5, y = 5.5, x - y = 3.5 and a line above the detector."""
    return P.polygon_mask(cube_li(spark, sf_dir).pixels(), [(0.5, -2.0), (1.5, -2.0), (9.0, 5.5), (0.5, 5.5)]).select("y", "x")


@query(f"WITH {LI}, p AS (SELECT y, x, i0, max(CASE WHEN v > 100 THEN 1 ELSE 0 END) AS l FROM vox GROUP BY y, x, i0) SELECT y, x, CAST(sum(l) AS INT) AS support FROM p GROUP BY y, x")
def support_count(spark, sf_dir):
    return P.support_count(cube_li(spark, sf_dir), 0, 100).select("y", "x", F.col("support").cast("int").alias("support"))


@query(f"""WITH {LI}, mx AS (SELECT max(z) AS top FROM (SELECT sum(v) AS z FROM vox GROUP BY y, x)), px AS (SELECT y, x, sum(v) AS z FROM vox GROUP BY y, x)
SELECT y, x FROM px, mx WHERE NOT z > 0.9 * top""")
def mask_complement(spark, sf_dir):
    cube = cube_li(spark, sf_dir)
    return cube.pixels().join(P.grain_mask(cube, 0.9, close=0, fill=False), list(KEY), "left_anti").select("y", "x")


MASKS = "z AS (SELECT y, x, sum(v) AS z FROM vox GROUP BY y, x), a AS (SELECT y, x FROM z WHERE z > 0.8 * (SELECT max(z) FROM z)), b AS (SELECT y, x FROM z WHERE y % 2 = 0)"


def _mask_pair(spark, sf_dir):
    cube = cube_li(spark, sf_dir)
    return P.grain_mask(cube, 0.8, close=0, fill=False).select("y", "x"), cube.pixels().where("y % 2 = 0").select("y", "x")


for _name, _op, _word in (("union", lambda a, b: a.union(b).distinct(), "UNION"), ("intersection", lambda a, b: a.intersect(b), "INTERSECT"), ("difference", lambda a, b: a.exceptAll(b), "EXCEPT")):
    QUERIES[f"mask_{_name}"] = lambda spark, sf_dir, op=_op: op(*_mask_pair(spark, sf_dir))
    SQL[f"mask_{_name}"] = f"WITH {LI}, {MASKS} SELECT y, x FROM a {_word} SELECT y, x FROM b"


# Hot pixels ---------------------------------------------------------------------------------

HOT = """
fr AS (SELECT y, x, i0, v FROM evox),
nb AS (SELECT f.i0, f.y, f.x, any_value(f.v) AS v, median(n.v) AS med
       FROM fr f, (SELECT unnest([-1, 0, 1]) AS dy) p, (SELECT unnest([-1, 0, 1]) AS dx) q, fr n
       WHERE n.i0 = f.i0 AND n.y = least(greatest(f.y + dy, 0), 7) AND n.x = least(greatest(f.x + dx, 0), 7) GROUP BY f.i0, f.y, f.x),
sg AS (SELECT i0, greatest(1.4826 * median(abs(v - med)), 1.0) AS s FROM nb GROUP BY i0)"""


@query(f"WITH {EV}, {HOT} SELECT y, x, i0, CAST(CASE WHEN v - med > 3 * s THEN trunc(med) ELSE v END AS BIGINT) AS v FROM nb JOIN sg USING (i0)")
def hot_pixels(spark, sf_dir):
    return P.remove_hot_pixels(cube_ev(spark, sf_dir), 3.0, one_sided=True, min_sigma=1.0).voxels.select("y", "x", "i0", "v")


def _median3(name: str, source: str, key: str) -> str:
    """Each pixel with the median of its 3 by 3 neighbours, the detector's edge repeated."""
    on = f"n.{key} = f.{key} AND " if key else ""
    by = f"f.{key}, " if key else ""
    return f"""{name} AS (SELECT {by}f.y, f.x, any_value(f.v) AS v, median(n.v) AS med FROM {source} f, (SELECT unnest([-1, 0, 1]) AS dy) p, (SELECT unnest([-1, 0, 1]) AS dx) q, {source} n
  WHERE {on}n.y = least(greatest(f.y + dy, 0), 7) AND n.x = least(greatest(f.x + dx, 0), 7) GROUP BY {by}f.y, f.x)"""


@query(f"""WITH {EV}, tm AS (SELECT y, x, median(v) AS v FROM evox GROUP BY y, x), {_median3('tn', 'tm', '')},
st AS (SELECT y, x, abs(v - med) > 3 * (SELECT greatest(1.4826 * median(abs(v - med)), 1.0) FROM tn) AS hot FROM tn),
fr AS (SELECT y, x, i0, v FROM evox), {_median3('f0', 'fr', 'i0')},
f1 AS (SELECT f0.y, f0.x, f0.i0, CASE WHEN hot THEN trunc(med) ELSE v END AS v FROM f0 JOIN st USING (y, x)), {_median3('f2', 'f1', 'i0')},
sg AS (SELECT i0, greatest(1.4826 * median(abs(v - med)), 1.0) AS s FROM f2 GROUP BY i0)
SELECT y, x, i0, CAST(CASE WHEN abs(v - med) > 3 * s THEN trunc(med) ELSE v END AS BIGINT) AS v FROM f2 JOIN sg USING (i0)""")
def hot_pixels_hybrid(spark, sf_dir):
    return P.remove_hot_pixels(cube_ev(spark, sf_dir), 3.0, min_sigma=1.0, method="hybrid").voxels.select("y", "x", "i0", "v")


# Moments, edges and status ------------------------------------------------------------------


@query(f"WITH {LI}, {MOM.format(t='vox')} SELECT y, x, {sql6('mu0', 'mu0')}, {sql6('mu1', 'mu1')}, {sql6('v00', 'c00')}, {sql6('v01', 'c01')}, {sql6('v11', 'c11')} FROM mom")
def moments(spark, sf_dir):
    m = M.moments(cube_li(spark, sf_dir))
    return m.select("y", "x", r6(_c("mu", 0), "mu0"), r6(_c("mu", 1), "mu1"), r6(_c("cov", 0, 0), "c00"), r6(_c("cov", 0, 1), "c01"), r6(_c("cov", 1, 1), "c11"))


@query(f"""WITH {EV}, a AS (SELECT y, x, coalesce(sum(v * c0) / nullif(sum(v), 0), 0) AS mu, sum(v) AS s FROM evox GROUP BY y, x),
b AS (SELECT y, x, any_value(mu) AS mu, coalesce(sum(v * pow(c0 - mu, 2)) / nullif(any_value(s), 0), 0) AS v2, coalesce(sum(v * pow(c0 - mu, 3)) / nullif(any_value(s), 0), 0) AS v3, coalesce(sum(v * pow(c0 - mu, 4)) / nullif(any_value(s), 0), 0) AS v4 FROM evox JOIN a USING (y, x) GROUP BY y, x)
SELECT y, x, {sql6('mu', 'mean')}, {sql6('v2', 'variance')}, {sql6('CASE WHEN sqrt(v2) > 1e-12 THEN v3 / pow(v2, 1.5) ELSE 0 END', 'skew')}, {sql6('CASE WHEN sqrt(v2) > 1e-12 THEN v4 / (v2 * v2) - 3 ELSE 0 END', 'kurtosis')} FROM b""")
def higher_moments(spark, sf_dir):
    m = M.moments(cube_ev(spark, sf_dir), order=4)
    return m.select("y", "x", r6(_c("mu", 0), "mean"), r6(_c("cov", 0, 0), "variance"), r6(_c("skew", 0), "skew"), r6(_c("kurt", 0), "kurtosis"))


@query(f"""WITH {LI}, p0 AS (SELECT y, x, i0, sum(v) AS p FROM vox GROUP BY y, x, i0), p1 AS (SELECT y, x, i1, sum(v) AS p FROM vox GROUP BY y, x, i1),
a AS (SELECT y, x, arg_max(i0, (p, -i0)) AS k FROM p0 GROUP BY y, x), b AS (SELECT y, x, arg_max(i1, (p, -i1)) AS k FROM p1 GROUP BY y, x)
SELECT y, x, a.k < 3 OR a.k >= 8 AS e0, b.k < 3 OR b.k >= 6 AS e1, a.k < 3 OR a.k >= 8 OR b.k < 3 OR b.k >= 6 AS edge FROM a JOIN b USING (y, x)""")
def edge_peaks(spark, sf_dir):
    cube = cube_li(spark, sf_dir)
    return M.per_axis_edge(cube).join(M.edge_peak_mask(cube), list(KEY)).select("y", "x", "e0", "e1", "edge")


STATUS_RANGES, STATUS_STEPS = [(0.046, 0.054), (0.036, 0.044)], [0.001, 0.001]


@query(f"""WITH {LI}, {MOM.format(t='vox')}, q AS (SELECT y, x, s, mu0, mu1,
  (mu0 <= 0.047 OR mu0 >= 0.053 OR mu1 <= 0.037 OR mu1 >= 0.043) AS near, (mu0 < 0.045 OR mu0 > 0.055 OR mu1 < 0.035 OR mu1 > 0.045) AS out FROM mom)
SELECT y, x, CAST(CASE WHEN y = 0 THEN 0 WHEN NOT out AND near THEN 2 WHEN NOT out THEN 1 WHEN x = 3 THEN 2 ELSE 3 END AS INT) AS status,
  {sql6('least(greatest(mu0, 0.046), 0.054)', 'shown0')} FROM q""")
def fit_status(spark, sf_dir):
    m = M.moments(cube_li(spark, sf_dir))
    mu = [_c("mu", 0), _c("mu", 1)]
    status = M.fit_status(mu, F.lit(1.0), STATUS_RANGES, STATUS_STEPS, F.col("y") != 0, data_edge=F.col("x") == 3, amplitude=F.lit(1.0))
    return m.select("y", "x", status.cast("int").alias("status"), r6(M.clamp(mu, STATUS_RANGES)[0], "shown0"))


@query("""WITH l AS (SELECT DISTINCT 'chi' AS axis, round(l_discount * 100) / 100 AS c FROM lineitem UNION SELECT DISTINCT 'mu', round(l_tax * 100) / 100 FROM lineitem),
d AS (SELECT axis, c, c - lag(c) OVER (PARTITION BY axis ORDER BY c) AS s FROM l)
SELECT axis, round(min(c), 6) + 0.0 AS lo, round(max(c), 6) + 0.0 AS hi, round(median(s), 6) + 0.0 AS step FROM d GROUP BY axis""")
def motor_ranges_steps(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.round(F.col("l_discount") * 100) / 100).alias("chi"), (F.round(F.col("l_tax") * 100) / 100).alias("mu"))
    return M.motor_ranges_steps(t, ["chi", "mu"]).select("axis", r6("lo", "lo"), r6("hi", "hi"), r6("step", "step"))


@query(f"WITH {LI}, z AS (SELECT y, x, CAST(sum(v) AS DOUBLE) AS z FROM vox GROUP BY y, x) SELECT {sql6('median(z) - 3 * stddev_pop(z)', 'lo')}, {sql6('median(z) + 3 * stddev_pop(z)', 'hi')} FROM z")
def robust_limits(spark, sf_dir):
    return M.robust_limits(P.zsum(cube_li(spark, sf_dir)), "zsum").select(r6("lo", "lo"), r6("hi", "hi"))


# Maps ---------------------------------------------------------------------------------------


def _mom(spark, sf_dir):
    return M.moments(cube_li(spark, sf_dir))


@query(f"""WITH {LI}, {MOM.format(t='vox')}, r AS (SELECT median(mu0) AS r0, median(mu1) AS r1 FROM mom), d AS (SELECT y, x, mu0, mu1, mu0 - r0 AS dx, mu1 - r1 AS dy, sqrt(pow(mu0 - r0, 2) + pow(mu1 - r1, 2)) AS mag FROM mom, r),
s AS (SELECT greatest(quantile_cont(mag, 0.98), 1e-12) AS sc FROM d),
h AS (SELECT y, x, mu0, mu1, ((atan2(dy, dx) / (2 * pi())) % 1 + 1) % 1 AS h, least(mag / sc, 1) AS s FROM d, s)
SELECT y, x, {sql6('mu0', 'o0')}, {sql6('mu1', 'o1')},
  round(1 - s * greatest(0, least((5 + h * 6) % 6, 4 - (5 + h * 6) % 6, 1)), 4) + 0.0 AS r, round(1 - s * greatest(0, least((3 + h * 6) % 6, 4 - (3 + h * 6) % 6, 1)), 4) + 0.0 AS g,
  round(1 - s * greatest(0, least((1 + h * 6) % 6, 4 - (1 + h * 6) % 6, 1)), 4) + 0.0 AS b FROM h""")
def orientation(spark, sf_dir):
    o = maps.orientation(_mom(spark, sf_dir))
    return o.select("y", "x", r6("o0", "o0"), r6("o1", "o1"), *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in "rgb"])


@query(f"""WITH {LI}, {MOM.format(t='vox')}, u AS (SELECT y, x, (mu0 - 0.045) / (0.055 - 0.045) * 2 - 1 AS u, (mu1 - 0.035) / (0.045 - 0.035) * 2 - 1 AS v FROM mom),
h AS (SELECT y, x, abs(u) <= 1 AND abs(v) <= 1 AS inside, ((atan2(v, u) / (2 * pi())) % 1 + 1) % 1 AS h, least(greatest(abs(u), abs(v)), 1) AS s FROM u)
SELECT y, x, """ + ", ".join(f"round(CASE WHEN inside THEN 1 - s * greatest(0, least(({n} + h * 6) % 6, 4 - ({n} + h * 6) % 6, 1)) ELSE 0.2 END, 4) + 0.0 AS {c}" for n, c in ((5, "r"), (3, "g"), (1, "b"))) + " FROM h")
def orientation_stamp(spark, sf_dir):
    stamp = maps.orientation_stamp(_mom(spark, sf_dir), [(0.045, 0.055), (0.035, 0.045)])
    return stamp.select("y", "x", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in "rgb"])


@query(f"WITH {LI}, {MOM.format(t='vox')} SELECT y, x, {sql6('sqrt(greatest(v00 + v11, 0))', 'mosaicity')} FROM mom")
def mosaicity_scalar(spark, sf_dir):
    return maps.mosaicity(_mom(spark, sf_dir)).select("y", "x", r6("mosaicity", "mosaicity"))


@query(f"""WITH {LI}, {MOM.format(t='vox')}, e AS (SELECT y, x, (v00 + v11) / 2 AS m, sqrt(pow((v00 - v11) / 2, 2) + v01 * v01) AS r, degrees(atan2(2 * v01, v00 - v11) / 2) AS a FROM mom)
SELECT y, x, {sql6('2 * sqrt(2 * ln(2)) * sqrt(m + r)', 'major_fwhm')}, {sql6('2 * sqrt(2 * ln(2)) * sqrt(greatest(m - r, 0))', 'minor_fwhm')}, round(a, 4) + 0.0 AS angle_deg FROM e""")
def mosaicity_ellipse(spark, sf_dir):
    e = maps.mosaicity(_mom(spark, sf_dir), "ellipse")
    return e.select("y", "x", r6("major_fwhm", "major_fwhm"), r6("minor_fwhm", "minor_fwhm"), (F.round("angle_deg", 4) + F.lit(0.0)).alias("angle_deg"))


def _strain(motor):
    def run(spark, sf_dir):
        cube = cube_ev(spark, sf_dir)
        lit = cube.voxels.groupBy(*KEY).agg(F.sum("v").alias("s")).where("s > 0")
        return maps.strain(M.moments(cube.masked(lit)), _c("mu", 0), motor).select("y", "x", r6("strain", "strain"))

    return run


EV_MEAN = f"WITH {EV}, a AS (SELECT y, x, sum(v * c0) / sum(v) AS mu FROM evox GROUP BY y, x HAVING sum(v) > 0), r AS (SELECT median(mu) AS r FROM a)"
QUERIES["strain_ccmth"] = _strain("ccmth")
SQL["strain_ccmth"] = f"{EV_MEAN} SELECT y, x, {sql6('(radians(mu) - radians(r)) / tan(radians(r))', 'strain')} FROM a, r"
QUERIES["strain_obpitch"] = _strain("obpitch")
SQL["strain_obpitch"] = f"{EV_MEAN} SELECT y, x, {sql6('-(radians(mu) - radians(r)) / (2 * tan(radians(r) / 2))', 'strain')} FROM a, r"


@query(f"""WITH {LI}, {MOM.format(t='vox')}, n AS (SELECT a.y, a.x, avg(sqrt(pow(a.mu0 - b.mu0, 2) + pow(a.mu1 - b.mu1, 2))) AS k
FROM mom a JOIN mom b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY a.y, a.x) SELECT y, x, {sql6('k', 'kam')} FROM n""")
def kernel_misorientation(spark, sf_dir):
    return maps.kam(_mom(spark, sf_dir), [_c("mu", 0), _c("mu", 1)]).select("y", "x", r6("kam", "kam"))


@query(f"""WITH {LI}, {CLEAN}, a AS (SELECT y, x, coalesce(sum(v * c0) / nullif(sum(v), 0), 0) AS m FROM vox GROUP BY y, x), b AS (SELECT y, x, coalesce(sum(v * c0) / nullif(sum(v), 0), 0) AS m FROM sub GROUP BY y, x),
d AS (SELECT a.m AS a, b.m AS b, b.m - a.m AS d FROM a JOIN b USING (y, x))
SELECT count(*) AS n, {sql6('median(abs(d))', 'median_abs')}, {sql6('quantile_cont(abs(d), 0.95)', 'p95_abs')}, {sql6('avg(d)', 'mean')}, {sql6('stddev_pop(d)', 'std')}, {sql6('corr(a, b)', 'pearson_r')},
  {sql6('avg(CASE WHEN abs(d) <= 0.0005 THEN 1.0 ELSE 0.0 END)', 'within_step')} FROM d""")
def compare_maps(spark, sf_dir):
    cube = cube_li(spark, sf_dir)
    one, two = (M.moments(c).select(*KEY, _c("mu", 0).alias("m")) for c in (cube, clean_li(spark, sf_dir)))
    c = maps.compare_maps(one, two, "m", step=0.0005)
    return c.select("n", *[r6(k, k) for k in ("median_abs", "p95_abs", "mean", "std", "pearson_r", "within_step")])


@query(f"WITH {LI}, {MOM.format(t='vox')} SELECT {sql6('exp(avg(ln(sqrt(v00))))', 'spread0')}, {sql6('exp(avg(ln(sqrt(v11))))', 'spread1')} FROM mom")
def geometric_spread(spark, sf_dir):
    return _mom(spark, sf_dir).agg(r6(maps.geometric_mean(F.sqrt(_c("cov", 0, 0))), "spread0"), r6(maps.geometric_mean(F.sqrt(_c("cov", 1, 1))), "spread1"))


@query("""WITH g AS (SELECT s_suppkey, 200.0 + s_suppkey % 80 AS obx, -5000.0 - s_suppkey AS mainx, 15.0 + s_suppkey % 10 AS pitch, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE -90.0 END AS ffsel FROM supplier),
m AS (SELECT s_suppkey, (abs(mainx) / cos(radians(pitch)) - obx / cos(radians(pitch))) / (obx / cos(radians(pitch))) AS m, CASE WHEN abs(ffsel) < 1 THEN 10.0 ELSE 2.0 END AS o FROM g)
SELECT s_suppkey, round(m, 6) + 0.0 AS magnification, CAST(o AS DOUBLE) AS objective, round(6.5 / (m * o), 6) + 0.0 AS pixel_um FROM m""")
def geometry(spark, sf_dir):
    k = F.col("s_suppkey")
    m = F.create_map(F.lit("obx"), 200.0 + k % 80, F.lit("mainx"), -5000.0 - k, F.lit("obpitch"), 15.0 + k % 10, F.lit("ffsel"), F.when(k % 3 == 0, 0.0).otherwise(-90.0))
    t = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k, m.alias("m"))
    return t.select("s_suppkey", r6(maps.magnification_col(F.col("m")), "magnification"), maps.objective_col(F.col("m")).alias("objective"), r6(maps.pixel_size_col(F.col("m")), "pixel_um"))


def _suppliers(spark, sf_dir):
    """suppliers as pixels of a map: y, x, and a number k to make fit results from."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("sup").alias("scan_id"), F.floor(k / 16.0).cast("int").alias("y"), (k % 16).cast("int").alias("x"), k.alias("k"))


@query(f"""WITH g AS (SELECT s_suppkey AS k, 2 * sqrt(2 * ln(2)) * (0.05 + (s_suppkey % 7) * 0.01) AS g, 2 * (0.02 + (s_suppkey % 5) * 0.02) AS w FROM supplier)
SELECT k, {sql6('pow(pow(g, 5) + 2.69269 * pow(g, 4) * w + 2.42843 * pow(g, 3) * w * w + 4.47163 * g * g * pow(w, 3) + 0.07842 * g * pow(w, 4) + pow(w, 5), 0.2)', 'fwhm')} FROM g""")
def pseudo_voigt_fwhm(spark, sf_dir):
    t = _suppliers(spark, sf_dir)
    return t.select("k", r6(maps.pseudo_voigt_fwhm(0.05 + F.col("k") % 7 * 0.01, 0.02 + F.col("k") % 5 * 0.02), "fwhm"))


@query(f"""WITH g AS (SELECT s_suppkey AS k, (s_suppkey % 11) * 0.1 AS d0, (s_suppkey % 3) * -0.2 AS d1, 1.0 + (s_suppkey % 4) * 0.5 AS a, 0.25 AS b, 2.0 AS c FROM supplier)
SELECT k, {sql6('CASE WHEN k % 2 = 0 THEN d0 ELSE 0 END', 'd0')}, {sql6('CASE WHEN k % 2 = 0 THEN d1 ELSE 0 END', 'd1')},
  {sql6('CASE WHEN k % 2 = 0 THEN sqrt((c * d0 * d0 - 2 * b * d0 * d1 + a * d1 * d1) / (a * c - b * b)) ELSE 0 END', 'mahalanobis')} FROM g""")
def peak_separation(spark, sf_dir):
    t, k = _suppliers(spark, sf_dir), F.col("k")
    two = F.array(F.array(1.0 + k % 4 * 0.5 + 0.25, F.lit(0.5)), F.array(F.lit(0.5), F.lit(2.5)))
    one = F.array(F.array(1.0 + k % 4 * 0.5 - 0.25, F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.5)))
    t = t.withColumns({"mu1": F.array(F.lit(1.0), F.lit(2.0)), "mu2": F.array(1.0 + k % 11 * 0.1, 2.0 - k % 3 * 0.2), "cov1": one, "cov2": two, "n_peaks": F.when(k % 2 == 0, 2).otherwise(1)})
    got = maps.two_peak_separation(t).withColumn("k", F.col("y") * 16 + F.col("x"))
    return got.select(F.col("k").cast("long").alias("k"), r6("d0", "d0"), r6("d1", "d1"), r6("mahalanobis", "mahalanobis"))


@query(f"WITH {LI}, {MOM.format(t='vox')} SELECT y, x, round((mu0 - (SELECT median(mu0) FROM mom)) * 1000, 4) + 0.0 AS dev_mdeg FROM mom")
def deviation_mdeg(spark, sf_dir):
    """The deviation from the map's median in thousandths."""
    m = _mom(spark, sf_dir).select(*KEY, _c("mu", 0).alias("m"))
    ref = m.groupBy("scan_id").agg(F.median("m").alias("ref"))
    return m.join(ref, "scan_id").select("y", "x", (F.round((F.col("m") - F.col("ref")) * 1000, 4) + F.lit(0.0)).alias("dev_mdeg"))


@query(f"WITH {LI}, {MOM.format(t='vox')} SELECT {sql6('-(abs(median(mu0)) + 2 * stddev_pop(mu0))', 'lo')}, {sql6('abs(median(mu0)) + 2 * stddev_pop(mu0)', 'hi')} FROM mom")
def symmetric_limits(spark, sf_dir):
    return M.robust_limits(_mom(spark, sf_dir).select(_c("mu", 0).alias("m")), "m", 2.0, symmetric=True).select(r6("lo", "lo"), r6("hi", "hi"))


@query(f"WITH {EV3} SELECT scan_id, CAST(count(DISTINCT y * 8 + x) AS BIGINT) AS pixels, CAST(count(DISTINCT i0) AS BIGINT) AS points, CAST(sum(v) AS BIGINT) AS counts FROM evox GROUP BY scan_id")
def scan_catalogue(spark, sf_dir):
    """What scans there are: pixels, motor points and counts of each."""
    v = cube_ev(spark, sf_dir, by_day=True).voxels
    return v.groupBy("scan_id").agg(F.count_distinct(F.col("y") * 8 + F.col("x")).alias("pixels"), F.count_distinct("i0").alias("points"), F.sum("v").alias("counts"))


@query(f"WITH {LI}, {MOM.format(t='vox')}, s AS (SELECT sum(s) AS s FROM mom) SELECT y, x, 'mu' AS name, 0 AS layer, {sql6('mu0', 'value')} FROM mom WHERE y % 2 = 0 UNION ALL SELECT y, x, 'mu', 1, {sql6('mu1', 'value')} FROM mom WHERE y % 2 = 0")
def display_maps(spark, sf_dir):
    """A result as one long table, without what the mask hides."""
    from cubewright.sources.store import long_maps

    cube = cube_li(spark, sf_dir)
    long = long_maps(M.moments(cube).drop("cov"), mask=cube.pixels().where("y % 2 = 0"))
    return long.where("not isnan(value)").select("y", "x", "name", F.col("layer").cast("int").alias("layer"), r6("value", "value"))


# Frame order, stacking and partial scans ----------------------------------------------------


def _frames(spark, sf_dir, zigzag=True):
    """lineitem's grid as frames in order of acquisition: odd rows backwards, motors with a little jitter."""
    v = cube_li(spark, sf_dir).voxels.groupBy("i0", "i1").agg(F.sum("v").alias("v"))
    back = (F.col("i0") % 2 == 1) if zigzag else F.lit(False)
    frame = F.col("i0") * 9 + F.when(back, 8 - F.col("i1")).otherwise(F.col("i1"))
    jitter = (frame * 7) % 5 * 0.0001
    return v.select(F.lit("li").alias("scan_id"), frame.cast("int").alias("frame"), (F.col("i0") * 0.01 + jitter).alias("slow"), (F.col("i1") * 0.01 + jitter).alias("fast"), "v")


FRAMES = """
agg AS (SELECT i0, i1, sum(v) AS v FROM vox GROUP BY i0, i1),
fr0 AS (SELECT i0, i1, CAST(v AS BIGINT) AS v, i0 * 9 + CASE WHEN i0 % 2 = 1 THEN 8 - i1 ELSE i1 END AS frame FROM agg),
fr AS (SELECT CAST(frame AS INT) AS frame, i0 * 0.01 + (frame * 7) % 5 * 0.0001 AS slow, i1 * 0.01 + (frame * 7) % 5 * 0.0001 AS fast, v FROM fr0)"""


@query(f"""WITH {LI}, {FRAMES}, a AS (SELECT *, CAST(floor(frame / 9.0) AS INT) AS r FROM fr), b AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(fast AS FLOAT), frame) - 1 AS j FROM a),
c AS (SELECT r, row_number() OVER (ORDER BY CAST(slow AS FLOAT), r) - 1 AS i FROM b WHERE j = 0) SELECT frame, CAST(i AS INT) AS i0, CAST(j AS INT) AS i1, v FROM b JOIN c USING (r)""")
def snake_sort(spark, sf_dir):
    return grid.snake_order(_frames(spark, sf_dir), 9).select("frame", "i0", "i1", "v")


@query(f"WITH {LI}, {FRAMES}, a AS (SELECT *, row_number() OVER (ORDER BY CAST(slow AS FLOAT), CAST(fast AS FLOAT), frame) - 1 AS k FROM fr) SELECT frame, CAST(floor(k / 9.0) AS INT) AS i0, CAST(k % 9 AS INT) AS i1, v FROM a")
def value_sort(spark, sf_dir):
    return grid.value_order(_frames(spark, sf_dir), 9).select("frame", "i0", "i1", "v")


@query(f"WITH {LI}, {FRAMES} SELECT frame, CAST(row_number() OVER (ORDER BY CAST(fast AS FLOAT), frame) - 1 AS INT) AS i0 FROM fr")
def rocking_sort(spark, sf_dir):
    return grid.rocking_order(_frames(spark, sf_dir), "fast").select("frame", "i0")


@query(f"""WITH {LI}, {FRAMES}, w AS (SELECT floor(frame / 9.0) AS r, sign(arg_max(fast, frame) - arg_min(fast, frame)) AS s FROM fr GROUP BY 1), l AS (SELECT s, lag(s) OVER (ORDER BY r) AS p FROM w)
SELECT CASE WHEN bool_and(p IS NULL OR p = s) THEN 'raster' WHEN bool_and(p IS NULL OR p <> s) THEN 'zigzag' ELSE 'unknown' END AS mode FROM l""")
def acquisition_mode(spark, sf_dir):
    return grid.acquisition_mode(_frames(spark, sf_dir), 9).select("mode")


@query(f"""WITH {LI}, {FRAMES}, p AS (SELECT floor(frame / 9.0) AS r, max(slow) - min(slow) AS spread, avg(slow) AS c FROM fr GROUP BY 1), q AS (SELECT spread, abs(c - lag(c) OVER (ORDER BY r)) AS step FROM p)
SELECT {sql6('max(spread)', 'spread')}, {sql6('median(step)', 'step')}, max(spread) <= 0.25 * median(step) AS separable FROM q""")
def grid_separability(spark, sf_dir):
    g = _frames(spark, sf_dir).withColumn("i0", F.floor(F.col("frame") / 9))
    return grid.separability(g, "i0", "slow").select(r6("spread", "spread"), r6("step", "step"), "separable")


@query(f"""WITH {EV3}, t AS (SELECT scan_id, sum(v) AS t FROM evox GROUP BY scan_id), o AS (SELECT scan_id, CAST(row_number() OVER (ORDER BY t, scan_id) - 1 AS INT) AS i1 FROM t)
SELECT i1, i0, CAST(sum(v) AS BIGINT) AS v FROM evox JOIN o USING (scan_id) GROUP BY i1, i0""")
def stacked_scans(spark, sf_dir):
    v = cube_ev(spark, sf_dir, by_day=True).voxels
    order = v.groupBy("scan_id").agg(F.sum("v").alias("value"))
    return grid.stack_scans(v, order, "i1").groupBy("i1", "i0").agg(F.sum("v").alias("v"))


@query(f"WITH {LI}, {FRAMES}, n AS (SELECT count(*) AS n FROM fr WHERE frame < 60) SELECT frame, v FROM fr, n WHERE frame < floor(n / 9) * 9 AND frame < 60")
def partial_scan(spark, sf_dir):
    kept, _ = grid.partial_frames(_frames(spark, sf_dir).where("frame < 60"), "fscan2d", 9, 99)
    return kept.select("frame", "v")


@query(f"""WITH {EV}, s AS (SELECT y, x, i0, sum(v) OVER w3 AS t FROM evox WINDOW w3 AS (PARTITION BY y, x ORDER BY i0 ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
k AS (SELECT y, x, arg_max(i0, (v, -i0)) AS i0 FROM evox GROUP BY y, x) SELECT k.y, k.x, CAST(k.i0 AS INT) AS peak, CAST(s.t AS BIGINT) AS around FROM k JOIN s USING (y, x, i0)""")
def brightest_frame(spark, sf_dir):
    v = cube_ev(spark, sf_dir).voxels
    w = Window.partitionBy(*KEY).orderBy("i0").rowsBetween(-1, 1)
    best = v.groupBy(*KEY).agg(grid.first_argmax(F.col("v"), F.col("i0")).cast("int").alias("peak"))
    near = v.select(*KEY, F.col("i0").alias("peak"), F.sum("v").over(w).alias("around"))
    return best.join(near, [*KEY, "peak"]).select("y", "x", "peak", "around")


@query(f"""WITH {EV}, ker AS (SELECT d, exp(-d * d / 4.5) AS w FROM range(-4, 5) k(d)),
sm AS (SELECT a.y, a.x, a.i0, round(sum(b.v * w) / (SELECT sum(w) FROM ker), 9) AS s FROM evox a JOIN evox b ON a.y = b.y AND a.x = b.x JOIN ker ON d = b.i0 - a.i0 GROUP BY a.y, a.x, a.i0),
pk AS (SELECT y, x, i0, s FROM sm QUALIFY s > lag(s) OVER (PARTITION BY y, x ORDER BY i0) AND s >= lead(s) OVER (PARTITION BY y, x ORDER BY i0)),
one AS (SELECT y, x, i0, s FROM pk QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY s DESC, i0) = 1),
two AS (SELECT p.y, p.x, p.i0, p.s FROM pk p JOIN one o ON p.y = o.y AND p.x = o.x AND abs(p.i0 - o.i0) > 3 QUALIFY row_number() OVER (PARTITION BY p.y, p.x ORDER BY p.s DESC, p.i0) = 1)
SELECT y, x, CAST(1 AS INT) AS k, CAST(i0 AS INT) AS at, {sql6('s', 'height')} FROM one UNION ALL SELECT y, x, 2, CAST(i0 AS INT), {sql6('s', 'height')} FROM two""")
def separated_maxima(spark, sf_dir):
    return grid.local_maxima(cube_ev(spark, sf_dir).voxels, "v").select("y", "x", "k", F.col("at").cast("int").alias("at"), r6("height", "height"))


@query(f"""WITH {EV3}, a AS (SELECT scan_id, y, x, sum(v * c0) / nullif(sum(v), 0) AS mu, sum(v) AS s FROM evox GROUP BY ALL)
SELECT scan_id AS alias, {sql6('median(mu)', 'com_median')}, {sql6('avg(mu)', 'com_mean')}, {sql6('avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END)', 'lit_fraction')} FROM a GROUP BY scan_id""")
def time_series(spark, sf_dir):
    cube = cube_ev(spark, sf_dir, by_day=True)
    m = M.moments(cube).join(P.zsum(cube), list(KEY)).select("scan_id", F.when(F.col("zsum") > 0, _c("mu", 0)).alias("mu"), (F.col("zsum") > 0).cast("double").alias("lit"))
    return m.groupBy(F.col("scan_id").alias("alias")).agg(r6(F.median("mu"), "com_median"), r6(F.avg("mu"), "com_mean"), r6(F.avg("lit"), "lit_fraction"))


@query(f"WITH {EV}, z AS (SELECT CAST(sum(v) AS DOUBLE) AS z FROM evox GROUP BY y, x), e AS (SELECT min(z) AS lo, max(z) AS hi FROM z WHERE z > 0) SELECT CAST(least(floor((z - lo) * 16 / (hi - lo)), 15) AS INT) AS bin, count(*) AS n FROM z, e WHERE z > 0 GROUP BY 1")
def preview_histogram(spark, sf_dir):
    cube = cube_ev(spark, sf_dir)
    h = P.preview(cube, n_bins=16, n_lowest=1)["raw_zsum"].where("zsum > 0")
    e = h.agg(F.min("zsum").alias("lo"), F.max("zsum").alias("hi"))
    b = F.least(F.floor(F.try_divide((F.col("zsum") - F.col("lo")) * 16, F.col("hi") - F.col("lo"))), F.lit(15)).cast("int")
    return h.join(F.broadcast(e)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))  # one row of ends


@query(f"WITH {LI} SELECT y, x, CAST(i0 AS INT) AS i0, CAST(sum(v) AS BIGINT) AS profile FROM vox WHERE y = 3 AND x = 4 GROUP BY y, x, i0")
def pixel_profile(spark, sf_dir):
    v = cube_li(spark, sf_dir).voxels.where("y = 3 and x = 4")
    return v.groupBy("y", "x", "i0").agg(F.sum("v").alias("profile"))


@query(f"WITH {LI} SELECT y, x, CAST(sum(v) AS DOUBLE) AS zsum FROM vox WHERE frame % 5 = 0 GROUP BY y, x")
def sampled_zsum(spark, sf_dir):
    cube = cube_li(spark, sf_dir)
    return P.zsum(cube.with_voxels(cube.voxels.where(cube.frame() % 5 == 0))).select("y", "x", "zsum")


@query(f"WITH {LI} SELECT y, x, CAST(count(*) AS INT) AS n, CAST(sum(v * (frame + 1)) AS BIGINT) AS fingerprint FROM vox GROUP BY y, x")
def curves_layout(spark, sf_dir):
    """Packing to curves keeps every voxel in its place."""
    c = cube_li(spark, sf_dir).curves()
    weighed = F.aggregate(F.transform("v", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, t: s + t)
    return c.select("y", "x", F.size("v").alias("n"), weighed.alias("fingerprint"))


@query(f"WITH {LI} SELECT CAST(frame AS INT) AS frame, CAST(count(*) AS INT) AS n, CAST(sum(v * (y * 8 + x + 1)) AS BIGINT) AS fingerprint FROM vox GROUP BY frame")
def frames_layout(spark, sf_dir):
    c = cube_li(spark, sf_dir).frames()
    weighed = F.aggregate(F.transform("px", lambda v, i: v * (i + 1)), F.lit(0).cast("long"), lambda s, t: s + t)
    return c.select(F.col("frame").cast("int").alias("frame"), F.size("px").alias("n"), weighed.alias("fingerprint"))


# Fits: of curves made, for each supplier, from parameters that the SQL states. Those lie on a grid,
# to which the fitted ones are rounded.


def _made(spark, sf_dir, grid_shape: tuple[int, ...], value) -> DataFrame:
    """curves(scan_id, y, x, v): value(k, i0[, i1]) over a grid, for each supplier k."""
    points = int(np.prod(grid_shape))

    def at(p: Column) -> Column:
        where = [p] if len(grid_shape) == 1 else [F.floor(p / grid_shape[1]), p % grid_shape[1]]
        return value(F.col("k"), *[i.cast("double") for i in where])

    return _suppliers(spark, sf_dir).select(*KEY, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at).alias("v"), "k")


def _bell(x: Column, mu, sigma) -> Column:
    return F.exp(-0.5 * F.pow((x - mu) / sigma, F.lit(2.0)))


def _bell2(x: Column, y: Column, mu, cov) -> Column:
    """Of covariance ((a, b), (b, c))."""
    (a, b, c), dx, dy = cov, x - mu[0], y - mu[1]
    return F.exp(-0.5 * (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b))


def _supplier(fit: DataFrame) -> Column:
    return (F.col("y") * 16 + F.col("x")).cast("long").alias("k")


def _on_grid(c: Column, digits: int, name: str) -> Column:
    return (F.round(c, digits) + F.lit(0.0)).alias(name)


def _truths(*columns: str) -> str:
    return f"SELECT k, {', '.join(columns)} FROM (SELECT s_suppkey AS k FROM supplier)"


def _truth(expr: str, name: str, digits: int = 1) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


HOURS = np.arange(24.0)
FINE = np.arange(121) * 0.2
GRID2 = np.stack(np.meshgrid(np.arange(11.0), np.arange(9.0), indexing="ij")).reshape(2, -1)


@query(_truths(_truth("100 + 10 * (k % 7)", "A", -1), _truth("1.5 + 0.1 * (k % 9)", "sigma"), _truth("8 + 0.1 * (k % 60)", "mu"), _truth("0.1 * (k % 5)", "slope"), _truth("5 + k % 4", "base", 0), "CAST(1 AS DOUBLE) AS success"))
def fit_gauss1d(spark, sf_dir):
    curves = _made(spark, sf_dir, (24,), lambda k, x: (100 + 10 * (k % 7)) * _bell(x, 8 + 0.1 * (k % 60), 1.5 + 0.1 * (k % 9)) + 0.1 * (k % 5) * x + 5 + k % 4)
    f = fits.fit_gaussian_1d(curves, HOURS, n_iter=30)
    return f.select(_supplier(f), _on_grid(F.col("A"), -1, "A"), _on_grid(F.col("sigma"), 1, "sigma"), _on_grid(F.col("mu"), 1, "mu"), _on_grid(F.col("k"), 1, "slope"), _on_grid(F.col("m"), 0, "base"), "success")


@query(_truths(_truth("100 + 10 * (k % 7)", "A", -1), _truth("1.1 + 0.1 * (k % 4)", "sigma"), _truth("10 + 0.1 * (k % 40)", "mu"), _truth("1.0 + 0.1 * (k % 5)", "gamma"), _truth("0.3 + 0.1 * (k % 3)", "eta"), "CAST(1 AS DOUBLE) AS success"))
def fit_pseudo_voigt(spark, sf_dir):
    def value(k, i):
        x, mu, gamma, eta = i * 0.2, 10 + 0.1 * (k % 40), 1.0 + 0.1 * (k % 5), 0.3 + 0.1 * (k % 3)
        lorentz = gamma * gamma / ((x - mu) * (x - mu) + gamma * gamma)
        return (100 + 10 * (k % 7)) * ((1 - eta) * _bell(x, mu, 1.1 + 0.1 * (k % 4)) + eta * lorentz) + 3

    f = fits.fit_pseudo_voigt_1d(_made(spark, sf_dir, (121,), value), FINE, n_iter=200)
    return f.select(_supplier(f), _on_grid(F.col("A"), -1, "A"), *[_on_grid(F.col(n), 1, n) for n in ("sigma", "mu", "gamma", "eta")], "success")


def _ripple(n: Column) -> Column:
    """A small known disturbance, without which a single peak would leave nothing to compare fits by."""
    return 0.05 * (n % 7 - 3)


@query(_truths(_truth("1 + (k + 1) % 2", "n_peaks", 0), *[_truth(f"CASE WHEN k % 2 = 0 THEN {e} END", n, d) for e, n, d in (
    ("100 + 10 * (k % 5)", "A1", -1), ("2.2 + 0.1 * (k % 4)", "sigma1", 1), ("6 + 0.1 * (k % 20)", "mu1", 1), ("120 + 10 * (k % 3)", "A2", -1), ("2.2 + 0.1 * (k % 3)", "sigma2", 1), ("15 + 0.1 * (k % 20)", "mu2", 1))]))
def fit_gauss1d_two_peaks(spark, sf_dir):
    """Two peaks for even suppliers, one for odd."""
    def value(k, x):
        one = (100 + 10 * (k % 5)) * _bell(x, 6 + 0.1 * (k % 20), 2.2 + 0.1 * (k % 4))
        two = (120 + 10 * (k % 3)) * _bell(x, 15 + 0.1 * (k % 20), 2.2 + 0.1 * (k % 3))
        return one + F.when(k % 2 == 0, two).otherwise(0.0) + 4 + _ripple(3 * x + k)

    f = fits.fit_two_gaussians_1d(_made(spark, sf_dir, (24,), value), HOURS, n_iter=40)
    two = F.col("n_peaks") == 2
    cols = [F.when(two, F.round(_c("params2", i), d) + F.lit(0.0)).alias(n) for i, (n, d) in enumerate((("A1", -1), ("sigma1", 1), ("mu1", 1), ("A2", -1), ("sigma2", 1), ("mu2", 1)))]
    return f.select(_supplier(f), F.col("n_peaks").cast("double").alias("n_peaks"), *cols)


ONE_PEAK = (_truth("100 + 10 * (k % 6)", "A", -1), _truth("4 + 0.1 * (k % 20)", "mu0"), _truth("3 + 0.1 * (k % 15)", "mu1"))


def _one_peak(k, x, y, cov=None):
    cov = cov or (1.5 + 0.1 * (k % 5), 0.1 * (k % 4), 1.2 + 0.1 * (k % 3))
    return (100 + 10 * (k % 6)) * _bell2(x, y, (4 + 0.1 * (k % 20), 3 + 0.1 * (k % 15)), cov) + 5


@query(_truths(*ONE_PEAK, _truth("1.5 + 0.1 * (k % 5)", "c00"), _truth("0.1 * (k % 4)", "c01"), _truth("1.2 + 0.1 * (k % 3)", "c11"), "CAST(5 AS DOUBLE) AS base", "CAST(1 AS DOUBLE) AS success"))
def fit_gauss_nd(spark, sf_dir):
    f = fits.fit_gaussian_nd(_made(spark, sf_dir, (11, 9), _one_peak), GRID2, n_iter=60)
    cov = [_on_grid(_c("cov", i, j), 1, f"c{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1))]
    return f.select(_supplier(f), _on_grid(F.col("A"), -1, "A"), _on_grid(_c("mu", 0), 1, "mu0"), _on_grid(_c("mu", 1), 1, "mu1"), *cov, _on_grid(F.col("c"), 0, "base"), "success")


@query(_truths(_truth("1 + (k + 1) % 2", "n_peaks", 0), _truth("200 + 10 * (k % 4)", "A1", -1), _truth("2.5 + 0.1 * (k % 5)", "m10"), _truth("2 + 0.1 * (k % 4)", "m11"),
               _truth("CASE WHEN k % 2 = 0 THEN 120 + 10 * (k % 3) ELSE 0 END", "A2", -1), _truth("CASE WHEN k % 2 = 0 THEN 7.5 + 0.1 * (k % 6) ELSE 0 END", "m20"), _truth("CASE WHEN k % 2 = 0 THEN 6 + 0.1 * (k % 3) ELSE 0 END", "m21")))
def fit_gauss_nd_two_peaks(spark, sf_dir):
    """Two peaks for even suppliers, one for odd."""
    def value(k, x, y):
        one = (200 + 10 * (k % 4)) * _bell2(x, y, (2.5 + 0.1 * (k % 5), 2 + 0.1 * (k % 4)), (1.0, 0.2, 0.9))
        two = (120 + 10 * (k % 3)) * _bell2(x, y, (7.5 + 0.1 * (k % 6), 6 + 0.1 * (k % 3)), (1.2, -0.2, 0.8))
        return one + F.when(k % 2 == 0, two).otherwise(0.0) + 5 + _ripple(3 * x + 5 * y + k)

    f = fits.fit_two_gaussians_nd(_made(spark, sf_dir, (11, 9), value), GRID2, (11, 9), n_iter=60)
    peaks = [c for i in (1, 2) for c in (_on_grid(F.col(f"A{i}"), -1, f"A{i}"), _on_grid(_c(f"mu{i}", 0), 1, f"m{i}0"), _on_grid(_c(f"mu{i}", 1), 1, f"m{i}1"))]
    return f.select(_supplier(f), F.col("n_peaks").cast("double").alias("n_peaks"), *peaks)


KNOWN_COV = (1.5, 0.3, 1.2)


@query(_truths(*ONE_PEAK, "CAST(5 AS DOUBLE) AS base", "CAST(1 AS DOUBLE) AS success"))
def fit_fixed_cov(spark, sf_dir):
    curves = _made(spark, sf_dir, (11, 9), lambda k, x, y: _one_peak(k, x, y, KNOWN_COV))
    f = fits.fit_fixed_cov(curves, GRID2, (11, 9), np.array([KNOWN_COV[:2], KNOWN_COV[1:]]))
    return f.select(_supplier(f), _on_grid(F.col("A"), -1, "A"), _on_grid(_c("mu", 0), 1, "mu0"), _on_grid(_c("mu", 1), 1, "mu1"), _on_grid(F.col("c"), 0, "base"), "success")


@query(_truths("CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS INT) AS source", "CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS INT) AS status",
               _truth("CASE WHEN k % 2 = 0 THEN 10.1 + 0.1 * (k % 5) ELSE 4 + 0.1 * (k % 20) END", "mu0"), _truth("3 + 0.1 * (k % 15)", "mu1"), "CAST(1 AS DOUBLE) AS success"))
def refit_edge_clipped(spark, sf_dir):
    """Even suppliers' peaks lie beyond the scanned range; the status says so and the refit finds them."""
    def value(k, x, y):
        mu = F.when(k % 2 == 0, 10.1 + 0.1 * (k % 5)).otherwise(4 + 0.1 * (k % 20))
        return (100 + 10 * (k % 6)) * _bell2(x, y, (mu, 3 + 0.1 * (k % 15)), KNOWN_COV) + 5

    curves = _made(spark, sf_dir, (11, 9), value)
    fit = fits.fit_gaussian_nd(curves, GRID2, n_iter=60)
    status = M.fit_status([_c("mu", 0), _c("mu", 1)], F.col("success"), [(0.0, 10.0), (0.0, 8.0)], [1.0, 1.0], data_edge=F.col("x") % 2 == 0, amplitude=F.col("A"))
    done = fits.refit_edges(curves, GRID2, (11, 9), fit.withColumn("status", status), "status", np.array([KNOWN_COV[:2], KNOWN_COV[1:]]))
    done = done.withColumn("status", fits.status_after_refit(F.col("status"), F.col("source")))
    return done.select(_supplier(done), F.col("source").cast("int").alias("source"), F.col("status").cast("int").alias("status"), _on_grid(_c("mu", 0), 1, "mu0"), _on_grid(_c("mu", 1), 1, "mu1"), "success")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
