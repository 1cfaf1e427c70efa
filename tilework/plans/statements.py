"""Queries in SQL: per-tile statistics, gates, catalogs, names, layouts and display rules, one statement for each.

A statement is plain SQL over px (see sources.tiles) and the given tables, with the spellings of functions.dialect."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}


def add(name: str, text: str) -> None:
    STATEMENTS[name] = text.strip()


# --- places, extents and regions -----------------------------------------------------------------------------------------
add("mosaic_extent", "SELECT CAST(max(trow * 6 + 8) AS INT) AS height, CAST(max(tcol * 6 + 8) AS INT) AS width FROM px")
add("tile_origins_plate", """
WITH t AS (SELECT DISTINCT vec_id, well, ty * 6 - tx * 1 AS oy, tx * 6 + ty * 1 AS ox FROM px)
SELECT vec_id, well, CAST(oy - min(oy) OVER (PARTITION BY well) AS INT) AS oy, CAST(ox - min(ox) OVER (PARTITION BY well) AS INT) AS ox FROM t""")
add("region_tile_prune", """
SELECT vec_id, CAST(trow * 6 + y - 10 AS INT) AS ry, CAST(tcol * 6 + x - 7 AS INT) AS rx, v FROM px
WHERE trow * 6 + 8 > 10 AND trow * 6 < 46 AND tcol * 6 + 8 > 7 AND tcol * 6 < 91
  AND trow * 6 + y BETWEEN 10 AND 45 AND tcol * 6 + x BETWEEN 7 AND 90""")
add("region_read_decimated", """
SELECT vec_id, CAST(IDIV[(y - 1);3] AS INT) AS y, CAST(IDIV[(x - 2);3] AS INT) AS x, v FROM px
WHERE y >= 1 AND x >= 2 AND (y - 1) % 3 = 0 AND (x - 2) % 3 = 0""")
# --- display ---------------------------------------------------------------------------------------------------------------
add("pixel_levels_gamma", """
SELECT vec_id, y, x, round(pow(greatest(0.0, least(1.0, (CAST(v AS DOUBLE) - 60) / 70)), CAST(1 AS DOUBLE) / 1.8), 6) AS s FROM px""")
add("pixel_gray", "SELECT vec_id, y, x, CAST(floor(greatest(0.0, least(1.0, (CAST(v AS DOUBLE) - 60) / 70)) * 255) AS INT) AS g FROM px")
add("composite_rgb", """
WITH s AS (SELECT well2, pos, z, y, x, ch, greatest(0.0, least(1.0, (CAST(v AS DOUBLE) - 60) / 70)) AS s FROM px)
SELECT well2, pos, z, y, x,
  CAST(floor(least(255.0, round(255 * sum(s * CASE WHEN ch = 0 THEN 1.0 ELSE 0.0 END), 6))) AS INT) AS r,
  CAST(floor(least(255.0, round(255 * sum(s * CASE WHEN ch = 0 THEN 0.25 ELSE 1.0 END), 6))) AS INT) AS g,
  CAST(floor(least(255.0, round(255 * sum(s * CASE WHEN ch = 0 THEN 0.0 ELSE 0.5 END), 6))) AS INT) AS b
FROM s GROUP BY well2, pos, z, y, x""")
add("auto_levels_p1_p995", """
SELECT well, CAST(floor(PCT[v;0.01]) AS INT) AS lo, CAST(greatest(floor(PCT[v;0.01]) + 1, floor(PCT[v;0.995])) AS INT) AS hi
FROM px WHERE v > 0 GROUP BY well""")
add("auto_levels_p997", """
SELECT trow, CAST(floor(PCT[v;0.01]) AS INT) AS lo, CAST(greatest(floor(PCT[v;0.01]) + 1, floor(PCT[v;0.997])) AS INT) AS hi
FROM px WHERE v > 0 GROUP BY trow""")
add("levels_effective", """
WITH a AS (SELECT well, CAST(floor(PCT[v;0.01]) AS INT) AS lo, CAST(floor(PCT[v;0.995]) AS INT) AS hi FROM px WHERE v > 0 GROUP BY well),
u AS (SELECT well, lo, hi, CASE WHEN well % 2 = 0 THEN 0 ELSE 10 * well END AS ulo, 255 AS uhi FROM a)
SELECT well, CAST(CASE WHEN ulo = 0 AND uhi = 255 THEN lo ELSE ulo END AS INT) AS lo, CAST(CASE WHEN ulo = 0 AND uhi = 255 THEN greatest(hi, lo + 1) ELSE uhi END AS INT) AS hi FROM u""")
add("channel_visibility", """
SELECT DISTINCT pos, ch, CASE WHEN ch = 0 AND max(CASE WHEN ch = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY well2, pos) = 1 THEN 0 ELSE 1 END AS visible, well2 FROM px""")
add("decimate", "SELECT vec_id, CAST(IDIV[y;2] AS INT) AS y, CAST(IDIV[x;2] AS INT) AS x, v FROM px WHERE y % 2 = 0 AND x % 2 = 0")
add("saturation_mask", "SELECT well, CAST(sum(CASE WHEN v >= 140 THEN 1 ELSE 0 END) AS BIGINT) AS saturated, count(*) AS n FROM px GROUP BY well")
# --- samples and filters ---------------------------------------------------------------------------------------------------
add("bilinear_sample", """
WITH g AS (SELECT vec_id, y, x, v FROM px), s AS (SELECT y + 0.25 AS sy, x + 0.5 AS sx, y AS iy, x AS ix, vec_id FROM px WHERE y < 7 AND x < 7)
SELECT s.vec_id, s.iy, s.ix, round(sum(g.v * (1 - abs(s.sy - g.y)) * (1 - abs(s.sx - g.x))), 6) AS v
FROM s JOIN g ON s.vec_id = g.vec_id AND (g.y = s.iy OR g.y = s.iy + 1) AND (g.x = s.ix OR g.x = s.ix + 1) GROUP BY s.vec_id, s.iy, s.ix""".replace("y + 0.25", "CAST(y AS DOUBLE) + CAST(0.25 AS DOUBLE)").replace("x + 0.5", "CAST(x AS DOUBLE) + CAST(0.5 AS DOUBLE)"))
add("nearest_sample", """
WITH s AS (SELECT vec_id, y, x, CAST(least(7, floor(CAST(y AS DOUBLE) * 0.9 + 0.5)) AS INT) AS iy, CAST(least(7, floor(CAST(x AS DOUBLE) * 1.1 + 0.5)) AS INT) AS ix FROM px)
SELECT s.vec_id, s.y, s.x, g.v FROM s JOIN px g ON s.vec_id = g.vec_id AND s.iy = g.y AND s.ix = g.x""")
add("highpass", """
SELECT vec_id, y, x, round(v - avg(CAST(v AS DOUBLE)) OVER (PARTITION BY vec_id), 6) AS s FROM px WHERE y % 2 = 0 AND x % 2 = 0""")
add("gaussian_lowpass", """
WITH k AS (SELECT a.vec_id, a.y, a.x, b.v, exp(-CAST((a.x - b.x) * (a.x - b.x) AS DOUBLE) / 4.5) AS w FROM px a JOIN px b ON a.vec_id = b.vec_id AND a.y = b.y)
SELECT vec_id, y, x, round(sum(w * v) / sum(w), 5) AS v FROM k GROUP BY vec_id, y, x""")
add("checkerboard_split", """
SELECT vec_id, CAST((IDIV[y;4] + IDIV[x;4]) % 2 AS INT) AS part, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM px GROUP BY vec_id, CAST((IDIV[y;4] + IDIV[x;4]) % 2 AS INT)""")
add("parity_groups", "SELECT CAST(trow % 2 AS INT) AS rp, CAST(tcol % 2 AS INT) AS cp, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM px GROUP BY CAST(trow % 2 AS INT), CAST(tcol % 2 AS INT)")
# --- stacks ------------------------------------------------------------------------------------------------------------------
add("z_max", "SELECT well2, pos, ch, y, x, max(v) AS v FROM px GROUP BY well2, pos, ch, y, x")
add("z_mean", "SELECT well2, pos, ch, y, x, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM px GROUP BY well2, pos, ch, y, x")
add("z_middle", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY well2, pos, ch, y, x ORDER BY z) AS k, count(*) OVER (PARTITION BY well2, pos, ch, y, x) AS n FROM px)
SELECT well2, pos, ch, y, x, v FROM r WHERE k = IDIV[n;2] + 1""")
add("z_every_nth", """
WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY well2, pos, ch ORDER BY z) AS k FROM px) SELECT well2, pos, ch, z, y, x, v FROM r WHERE (k - 1) % 2 = 0""")
# --- flat field and low-frequency fields ---------------------------------------------------------------------------------------
FLAT = """
WITH m AS (SELECT well, CASE WHEN avg(v) > median(v) THEN 0.25 ELSE 0.75 END AS q, count(DISTINCT vec_id) AS n FROM px GROUP BY well),
p AS (SELECT px.well, y, x, CASE WHEN max(m.q) < 0.5 THEN PCT[v;0.25] ELSE PCT[v;0.75] END AS f FROM px JOIN m ON px.well = m.well WHERE m.n >= 4 GROUP BY px.well, y, x),
f AS (SELECT well, y, x, greatest(CAST(0.2 AS DOUBLE), least(CAST(5 AS DOUBLE), f / avg(f) OVER (PARTITION BY well))) AS f FROM p)"""
add("flatfield_estimate", FLAT + " SELECT well, y, x, round(f, 6) AS f FROM f")
add("flatfield_apply", FLAT + " SELECT px.vec_id, px.y, px.x, round(px.v / coalesce(f.f, 1), 3) AS v FROM px LEFT JOIN f ON px.well = f.well AND px.y = f.y AND px.x = f.x")
add("field_lowfreq", """
WITH m AS (SELECT vec_id, median(v) AS m FROM px GROUP BY vec_id),
d AS (SELECT px.trow, y, x, v - m.m AS d FROM px JOIN m ON px.vec_id = m.vec_id),
f AS (SELECT trow, y, x, median(d) AS f FROM d GROUP BY trow, y, x)
SELECT trow, y, x, round(f - avg(f) OVER (PARTITION BY trow), 6) AS f FROM f""")
add("field_agreement", """
WITH a AS (SELECT y, x, median(CASE WHEN trow % 2 = 0 THEN v END) AS a, median(CASE WHEN trow % 2 = 1 THEN v END) AS b FROM px GROUP BY y, x)
SELECT round(CASE WHEN stddev_pop(a) < 1e-8 OR stddev_pop(b) < 1e-8 THEN 0 ELSE corr(a, b) END, 6) AS r,
  round(sqrt(avg((a - b) * (a - b))) / greatest(CAST(0.5 AS DOUBLE), (PCT[a;0.95] - PCT[a;0.05] + PCT[b;0.95] - PCT[b;0.05]) / 2), 6) AS disagreement FROM a""")
add("dynamic_range", "WITH t AS (SELECT vec_id, PCT[v;0.99] - PCT[v;0.01] AS d FROM px GROUP BY vec_id) SELECT round(median(d), 6) AS d FROM t")
# --- edges, votes and seams --------------------------------------------------------------------------------------------------
EDGES = """
t AS (SELECT DISTINCT vec_id, trow, tcol FROM px),
e AS (SELECT a.vec_id AS a, b.vec_id AS b, 'x' AS axis FROM t a JOIN t b ON b.trow = a.trow AND b.tcol = a.tcol + 1
  UNION ALL SELECT a.vec_id, b.vec_id, 'y' FROM t a JOIN t b ON b.trow = a.trow + 1 AND b.tcol = a.tcol),
g AS (SELECT vec_id, trow * 6 + y AS gy, tcol * 6 + x AS gx, v FROM px),
o AS (SELECT e.a, e.b, e.axis, p.gy, p.gx, p.v AS va, q.v AS vb FROM e JOIN g p ON p.vec_id = e.a JOIN g q ON q.vec_id = e.b AND q.gy = p.gy AND q.gx = p.gx)"""
SEAMS = EDGES + """,
m AS (SELECT a, b, axis, median(va - vb) AS bias, count(*) AS n, PCT[abs(va - vb);0.95] AS p95,
  CASE WHEN stddev_pop(va) < 1e-9 OR stddev_pop(vb) < 1e-9 THEN 0 ELSE corr(CAST(va AS DOUBLE), CAST(vb AS DOUBLE)) END AS ncc FROM o GROUP BY a, b, axis),
s AS (SELECT o.a, o.b, o.axis, max(m.bias) AS bias, 1.4826 * median(abs(o.va - o.vb - m.bias)) AS mad, max(m.p95) AS p95, max(m.n) AS n, max(m.ncc) AS ncc
  FROM o JOIN m ON o.a = m.a AND o.b = m.b GROUP BY o.a, o.b, o.axis)"""
add("overlap_ncc", "WITH " + SEAMS + " SELECT a, b, axis, n, round(ncc, 6) AS ncc FROM m")
add("seam_stats_mad_p95", "WITH " + SEAMS + " SELECT a, b, axis, round(bias, 6) AS bias, round(mad, 6) AS mad, round(p95, 6) AS p95 FROM s")
add("seam_orientation_qc", "WITH " + SEAMS + " SELECT axis, round(median(abs(bias)), 6) AS bias, round(median(mad), 6) AS mad, round(median(p95), 6) AS p95, count(*) AS n FROM s GROUP BY axis")
add("seam_gate", "WITH " + SEAMS + """, q AS (SELECT axis, median(abs(bias)) AS rb, median(abs(0.7 * bias)) AS cb, median(mad) AS rm, median(p95) AS rp, median(0.95 * p95) AS cp FROM s GROUP BY axis)
SELECT CASE WHEN min(CASE WHEN cb <= 1.02 * rb + 0.25 AND rm <= 1.02 * rm + 0.25 AND cp <= 1.02 * rp + 0.25 THEN 1 ELSE 0 END) = 1
  AND max(CASE WHEN rb >= 0.25 AND cb <= 0.8 * rb THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS safe FROM q""")
WEIGHT = """greatest(0.0, least(1.0, (ncc - 0.04) / 0.45)) * greatest(0.15, least(1.0, psr / 12.0)) * greatest(0.20, least(1.0, (margin + 0.02) / 0.25))"""
GATED = "WITH " + SEAMS + ", k AS (SELECT a, b, axis, ncc, 2 + abs(ncc) * 10 AS psr, abs(bias) / 40 AS margin, n, bias, mad FROM s)"
add("edge_weight_gate", GATED + f"""
SELECT a, b, axis, CASE WHEN ncc >= 0.08 AND psr >= 4.0 THEN 1 ELSE 0 END AS accepted, CASE WHEN ncc >= 0.08 AND psr >= 4.0 THEN '' ELSE 'weak_match' END AS reason,
  round(CASE WHEN ncc >= 0.08 AND psr >= 4.0 THEN greatest(0.02, {WEIGHT}) ELSE 0 END, 6) AS weight FROM k""")
add("edge_alignment_table", GATED + """
SELECT axis, a, b, CASE WHEN ncc >= 0.08 THEN 1 ELSE 0 END AS accepted, CASE WHEN axis = 'x' THEN 0.0 ELSE 6.0 END AS stage_dy, CASE WHEN axis = 'x' THEN 6.0 ELSE 0.0 END AS stage_dx,
  round(ncc, 4) AS ncc, round(psr, 4) AS psr, round(margin, 4) AS peak_margin, round(mad, 4) AS texture FROM k""".replace("0.0 ELSE 6.0 END", "CAST(0 AS DOUBLE) ELSE CAST(6 AS DOUBLE) END").replace("6.0 ELSE 0.0 END", "CAST(6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"))
add("edge_qc_report", GATED + """
SELECT CAST(IDIV[a;100] AS INT) AS grp, round(median(mad), 3) AS residual_median, round(PCT[mad;0.95], 3) AS residual_p95, round(max(mad), 3) AS residual_max, round(median(ncc), 3) AS ncc_median, round(min(ncc), 3) AS ncc_min,
  CAST(sum(CASE WHEN margin < 0.02 THEN 1 ELSE 0 END) AS BIGINT) AS ambiguous FROM k GROUP BY CAST(IDIV[a;100] AS INT)""")
add("holdout_edges", "WITH " + EDGES + """, f AS (SELECT a, b, axis, row_number() OVER (PARTITION BY axis ORDER BY a, b) AS rn, count(*) OVER () AS n FROM e)
SELECT a, b, axis, CASE WHEN n >= 12 AND (rn - 1) % 5 = 2 THEN 1 ELSE 0 END AS held FROM f""")
add("offset_pair_summary", "WITH " + EDGES + """,
d AS (SELECT a, b, CAST((IDIV[gy;4] + IDIV[gx;4]) % 2 AS INT) AS part, va - vb AS d FROM o),
c AS (SELECT a, b, part, median(d) AS c, count(*) AS n FROM d GROUP BY a, b, part),
m AS (SELECT d.a, d.b, d.part, max(c.c) AS c, max(c.n) AS n, 1.4826 * median(abs(d.d - c.c)) AS mad FROM d JOIN c ON d.a = c.a AND d.b = c.b AND d.part = c.part GROUP BY d.a, d.b, d.part)
SELECT a, b, CAST(sum(CASE WHEN part = 0 THEN n ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN part = 1 THEN n ELSE 0 END) AS BIGINT) AS held,
  round(abs(max(CASE WHEN part = 0 THEN c END) - max(CASE WHEN part = 1 THEN c END)), 6) AS split, round(greatest(CAST(0.5 AS DOUBLE), 0.25 * sum(mad)), 6) AS consistency FROM m GROUP BY a, b""")
add("pair_fit_reason", "WITH " + SEAMS + """, r AS (SELECT a, b, n * 100 AS samples, p95 / 100 AS saturation, mad / 100 AS dynamic, abs(ncc) AS corr, 1 - mad / 50 AS inlier, 1 + bias / 100 AS slope FROM s)
SELECT a, b, CASE WHEN samples < 1024 THEN 'too_few_samples' WHEN saturation > 0.35 THEN 'saturated_overlap' WHEN dynamic < 0.12 THEN 'low_information'
  WHEN corr < 0.2 OR inlier < 0.60 THEN 'unstable_affine_fit' WHEN NOT (slope BETWEEN 0.80 AND 1.25) THEN 'affine_fit_out_of_bounds' ELSE '' END AS reason FROM r""")
add("clip_preflight", """
SELECT well, CAST(sum(CASE WHEN v < 140 THEN 1 ELSE 0 END) AS BIGINT) AS open, CAST(sum(CASE WHEN v < 140 AND v * 1.05 + 2 >= 140 THEN 1 ELSE 0 END) AS BIGINT) AS clipped,
  CASE WHEN sum(CASE WHEN v < 140 AND v * 1.05 + 2 >= 140 THEN 1 ELSE 0 END) <= 0.0001 * sum(CASE WHEN v < 140 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS ok FROM px GROUP BY well""")
CANDIDATES = """
c AS (SELECT well AS pair, vec_id, CAST(max(v) % 7 - 3 AS INT) AS dy, CAST(90 + min(v) % 9 AS INT) AS dx, round(avg(CAST(v AS DOUBLE)) / 150, 6) AS s FROM px GROUP BY well, vec_id)"""
add("shift_candidates_topk", "WITH " + CANDIDATES + ", r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY s DESC, vec_id) AS k FROM c) SELECT pair, vec_id, dy, dx, s, CAST(k AS INT) AS k FROM r WHERE k <= 6")
add("runner_up_outside", "WITH " + CANDIDATES + """, b AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY s DESC, vec_id) AS k FROM c)
SELECT f.pair, max(f.s) AS best, max(CASE WHEN abs(o.dy - f.dy) > 2 OR abs(o.dx - f.dx) > 2 THEN o.s END) AS rival FROM b f JOIN b o ON f.pair = o.pair WHERE f.k = 1 GROUP BY f.pair""")
add("shift_consensus", "WITH " + CANDIDATES + """,
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY s DESC, vec_id) AS k FROM c) q WHERE k <= 6),
p AS (SELECT f.vec_id, o.pair, max(o.s) AS m FROM t f JOIN t o ON abs(o.dy - f.dy) <= 1 AND abs(o.dx - f.dx) <= 1 GROUP BY f.vec_id, o.pair),
v AS (SELECT vec_id, count(*) AS votes, sum(m) AS total FROM p GROUP BY vec_id),
w AS (SELECT vec_id, votes, total FROM v ORDER BY votes DESC, round(total, 6) DESC, vec_id LIMIT 1)
SELECT max(w.vec_id) AS winner, max(w.votes) AS votes, round(max(w.total / w.votes), 6) AS score, CAST(median(o.dy) AS INT) AS dy, CAST(median(o.dx) AS INT) AS dx
FROM w JOIN t f ON f.vec_id = w.vec_id JOIN t o ON abs(o.dy - f.dy) <= 1 AND abs(o.dx - f.dx) <= 1 JOIN p ON p.vec_id = w.vec_id AND p.pair = o.pair AND p.m = o.s""".replace("CAST(median(o.dy) AS INT)", "CAST(floor(median(o.dy)) AS INT)").replace("CAST(median(o.dx) AS INT)", "CAST(floor(median(o.dx)) AS INT)"))
add("step_fallback", """
WITH w AS (SELECT well, round(avg(CAST(v AS DOUBLE)) / 640, 6) AS score, CAST(min(v) AS INT) AS dx FROM px GROUP BY well), p AS (SELECT CAST(floor(median(dx)) AS INT) AS dx FROM w WHERE score >= 0.15)
SELECT well, CASE WHEN score >= 0.15 THEN 'measured' WHEN p.dx IS NOT NULL THEN 'plate' ELSE 'abut' END AS source, CAST(CASE WHEN score >= 0.15 THEN w.dx WHEN p.dx IS NOT NULL THEN p.dx ELSE 8 END AS INT) AS dx FROM w LEFT JOIN p ON 1 = 1""")
add("overlap_plausible", "SELECT vec_id, CASE WHEN CAST(max(v) % 9 AS DOUBLE) BETWEEN 8 * 0.25 AND 8 * 0.97 THEN 1 ELSE 0 END AS ok FROM px GROUP BY vec_id")
add("reference_channel", """
WITH s AS (SELECT ch, vec_id, stddev_pop(CAST(v AS DOUBLE)) AS d FROM px GROUP BY ch, vec_id) SELECT ch, round(median(d), 6) AS texture FROM s GROUP BY ch""")
add("affine_fit_stats", """
SELECT count(*) AS n, CAST(sum(trow) AS BIGINT) AS sr, CAST(sum(tcol) AS BIGINT) AS sc, CAST(sum(trow * trow) AS BIGINT) AS srr, CAST(sum(tcol * tcol) AS BIGINT) AS scc, CAST(sum(trow * tcol) AS BIGINT) AS src,
  CAST(sum(v) AS BIGINT) AS sv, CAST(sum(v * trow) AS BIGINT) AS svr, CAST(sum(v * tcol) AS BIGINT) AS svc FROM px""")
add("tls_fit_unrolled", """
WITH m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice / 1000) AS b FROM lineitem),
c AS (SELECT var_pop(l_quantity) AS saa, var_pop(l_extendedprice / 1000) AS sbb, covar_pop(l_quantity, l_extendedprice / 1000) AS sab FROM lineitem)
SELECT round((sbb - saa + sqrt((sbb - saa) * (sbb - saa) + 4 * sab * sab)) / (2 * sab), 5) AS slope, round(b - a * (sbb - saa + sqrt((sbb - saa) * (sbb - saa) + 4 * sab * sab)) / (2 * sab), 4) AS intercept FROM m JOIN c ON 1 = 1""")
add("robust_line_stats", """
WITH m AS (SELECT l_returnflag AS f, median(l_discount) AS c FROM lineitem GROUP BY l_returnflag)
SELECT f, round(1.4826 * median(abs(l_discount - c)), 6) AS mad, round(PCT[l_quantity;0.95], 4) AS p95, round(PCT[l_quantity;0.05], 4) AS p05 FROM lineitem JOIN m ON l_returnflag = f GROUP BY f""")
# --- stage coordinates -------------------------------------------------------------------------------------------------------
STAGE = "s AS (SELECT DISTINCT vec_id, trow, tcol, CAST(1000000 - 80000 * tcol AS BIGINT) AS sx, CAST(2000000 - 60000 * trow AS BIGINT) AS sy FROM px)"
SIGN = STAGE + """,
dx AS (SELECT b.sx - a.sx AS d FROM s a JOIN s b ON b.trow = a.trow AND b.tcol = a.tcol + 1), dy AS (SELECT b.sy - a.sy AS d FROM s a JOIN s b ON b.trow = a.trow + 1 AND b.tcol = a.tcol),
g AS (SELECT 'x' AS axis, CASE WHEN count(*) = 0 THEN -1 WHEN min(d) < 0 AND max(d) > 0 THEN 0 WHEN median(d) > 0 THEN 1 ELSE -1 END AS sign FROM dx WHERE d <> 0
  UNION ALL SELECT 'y', CASE WHEN count(*) = 0 THEN -1 WHEN min(d) < 0 AND max(d) > 0 THEN 0 WHEN median(d) > 0 THEN 1 ELSE -1 END FROM dy WHERE d <> 0)"""
add("stage_sign", "WITH " + SIGN + " SELECT axis, CAST(sign AS INT) AS sign FROM g")
add("stage_origins", "WITH " + SIGN + """, o AS (SELECT s.vec_id, gy.sign * s.sy / 3000.0 AS y, gx.sign * s.sx / 2000.0 AS x FROM s JOIN g gx ON gx.axis = 'x' JOIN g gy ON gy.axis = 'y')
SELECT vec_id, round(CAST(y - min(y) OVER () AS DOUBLE), 6) AS y, round(CAST(x - min(x) OVER () AS DOUBLE), 6) AS x FROM o""".replace("/ 3000.0", "/ CAST(3000 AS DOUBLE)").replace("/ 2000.0", "/ CAST(2000 AS DOUBLE)"))
# --- plates and quality ------------------------------------------------------------------------------------------------------
PLATE = "w AS (SELECT well, CAST(min(v) AS INT) AS sx, CAST(max(v) AS INT) AS sy, round(avg(CAST(v AS DOUBLE)) / 640, 6) AS peak FROM px GROUP BY well)"
add("plate_geometry", "WITH " + PLATE + " SELECT CAST(floor(median(sx)) AS INT) AS step_x, CAST(floor(median(sy)) AS INT) AS step_y, round(greatest(stddev_pop(sx), stddev_pop(sy)), 6) AS spread, count(*) AS n FROM w WHERE peak >= 0.15")
REPORT = PLATE + """, p AS (SELECT floor(median(sx)) AS px_, floor(median(sy)) AS py_ FROM w WHERE peak >= 0.15),
r AS (SELECT well, 160 - sx AS overlap_x, 160 - sy AS overlap_y, round(CAST(greatest(abs(sx - px_), abs(sy - py_)) AS DOUBLE), 1) AS deviation, CASE WHEN sx / CAST(160 AS DOUBLE) >= 0.4 THEN 1 ELSE 0 END AS shading_ok, CASE WHEN peak < 0.15 THEN 1 ELSE 0 END AS low FROM w JOIN p ON 1 = 1)"""
add("well_qc_report", "WITH " + REPORT + " SELECT well, CAST(overlap_x AS INT) AS overlap_x, CAST(overlap_y AS INT) AS overlap_y, deviation, shading_ok, low FROM r")
add("well_qc_warnings", "WITH " + REPORT + """
SELECT well, 'alignment uncertain' AS warning FROM r WHERE low = 1 UNION ALL SELECT well, 'differs from the plate' FROM r WHERE deviation > 8 UNION ALL SELECT well, 'shading not separable' FROM r WHERE shading_ok = 0""")
add("plate_prior_running", "WITH " + PLATE + """
SELECT a.well, count(b.well) AS n, CAST(floor(median(b.sx)) AS INT) AS prior_x FROM w a LEFT JOIN w b ON b.well < a.well AND b.peak >= 0.15 GROUP BY a.well""")
HOLES = "t AS (SELECT DISTINCT well2, pos, ch, z, vec_id FROM px WHERE vec_id % 11 <> 3)"
add("grid_completeness", "WITH " + HOLES + " SELECT well2, count(DISTINCT pos) AS positions, count(*) AS files, CASE WHEN count(*) = count(DISTINCT pos) * 10 THEN 1 ELSE 0 END AS complete FROM t GROUP BY well2")
add("missing_sources", "WITH " + HOLES + ", a AS (SELECT DISTINCT well2, pos, ch, z FROM px) SELECT a.well2, a.pos, a.ch, a.z FROM a LEFT JOIN t ON a.well2 = t.well2 AND a.pos = t.pos AND a.ch = t.ch AND a.z = t.z WHERE t.vec_id IS NULL")
add("tag_completeness", "WITH " + HOLES.replace("vec_id % 11 <> 3", "IDIV[vec_id;5] % 7 <> 3") + ", p AS (SELECT DISTINCT well2, pos FROM t), c AS (SELECT DISTINCT well2, ch FROM t), h AS (SELECT DISTINCT well2, pos, ch FROM t) SELECT p.well2, p.pos, c.ch FROM p JOIN c ON p.well2 = c.well2 LEFT JOIN h ON h.well2 = p.well2 AND h.pos = p.pos AND h.ch = c.ch WHERE h.ch IS NULL")
add("duplicate_tags", "SELECT pos, ch, z, count(DISTINCT vec_id) AS n FROM px GROUP BY pos, ch, z HAVING count(DISTINCT vec_id) > 1")
add("ragged_crop", "WITH s AS (SELECT vec_id, pos, well2, max(y) - vec_id % 2 AS h, max(x) - vec_id % 3 AS w FROM px GROUP BY vec_id, pos, well2) SELECT well2, pos, CAST(min(h) AS INT) AS h, CAST(min(w) AS INT) AS w FROM s GROUP BY well2, pos")
add("component_suppression", """
WITH c AS (SELECT DISTINCT vec_id, CAST(IDIV[vec_id;(7 + IDIV[vec_id;100])] AS INT) AS comp FROM px), n AS (SELECT comp, count(*) AS n FROM c GROUP BY comp), t AS (SELECT count(*) AS tiles FROM c)
SELECT c.vec_id, c.comp, CASE WHEN n.n < CASE WHEN t.tiles >= 24 THEN 8 ELSE 2 END THEN 1 ELSE 0 END AS suppressed FROM c JOIN n ON c.comp = n.comp JOIN t ON 1 = 1""")
add("cursor_readout", "SELECT vec_id, y, x, v, round((CAST(1000000 AS DOUBLE) + (tcol * 6 + x) * 2000) / 1000, 3) AS x_um, round((CAST(2000000 AS DOUBLE) + (trow * 6 + y) * 3000) / 1000, 3) AS y_um FROM px")
add("metadata_report", "SELECT trow, concat('tiles ', CAST(count(DISTINCT vec_id) AS VARCHAR(20)), ', ', CAST(max(tcol) * 6 + 8 AS VARCHAR(20)), ' x 8 px') AS report FROM px GROUP BY trow")
# --- names, paths and text -----------------------------------------------------------------------------------------------------
add("parse_tile_name", """
WITH f AS (SELECT p_partkey AS k, concat('Cap_X00', CAST(p_partkey % 10 AS VARCHAR(9)), 'Y01', CAST(p_size % 10 AS VARCHAR(9)), CASE WHEN p_partkey % 2 = 0 THEN concat('_Z00', CAST(p_partkey % 7 AS VARCHAR(9))) ELSE '' END, '_ch', CAST(p_partkey % 4 AS VARCHAR(9)), '.bz.ome.tif') AS name FROM part)
SELECT k, CAST(RX[name;'X(\\d+)Y\\d+';1] AS INT) AS x, CAST(RX[name;'X\\d+Y(\\d+)';1] AS INT) AS y, CAST(coalesce(nullif(RX[name;'_Z(\\d+)';1], ''), '0') AS INT) AS z, upper(RX[name;'_(ch\\w+)';1]) AS channel FROM f""")
add("parse_well_channel", """
WITH f AS (SELECT c_custkey AS k, concat('Plate_', CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE 'A' END, CASE WHEN c_custkey % 9 < 5 THEN '0' ELSE '1' END, CAST(c_custkey % 9 AS VARCHAR(9)), '_CH', CAST(c_nationkey % 4 AS VARCHAR(9))) AS stem FROM customer)
SELECT k, RX[stem;'_(\\w\\d+)_';1] AS well, RX[stem;'_(CH\\w+)';1] AS channel FROM f""")
add("source_tag", "SELECT p_partkey AS k, AT[SPLIT[RXREP[concat('t_', p_brand, '_C', CAST(p_size AS VARCHAR(9)), '.bz.ome.tif');'\\.bz\\.ome\\.tiff?$';''];'_'];-1] AS tag FROM part")
add("path_safe", "WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN '../up/a.tif' WHEN p_partkey % 4 = 1 THEN '/abs/a.tif' WHEN p_partkey % 4 = 2 THEN 'a/../../b.tif' ELSE 'ok/a.tif' END AS path FROM part) SELECT k, path, CASE WHEN path LIKE '/%' OR concat('/', path, '/') LIKE '%/../%' THEN 0 ELSE 1 END AS safe FROM p")
PATHS = "f AS (SELECT o_orderkey AS k, concat('/d', CAST(o_custkey % 40 AS VARCHAR(9)), '/e', CAST(o_orderkey % 6 AS VARCHAR(9)), CASE WHEN o_orderkey % 3 = 0 THEN '/sub' ELSE '' END) AS dir, concat('Cap_A', CAST(o_orderkey % 12 AS VARCHAR(9)), '_CH', CAST(o_custkey % 3 AS VARCHAR(9)), CASE WHEN o_orderkey % 7 = 0 THEN '.gci' ELSE '.ktf' END) AS name FROM orders)"
add("classify_folder", "WITH " + PATHS + " SELECT dir, CASE WHEN count(DISTINCT CASE WHEN name LIKE '%.gci' THEN name END) = 1 THEN 'mosaic' WHEN max(CASE WHEN name LIKE '%.ktf' THEN 1 ELSE 0 END) = 1 THEN 'ktf' ELSE 'other' END AS kind FROM f GROUP BY dir")
add("folder_summary", "WITH " + PATHS + " SELECT dir, min(name) AS example, count(DISTINCT RX[name;'_(A\\d+)_';1]) AS wells, count(DISTINCT RX[name;'_(CH\\d+)';1]) AS channels FROM f WHERE name LIKE '%.ktf' AND name NOT LIKE '._%' GROUP BY dir".replace("LIKE '._%'", "LIKE '.\\_%'") .replace(" AND name NOT LIKE '.\\_%'", " AND substr(name, 1, 2) <> '._'"))
add("scan_last_wins", "WITH " + PATHS + " SELECT dir, RX[name;'_(A\\d+)_';1] AS well, RX[name;'_(CH\\d+)';1] AS channel, max(name) AS kept, MAXBY[k;ROWS[name;k]] AS k FROM f WHERE name LIKE '%.ktf' GROUP BY dir, RX[name;'_(A\\d+)_';1], RX[name;'_(CH\\d+)';1]")
add("label_json_roundtrip", "SELECT event_type, count(*) AS n, count(DISTINCT props) AS labels, max(length(props)) AS longest FROM events GROUP BY event_type".replace("max(length(props))", "CAST(max(length(props)) AS INT)"))
add("color_unpack", "SELECT p_partkey AS k, CAST(IDIV[(p_partkey * 7919);256] % 256 AS INT) AS r, CAST(p_partkey * 7919 % 256 AS INT) AS g, CAST(p_size AS INT) AS b FROM part")
add("unit_to_um", "WITH u AS (SELECT p_partkey AS k, p_retailprice AS v, CASE WHEN p_partkey % 5 = 0 THEN 'nm' WHEN p_partkey % 5 = 1 THEN 'um' WHEN p_partkey % 5 = 2 THEN 'mm' WHEN p_partkey % 5 = 3 THEN 'm' ELSE 'ft' END AS u FROM part) SELECT k, CASE WHEN v <= 0 THEN NULL WHEN u = 'nm' THEN v / 1000 WHEN u = 'um' THEN v WHEN u = 'mm' THEN v * 1000 WHEN u = 'm' THEN v * 1000000 END AS um FROM u")
add("display_name", "WITH f AS (SELECT c_custkey AS k, concat('exp', CAST(c_nationkey AS VARCHAR(9))) AS parent, CASE WHEN c_custkey % 3 = 0 THEN concat('XY0', CAST(c_custkey % 9 AS VARCHAR(9))) ELSE c_name END AS folder FROM customer) SELECT k, CASE WHEN length(RX[folder;'^(XY\\d+)$';1]) > 0 THEN parent ELSE folder END AS name FROM f")
# --- conditions, series, layout and sinks ----------------------------------------------------------------------------------------
COND = "c AS (SELECT c_custkey AS k, CAST(c_custkey % 20 AS INT) AS well, 'Sample' AS header, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, CAST(c_custkey % 20 AS INT), 'Notes', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END FROM customer)"
add("conditions_caption", "WITH " + COND + " SELECT k, well, concat(header, ': ', value) AS caption FROM c WHERE value <> ''")
add("conditions_merge", "WITH " + COND + ", o AS (SELECT * FROM c WHERE k % 3 <> 0), n AS (SELECT k, well, header, upper(value) AS value FROM c WHERE k % 2 = 0) SELECT coalesce(n.k, o.k) AS k, coalesce(n.header, o.header) AS header, coalesce(n.value, o.value) AS value FROM o FULL OUTER JOIN n ON o.k = n.k AND o.header = n.header")
add("conditions_pivot", "WITH " + COND + " SELECT k, max(CASE WHEN header = 'Sample' THEN value END) AS sample, max(CASE WHEN header = 'Notes' THEN value END) AS notes FROM c GROUP BY k")
add("conditions_restore", "WITH " + COND + ", w AS (SELECT DISTINCT well FROM px) SELECT w.well, coalesce(max(c.value), '') AS value FROM w LEFT JOIN c ON w.well = c.well AND c.header = 'Notes' GROUP BY w.well")
add("plate_layout", """
WITH t AS (SELECT DISTINCT vec_id, CAST(well % 8 AS INT) AS r, CAST(IDIV[well;8] + 1 AS INT) AS c FROM px), g AS (SELECT DISTINCT r, c FROM t),
k AS (SELECT r, c, dense_rank() OVER (ORDER BY r) AS i, dense_rank() OVER (ORDER BY c) AS j FROM g)
SELECT r, c, CAST(30 + (j - 1) * 392 + 12 AS INT) AS left_px, CAST(78 + (i - 1) * 392 + 12 AS INT) AS top_px FROM k""")
add("planned_outputs", "WITH z AS (SELECT DISTINCT well2, z + 5 * pos AS z FROM px), s AS (SELECT 'ome' AS kind UNION ALL SELECT 'png') SELECT z.well2, z.z, s.kind, concat('W', CAST(z.well2 AS VARCHAR(9)), '_Z', lpad(CAST(z.z AS VARCHAR(9)), CAST(greatest(3, length(CAST(z.z AS VARCHAR(9)))) AS INT), '0'), '.', s.kind) AS name FROM z JOIN s ON 1 = 1")
add("overwrite_check", "WITH p AS (SELECT DISTINCT concat('W', CAST(well2 AS VARCHAR(9)), '_', CAST(z AS VARCHAR(9))) AS name FROM px), e AS (SELECT DISTINCT concat('W', CAST(well2 AS VARCHAR(9)), '_', CAST(ch AS VARCHAR(9))) AS name FROM px) SELECT p.name FROM p JOIN e ON p.name = e.name")
add("series_labels", "SELECT c_custkey AS k, concat(c_name, CASE WHEN c_custkey % 2 = 0 THEN concat(' · Time point: ', CAST(c_custkey % 24 AS VARCHAR(9))) ELSE '' END, CASE WHEN c_custkey % 3 = 0 THEN concat(' · Stack: ', c_mktsegment) ELSE '' END) AS label FROM customer")
add("series_summary", "WITH w AS (SELECT well2, count(DISTINCT pos) AS wells FROM px GROUP BY well2) SELECT count(*) AS captures, CAST(sum(wells) AS BIGINT) AS wells, CAST(sum(CASE WHEN well2 % 2 = 0 THEN 1 ELSE wells END) AS BIGINT) AS pages FROM w")
add("structure_diff", "WITH a AS (SELECT DISTINCT pos, ch FROM px WHERE well2 = 0), b AS (SELECT DISTINCT well2, pos, ch FROM px WHERE vec_id % 11 <> 3), w AS (SELECT DISTINCT well2 FROM px) SELECT w.well2, a.pos, a.ch FROM w JOIN a ON 1 = 1 LEFT JOIN b ON b.well2 = w.well2 AND b.pos = a.pos AND b.ch = a.ch WHERE b.pos IS NULL")
add("progress_fraction", "WITH t AS (SELECT DISTINCT well FROM px) SELECT well, round(count(*) OVER (ORDER BY well) / CAST(count(*) OVER () AS DOUBLE), 6) AS done FROM t")
add("first_messages", "WITH m AS (SELECT c_nationkey AS n, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS k, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer) SELECT n, c_name, CAST(k AS INT) AS k, CAST(greatest(total - 6, 0) AS BIGINT) AS more FROM m WHERE k <= 6")
# --- display rules on numbers ------------------------------------------------------------------------------------------------------
add("dpi_rule", "WITH r AS (SELECT p_partkey AS k, floor(CAST(p_size * 400 AS DOUBLE) * 300 / 8000 / 50 + 0.5) * 50 AS d FROM part) SELECT k, CAST(greatest(150, least(1200, d)) AS INT) AS dpi FROM r")
add("preview_downsample", "SELECT p_partkey AS k, CAST(CASE WHEN p_size % 4 = 0 THEN 1 ELSE ceil(p_retailprice * 9 / greatest(512, p_size * 40)) END AS INT) AS ds FROM part")
add("scale_bar_place", "SELECT p_partkey AS k, CASE WHEN p_size * 3 > 120 THEN NULL ELSE CAST(floor(0.9 * (120 - p_size * 3)) AS INT) END AS left_px FROM part".replace("0.9", "CAST(0.9 AS DOUBLE)"))
add("pyramid_levels", """
WITH s AS (SELECT p_partkey AS k, CAST(p_size * 400 AS INT) AS side FROM part), l AS (SELECT 1 AS i, 2 AS f UNION ALL SELECT 2, 4 UNION ALL SELECT 3, 8 UNION ALL SELECT 4, 16 UNION ALL SELECT 5, 32)
SELECT k, CAST(CASE WHEN max(CASE WHEN ceil(CAST(side AS DOUBLE) / f) > 900 THEN i ELSE 0 END) = 0 AND max(side) > 1400 THEN 1 ELSE max(CASE WHEN ceil(CAST(side AS DOUBLE) / f) > 900 THEN i ELSE 0 END) END AS INT) AS levels FROM s JOIN l ON 1 = 1 GROUP BY k""")
