"""DuckDB texts of the fixtures and of the operators' twins; the catalog strings them together."""

from __future__ import annotations

MOSAIC = """WITH RECURSIVE px AS (SELECT event_id AS pid, CAST(floor(event_id / 100) AS BIGINT) AS y, event_id % 100 AS x, CAST(floor(value) AS BIGINT) AS v, user_id AS u FROM events),
bk AS (SELECT *, CAST(floor(y / 10) AS BIGINT) * 10 + CAST(floor(x / 10) AS BIGINT) AS blk FROM px),
f1 AS (SELECT CAST(0 AS BIGINT) AS image_id, pid, y, x, (blk * 73 + 41) % 200 + v % 16 AS r, (blk * 151 + 7) % 200 + u % 16 AS g, (blk * 29 + 90) % 200 + (v + u) % 16 AS b FROM bk),
f4 AS (SELECT image_id, pid, y, x, CAST(CASE WHEN r > 100 THEN 255 ELSE 0 END AS BIGINT) AS v FROM f1)
"""

CORPUS = (
    MOSAIC
    + """, hh AS (SELECT max(y) + 1 AS h FROM f1),
f3a AS (SELECT CAST(floor(y * 24 / h) AS BIGINT) AS image_id, pid, y AS gy, x, r, g, b FROM f1, hh),
f3 AS (SELECT image_id, pid, gy - min(gy) OVER (PARTITION BY image_id) AS y, x, r, g, b FROM f3a)
"""
)

POLY = "WITH RECURSIVE pl AS (SELECT CAST(floor(event_id / 1000) AS BIGINT) AS shape_id, event_id % 1000 AS seq, CAST(event_id % 97 AS DOUBLE) / 2 AS px, CAST(user_id AS DOUBLE) / 2 AS py FROM events)\n"

_QUANT = "SELECT image_id, pid, y, x, CAST(floor(r / 16) AS BIGINT) * 16 AS r, CAST(floor(g / 16) AS BIGINT) * 16 AS g, CAST(floor(b / 16) AS BIGINT) * 16 AS b FROM "
_PAL = ", pal AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r, g, b) - 1 AS BIGINT) AS idx, r, g, b FROM (SELECT DISTINCT image_id, r, g, b FROM q3))\n"
PALETTE = f", q3 AS ({_QUANT}f3){_PAL}"
PALETTE_ONE = f", q3 AS ({_QUANT}f1){_PAL}"

_LINEAR = ", ".join(f"CASE WHEN {c} / CAST(255 AS DOUBLE) > 0.04045 THEN power(({c} / CAST(255 AS DOUBLE) + 0.055) / 1.055, 2.4) ELSE {c} / CAST(255 AS DOUBLE) / 12.92 END AS l{c}" for c in "rgb")
_F = ", ".join(f"CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE {c} * 7.787 + CAST(16 AS DOUBLE) / 116 END AS f{c}" for c in ("cx", "cy", "cz"))
LAB = f""", ll AS (SELECT image_id, y, x, {_LINEAR} FROM f3),
xyz AS (SELECT image_id, y, x, (lr * 0.412453 + lg * 0.35758 + lb * 0.180423) / 0.95047 AS cx, lr * 0.212671 + lg * 0.71516 + lb * 0.072169 AS cy, (lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.08883 AS cz FROM ll),
ff AS (SELECT image_id, y, x, {_F} FROM xyz)
SELECT image_id, y, x, round(fcy * 116 - 16, 4) AS l, round((fcx - fcy) * 500, 4) AS a, round((fcy - fcz) * 200, 4) AS bb FROM ff"""


def box(k: int) -> str:
    """`box`(image_id, y, x, hits) of f4: offsets join mirrored places."""
    h = k // 2
    return f""", dim AS (SELECT max(y) AS my, max(x) AS mx FROM f4),
off AS (SELECT dy, dx FROM (SELECT unnest(range(-{h}, {h + 1})) AS dy), (SELECT unnest(range(-{h}, {h + 1})) AS dx)),
plc AS (SELECT f4.y, f4.x, abs(CASE WHEN f4.y + dy > my THEN 2 * my - f4.y - dy ELSE f4.y + dy END) AS ny, abs(CASE WHEN f4.x + dx > mx THEN 2 * mx - f4.x - dx ELSE f4.x + dx END) AS nx FROM f4, off, dim),
box AS (SELECT CAST(0 AS BIGINT) AS image_id, plc.y, plc.x, CAST(count(*) FILTER (n.v > 0) AS BIGINT) AS hits FROM plc JOIN f4 n ON n.y = ny AND n.x = nx GROUP BY plc.y, plc.x)
"""


def near(h: int, source: str = "f4", value: str = "v", name: str = "nb") -> str:
    """A table of the least and largest value within h rows and columns; outside is left out."""
    return f", {name} AS (SELECT a.image_id, a.y, a.x, min(b.{value}) AS lo, max(b.{value}) AS hi FROM {source} a JOIN {source} b ON b.y BETWEEN a.y - {h} AND a.y + {h} AND b.x BETWEEN a.x - {h} AND a.x + {h} GROUP BY a.image_id, a.y, a.x)\n"


def diamond(steps: int) -> str:
    return f", dia AS (SELECT a.image_id, a.y, a.x, bool_or(b.v > 0) AS near_white, bool_or(b.v = 0) AS near_black FROM f4 a JOIN f4 b ON abs(a.y - b.y) + abs(a.x - b.x) <= {steps} AND b.y BETWEEN a.y - {steps} AND a.y + {steps} AND b.x BETWEEN a.x - {steps} AND a.x + {steps} GROUP BY a.image_id, a.y, a.x)\n"


def ellipse(radius: int, source: str = "f4") -> str:
    cond = "abs(a.x - b.x) <= round_even({r} * sqrt(1 - power((a.y - b.y) / CAST({r} AS DOUBLE), 2)), 0)".format(r=radius)
    join = f"b.y BETWEEN a.y - {radius} AND a.y + {radius} AND b.x BETWEEN a.x - {radius} AND a.x + {radius} AND {cond}"
    return f", el1 AS (SELECT a.image_id, a.y, a.x, max(b.v) AS v FROM {source} a JOIN {source} b ON {join} GROUP BY a.image_id, a.y, a.x), el2 AS (SELECT a.image_id, a.y, a.x, min(b.v) AS lo FROM el1 a JOIN el1 b ON {join} GROUP BY a.image_id, a.y, a.x)\n"


LUMA_SPLIT = """, c AS (SELECT *, idx % 3 AS cluster FROM pal), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster),
k AS (SELECT c.*, n.n, ceil(n.n / 20) AS k, row_number() OVER (PARTITION BY c.cluster ORDER BY 299 * r + 587 * g + 114 * b, r, g, b) - 1 AS rn FROM c JOIN n USING (cluster)),
m AS (SELECT *, floor(n / k) AS low, n % k AS extra FROM k)
SELECT image_id, idx, r, g, b, cluster, CAST(CASE WHEN rn < extra * (low + 1) THEN floor(rn / (low + 1)) ELSE extra + floor((rn - extra * (low + 1)) / low) END AS BIGINT) AS part FROM m"""

EPS = """, nod AS (SELECT * FROM pal WHERE r + g + b > 0), ed AS (SELECT a.idx AS a, b.idx AS b FROM nod a JOIN nod b ON (a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b) <= 289),
cc(idx, lab) USING KEY (idx) AS (SELECT idx, idx FROM nod UNION (SELECT ed.b, min(cc.lab) FROM cc JOIN ed ON ed.a = cc.idx JOIN recurring.cc AS o ON o.idx = ed.b WHERE cc.lab < o.lab GROUP BY ed.b))
SELECT pal.image_id, pal.idx, coalesce(cc.lab, CAST(-1 AS BIGINT)) AS cluster FROM pal LEFT JOIN cc USING (idx)"""

BLACK = ", blk3 AS (SELECT image_id, y, x, CASE WHEN pid % 16 = 0 THEN 0 ELSE r END AS r, CASE WHEN pid % 16 = 0 THEN 0 ELSE g END AS g, CASE WHEN pid % 16 = 0 THEN 0 ELSE b END AS b FROM f3)\n"
BLACK_FIX = (
    BLACK
    + """, seg AS (SELECT *, CAST(floor(x / 10) AS BIGINT) AS segment FROM blk3),
dark AS (SELECT image_id, segment, r AS dr, g AS dg, b AS db FROM (SELECT *, row_number() OVER (PARTITION BY image_id, segment ORDER BY r * r + g * g + b * b, y, x) AS k FROM seg WHERE r + g + b > 0) WHERE k = 1)
SELECT image_id, y, x, segment, CASE WHEN r + g + b = 0 THEN coalesce(dr, r) ELSE r END AS r, CASE WHEN r + g + b = 0 THEN coalesce(dg, g) ELSE g END AS g, CASE WHEN r + g + b = 0 THEN coalesce(db, b) ELSE b END AS b FROM seg LEFT JOIN dark USING (image_id, segment)"""
)

OVERLAY = """, rect(comp_ord, y0, y1, x0, x1) AS (VALUES (0, 0, 6, 0, 60), (1, 3, 9, 30, 90), (2, 2, 8, 10, 80)),
bl AS (SELECT image_id, y, x, CASE WHEN pid % 16 = 0 THEN 0 ELSE CAST(floor(r / 16) AS BIGINT) * 16 END AS r, CASE WHEN pid % 16 = 0 THEN 0 ELSE CAST(floor(g / 16) AS BIGINT) * 16 END AS g, CASE WHEN pid % 16 = 0 THEN 0 ELSE CAST(floor(b / 16) AS BIGINT) * 16 END AS b FROM f1),
placed AS (SELECT image_id, CAST(comp_ord AS BIGINT) AS comp_ord, y, x, r + comp_ord AS r, g + comp_ord AS g, b + comp_ord AS b FROM bl, (SELECT max(y) + 1 AS h FROM f1) JOIN rect ON y * 10 >= y0 * h AND y * 10 < y1 * h AND x >= x0 AND x < x1 WHERE r + g + b > 0)
"""

RLE = """, ix AS (SELECT image_id, y, x, CAST(floor(r / 16) AS BIGINT) AS idx FROM f3),
fl AS (SELECT *, CASE WHEN lag(idx) OVER w = idx THEN 0 ELSE 1 END AS f FROM ix WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
rn AS (SELECT *, sum(f) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM fl),
ct AS (SELECT *, floor((row_number() OVER (PARTITION BY image_id, y, run ORDER BY x) - 1) / 4) AS cut FROM rn)
SELECT image_id, y, min(x) AS start, any_value(idx) AS idx, CAST(count(*) AS BIGINT) AS n FROM ct GROUP BY image_id, y, run, cut"""


def _sobel(source: str, value: str, name: str = "sob") -> str:
    return f""", s0 AS (SELECT image_id, y, x, {value} AS v FROM {source}),
s1 AS (SELECT *, coalesce(lag(v) OVER wx, lead(v) OVER wx, v) AS l, coalesce(lead(v) OVER wx, lag(v) OVER wx, v) AS rr FROM s0 WINDOW wx AS (PARTITION BY image_id, y ORDER BY x)),
s2 AS (SELECT *, rr - l AS dd, l + 2 * v + rr AS ss FROM s1),
{name} AS (SELECT image_id, y, x, v, coalesce(lag(dd) OVER wy, lead(dd) OVER wy, dd) + 2 * dd + coalesce(lead(dd) OVER wy, lag(dd) OVER wy, dd) AS gx, coalesce(lead(ss) OVER wy, lag(ss) OVER wy, ss) - coalesce(lag(ss) OVER wy, lead(ss) OVER wy, ss) AS gy FROM s2 WINDOW wy AS (PARTITION BY image_id, x ORDER BY y))
"""


_GRAY = "CAST(floor((r * 4899 + g * 9617 + b * 1868 + 8192) / 16384) AS BIGINT)"
SOBEL = _sobel("f3", _GRAY)
BORDERS = (
    _sobel("f4", "v")
    + """, mg AS (SELECT image_id, y, x, CAST(CASE WHEN sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) > sqrt(CAST(max(gx * gx + gy * gy) OVER () AS DOUBLE)) * 0.25 THEN 255 ELSE 0 END AS BIGINT) AS v FROM sob)
"""
    + near(1, "mg", "v", "m1")
    + near(1, "m1", "hi", "m2")
    + near(2, "m2", "lo", "m3")
    + "SELECT image_id, y, x, CAST(hi AS BIGINT) AS v FROM m3"
)

_REACH = ", ".join(f"coalesce(bool_or(n.v > 0) FILTER (sy = {dy} AND sx = {dx}), false) AS s{i}" for i, (dy, dx) in enumerate(((0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (1, 1), (-1, 1), (1, -1))))
BRIDGE = (
    box(9)
    + f""", st AS (SELECT sy, sx, k FROM (VALUES (0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (1, 1), (-1, 1), (1, -1)) d(sy, sx), (SELECT unnest(range(1, 6)) AS k)),
cand AS (SELECT f4.y, f4.x FROM f4 JOIN box USING (y, x) WHERE v = 0 AND hits / CAST(81 AS DOUBLE) > 0.2),
pt AS (SELECT c.y, c.x, sy, sx, abs(CASE WHEN c.y + sy * k > my THEN 2 * my - c.y - sy * k ELSE c.y + sy * k END) AS ny, abs(CASE WHEN c.x + sx * k > mx THEN 2 * mx - c.x - sx * k ELSE c.x + sx * k END) AS nx FROM cand c, st, dim),
hit AS (SELECT pt.y, pt.x, {_REACH} FROM pt JOIN f4 n ON n.y = ny AND n.x = nx GROUP BY pt.y, pt.x)
SELECT f4.image_id, f4.y, f4.x, CAST(CASE WHEN (s0 AND s1) OR (s2 AND s3) OR (s4 AND s5) OR (s6 AND s7) THEN 255 ELSE f4.v END AS BIGINT) AS v FROM f4 LEFT JOIN hit USING (y, x)"""
)

MOSAIC_CC = MOSAIC + ", fg AS (SELECT pid, image_id, y, x FROM f4 WHERE v > 0)\n"


def components(eight: bool, fg: str = "fg", name: str = "lab", tag: str = "") -> str:
    """`lab`(image_id, y, x, label): the least pid spreads through the neighbours; `tag` keeps several in one text apart."""
    near_ = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1" if eight else "abs(a.x - b.x) + abs(a.y - b.y) <= 1"
    return f""", nbr{tag} AS (SELECT a.pid AS a, b.pid AS b FROM {fg} a JOIN {fg} b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.pid <> b.pid AND {near_}),
cc{tag}(pid, lab) USING KEY (pid) AS (SELECT pid, pid FROM {fg} UNION (SELECT nbr{tag}.b, min(cc{tag}.lab) FROM cc{tag} JOIN nbr{tag} ON nbr{tag}.a = cc{tag}.pid JOIN recurring.cc{tag} AS o ON o.pid = nbr{tag}.b WHERE cc{tag}.lab < o.lab GROUP BY nbr{tag}.b)),
{name} AS (SELECT f.image_id, f.y, f.x, CAST(dense_rank() OVER (ORDER BY cc{tag}.lab) AS BIGINT) AS label FROM {fg} f JOIN cc{tag} USING (pid))
"""




def stats(lab: str = "lab", name: str = "st") -> str:
    return f', {name} AS (SELECT image_id, label, min(y) AS top, min(x) AS "left", max(y) - min(y) + 1 AS height, max(x) - min(x) + 1 AS width, CAST(count(*) AS BIGINT) AS area FROM {lab} GROUP BY image_id, label)\n'


STATS = stats()
_LIMIT = "(SELECT ceil(count(*) * 3 / power(10, ceil(log10(count(*) * 3)) - 3)) FROM f4)"

THINNESS = """, sd(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
pe AS (SELECT l.label, count(*) AS edges FROM lab l, sd WHERE NOT EXISTS (SELECT 1 FROM lab o WHERE o.label = l.label AND o.y = l.y + dy AND o.x = l.x + dx) GROUP BY l.label),
q AS (SELECT st.image_id, st.label, CAST(edges AS BIGINT) AS edges, least(1, 4 * pi() * area / (edges * edges)) AS c, least(height, width) / CAST(greatest(height, width) AS DOUBLE) AS a, area / CAST(height * width AS DOUBLE) AS f FROM st JOIN pe USING (label))
SELECT image_id, label, edges, round(c, 6) AS compactness, round(a, 6) AS aspect, round(f, 6) AS fill, round((c + a + f) / 3, 6) AS thinness FROM q"""

OTSU = f""", hi AS (SELECT image_id, {_GRAY} AS level, count(*) AS n FROM f3 GROUP BY ALL),
cu AS (SELECT image_id, level, CAST(sum(n) OVER w AS BIGINT) AS w0, CAST(sum(n * level) OVER w AS BIGINT) AS s0, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS w, CAST(sum(n * level) OVER (PARTITION BY image_id) AS BIGINT) AS s FROM hi WINDOW w AS (PARTITION BY image_id ORDER BY level)),
sp AS (SELECT image_id, level, round(CASE WHEN w > w0 THEN power(CAST(s0 * w - s * w0 AS DOUBLE), 2) / CAST(w0 * (w - w0) AS DOUBLE) ELSE 0 END, 3) AS spread FROM cu),
ot AS (SELECT image_id, level AS t FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY spread DESC, level) AS k FROM sp) WHERE k = 1)
"""

CANNY = (
    _sobel("f1", _GRAY)
    + """, ma AS (SELECT image_id, y, x, gx, gy, abs(gx) + abs(gy) AS m FROM sob),
dirs AS (SELECT *, CASE WHEN abs(gy) * 1000 < abs(gx) * 414 THEN 0 WHEN abs(gy) * 1000 > abs(gx) * 2414 THEN 1 WHEN gx * gy >= 0 THEN 2 ELSE 3 END AS d FROM ma),
nm AS (SELECT c.image_id, c.y, c.x, CASE WHEN c.m > coalesce(a.m, 0) AND c.m >= coalesce(b.m, 0) THEN c.m ELSE 0 END AS m FROM dirs c
LEFT JOIN ma a ON a.y = c.y + (CASE d WHEN 0 THEN 0 ELSE -1 END) AND a.x = c.x + (CASE d WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 1 END)
LEFT JOIN ma b ON b.y = c.y + (CASE d WHEN 0 THEN 0 ELSE 1 END) AND b.x = c.x + (CASE d WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE -1 END)),
fg AS (SELECT y * 100 + x AS pid, image_id, y, x, m FROM nm WHERE m > 100)
"""
    + components(True)
    + ", ok AS (SELECT DISTINCT label FROM lab JOIN fg USING (y, x) WHERE m > 200) SELECT nm.image_id, nm.y, nm.x, CAST(CASE WHEN ok.label IS NOT NULL THEN 255 ELSE 0 END AS BIGINT) AS v FROM nm LEFT JOIN lab ON lab.y = nm.y AND lab.x = nm.x LEFT JOIN ok ON ok.label = lab.label"
)

_PAIR = ", pr AS (SELECT *, CAST(floor(r / 16) AS BIGINT) * 16 + 8 AS dr, CAST(floor(g / 16) AS BIGINT) * 16 + 8 AS dg, CAST(floor(b / 16) AS BIGINT) * 16 + 8 AS db FROM f3)\n"
_SE = "((r - dr) * (r - dr) + (g - dg) * (g - dg) + (b - db) * (b - db))"
_SA = "(abs(r - dr) + abs(g - dg) + abs(b - db))"
_E = "greatest(abs(r - dr), abs(g - dg), abs(b - db))"
METRICS = (
    _PAIR
    + f""", m0 AS (SELECT image_id, CAST(count(*) AS BIGINT) AS pixels, sum({_SE}) / CAST(count(*) * 3 AS DOUBLE) AS mse, sum((r - dr) * (r - dr)) / CAST(count(*) AS DOUBLE) AS mse_r, sum((g - dg) * (g - dg)) / CAST(count(*) AS DOUBLE) AS mse_g, sum((b - db) * (b - db)) / CAST(count(*) AS DOUBLE) AS mse_b, sum({_SA}) / CAST(count(*) * 3 AS DOUBLE) AS mae, max({_E}) AS max_error FROM pr GROUP BY image_id),
m1 AS (SELECT *, CASE WHEN mse = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 10 * log10(65025 / mse) END AS psnr FROM m0),
met AS (SELECT *, CASE WHEN psnr > 40 THEN 'excellent' WHEN psnr > 30 THEN 'good' WHEN psnr > 20 THEN 'acceptable' ELSE 'poor' END AS rating, CASE WHEN psnr > 40 THEN 'excellent' WHEN psnr > 35 THEN 'very good' WHEN psnr > 30 THEN 'good' WHEN psnr > 25 THEN 'acceptable' ELSE 'poor' END AS rating_five FROM m1)
"""
)
SUMMARY = ", lg AS (SELECT 'psnr' AS metric, psnr AS v FROM met UNION ALL SELECT 'mse', mse FROM met UNION ALL SELECT 'mae', mae FROM met) SELECT metric, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM lg GROUP BY metric"

_RULES = {"iqr": "e > t_iqr", "zscore": "std_e > 0 AND abs((e - mean_e) / std_e) > 3", "percentile": "e > p99", "adaptive": "e > t_adaptive"}
ADAPTIVE = (
    _PAIR
    + f""", er AS (SELECT image_id, {_E} AS e, {_SE} AS se FROM pr),
s0 AS (SELECT image_id, CAST(count(*) AS BIGINT) AS pixels, min(e) AS min_e, max(e) AS max_e, avg(e) AS mean_e, stddev_pop(e) AS std_e, quantile_cont(e, 0.25) AS p25, quantile_cont(e, 0.5) AS median_e, quantile_cont(e, 0.75) AS p75, quantile_cont(e, 0.9) AS p90, quantile_cont(e, 0.95) AS p95, quantile_cont(e, 0.99) AS p99 FROM er GROUP BY image_id),
s1 AS (SELECT *, p75 + (p75 - p25) * 2.5 AS t_iqr, CASE WHEN mean_e > median_e * 1.5 THEN median_e + std_e * 3 ELSE mean_e + std_e * 2.5 END AS t_adaptive FROM s0),
ct AS (SELECT image_id, sum(se) AS s_all, {", ".join(f"CAST(count(*) FILTER ({c}) AS BIGINT) AS n_{k}, coalesce(sum(se) FILTER ({c}), 0) AS s_{k}" for k, c in _RULES.items())} FROM er JOIN s1 USING (image_id) GROUP BY image_id),
ru AS (SELECT *, CASE WHEN n_iqr * 100 / pixels BETWEEN 0.1 AND 10 THEN 'iqr' WHEN n_zscore * 100 / pixels BETWEEN 0.1 AND 10 THEN 'zscore' WHEN n_percentile * 100 / pixels BETWEEN 0.1 AND 10 THEN 'percentile' ELSE 'adaptive' END AS rule FROM s1 JOIN ct USING (image_id)),
ou AS (SELECT *, CASE rule WHEN 'iqr' THEN n_iqr WHEN 'zscore' THEN n_zscore WHEN 'percentile' THEN n_percentile ELSE n_adaptive END AS outliers, CASE rule WHEN 'iqr' THEN s_iqr WHEN 'zscore' THEN s_zscore WHEN 'percentile' THEN s_percentile ELSE s_adaptive END AS ose FROM ru)
SELECT image_id, pixels, min_e, max_e, round(mean_e, 5) AS mean_e, round(std_e, 5) AS std_e, round(p25, 5) AS p25, round(median_e, 5) AS median_e, round(p75, 5) AS p75, round(p90, 5) AS p90, round(p95, 5) AS p95, round(p99, 5) AS p99, round(t_iqr, 5) AS t_iqr, round(t_adaptive, 5) AS t_adaptive, n_iqr, n_zscore, n_percentile, n_adaptive, rule, outliers,
round(CASE WHEN s_all = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 10 * log10(65025 / (s_all / CAST(pixels * 3 AS DOUBLE))) END, 5) AS psnr_all, round(CASE WHEN s_all = ose THEN CAST('Infinity' AS DOUBLE) ELSE 10 * log10(65025 / ((s_all - ose) / CAST((pixels - outliers) * 3 AS DOUBLE))) END, 5) AS psnr_clean FROM ou"""
)

SCOPES = (
    _PAIR
    + f""", er AS (SELECT image_id, {_E} AS e, {_SE} AS se FROM pr),
li AS (SELECT image_id, 'percentile_99' AS scope, quantile_cont(e, 0.99) AS t FROM er GROUP BY image_id UNION ALL SELECT image_id, 'percentile_95', quantile_cont(e, 0.95) FROM er GROUP BY image_id UNION ALL SELECT image_id, 'percentile_90', quantile_cont(e, 0.9) FROM er GROUP BY image_id UNION ALL SELECT image_id, 'percentile_75', quantile_cont(e, 0.75) FROM er GROUP BY image_id UNION ALL SELECT DISTINCT image_id, 'all', CAST(1000000000 AS DOUBLE) FROM er),
ms AS (SELECT image_id, scope, CAST(count(*) AS BIGINT) AS pixels, sum(se) / CAST(count(*) * 3 AS DOUBLE) AS mse FROM er JOIN li USING (image_id) WHERE e <= t GROUP BY image_id, scope)
SELECT image_id, scope, pixels, round(mse, 6) AS mse, round(CASE WHEN mse = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 10 * log10(65025 / mse) END, 6) AS psnr FROM ms"""
)

HISTOGRAM = (
    _PAIR
    + f""", er AS (SELECT image_id, {_E} AS e FROM pr), en AS (SELECT image_id, min(e) AS lo, max(e) AS hi FROM er GROUP BY image_id)
SELECT image_id, CAST(CASE WHEN hi > lo THEN least(49, floor((e - lo) * 50 / (hi - lo))) ELSE 0 END AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM er JOIN en USING (image_id) GROUP BY ALL"""
)

DIFF = (
    _PAIR
    + f""", df AS (SELECT image_id, y, x, {_SA} AS a, {_SE} AS s, abs(r - dr) * 299 + abs(g - dg) * 587 + abs(b - db) * 114 AS w FROM pr),
tp AS (SELECT image_id, max(a) AS ma, max(s) AS ms, max(w) AS mw FROM df GROUP BY image_id)
SELECT image_id, y, x, round(coalesce(a / CAST(nullif(ma, 0) AS DOUBLE), 0), 6) AS absolute, round(coalesce(s / CAST(nullif(ms, 0) AS DOUBLE), 0), 6) AS squared, round(coalesce(w / CAST(nullif(mw, 0) AS DOUBLE), 0), 6) AS weighted FROM df JOIN tp USING (image_id)"""
)


def _ssim() -> str:
    sums = ", ".join(f"CAST(sum(b.{c}) AS DOUBLE) AS {c}_x, CAST(sum(b.d{c}) AS DOUBLE) AS {c}_y, CAST(sum(b.{c} * b.{c}) AS DOUBLE) AS {c}_xx, CAST(sum(b.d{c} * b.d{c}) AS DOUBLE) AS {c}_yy, CAST(sum(b.{c} * b.d{c}) AS DOUBLE) AS {c}_xy" for c in "rgb")
    one = " + ".join(f"((2 * {c}_x / 49 * {c}_y / 49 + 6.5025) * (2 * ({c}_xy * 49 - {c}_x * {c}_y) / 2352 + 58.5225)) / (({c}_x / 49 * {c}_x / 49 + {c}_y / 49 * {c}_y / 49 + 6.5025) * (({c}_xx * 49 - {c}_x * {c}_x) / 2352 + ({c}_yy * 49 - {c}_y * {c}_y) / 2352 + 58.5225))" for c in "rgb")
    return f""", pr AS (SELECT *, CAST(floor(r / 16) AS BIGINT) * 16 + 8 AS dr, CAST(floor(g / 16) AS BIGINT) * 16 + 8 AS dg, CAST(floor(b / 16) AS BIGINT) * 16 + 8 AS db FROM f1),
wi AS (SELECT a.y, a.x, count(*) AS n, {sums} FROM pr a JOIN pr b ON b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3 GROUP BY a.y, a.x HAVING count(*) = 49)
SELECT CAST(0 AS BIGINT) AS image_id, round(avg(({one}) / 3), 6) AS ssim FROM wi"""


SSIM = _ssim()

LBP = (
    f""", s0 AS (SELECT image_id, y, x, {_GRAY} AS v FROM f3),
s1 AS (SELECT *, coalesce(lag(v) OVER wx, lead(v) OVER wx, v) AS l, coalesce(lead(v) OVER wx, lag(v) OVER wx, v) AS rr FROM s0 WINDOW wx AS (PARTITION BY image_id, y ORDER BY x)),
s2 AS (SELECT *, """
    + ", ".join(f"coalesce(lag({c}) OVER wy, lead({c}) OVER wy, {c}) AS u{c}, coalesce(lead({c}) OVER wy, lag({c}) OVER wy, {c}) AS d{c}" for c in ("v", "l", "rr"))
    + """ FROM s1 WINDOW wy AS (PARTITION BY image_id, x ORDER BY y))
SELECT image_id, CAST("""
    + " + ".join(f"({c} >= v)::INT" for c in ("l", "rr", "uv", "ul", "urr", "dv", "dl", "drr"))
    + " AS BIGINT) AS bits, CAST(count(*) AS BIGINT) AS n FROM s2 GROUP BY ALL"
)

ARC = ", st AS (SELECT *, coalesce(sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)), 0) AS step FROM pl WINDOW w AS (PARTITION BY shape_id ORDER BY seq)), arc AS (SELECT *, sum(step) OVER (PARTITION BY shape_id ORDER BY seq) AS arc FROM st)\n"

DIVIDE = """, ring AS (SELECT shape_id, seq, px, py FROM pl UNION ALL SELECT shape_id, m + 1, px, py FROM (SELECT shape_id, max(seq) AS m, arg_min(px, seq) AS px, arg_min(py, seq) AS py FROM pl GROUP BY shape_id)),
st AS (SELECT *, coalesce(sqrt(power(px - lag(px) OVER w, 2) + power(py - lag(py) OVER w, 2)), 0) AS step FROM ring WINDOW w AS (PARTITION BY shape_id ORDER BY seq)),
ar AS (SELECT *, sum(step) OVER (PARTITION BY shape_id ORDER BY seq) AS arc FROM st),
tt AS (SELECT shape_id, max(arc) AS total, max(seq) AS last FROM ar GROUP BY shape_id),
ca AS (SELECT shape_id, i, last, seq, row_number() OVER (PARTITION BY shape_id, i ORDER BY round(abs(arc - total * i / 10), 9), seq) AS k FROM ar JOIN tt USING (shape_id), (SELECT unnest(range(0, 11)) AS i)),
cu AS (SELECT shape_id, i, last, seq AS cut, lead(seq) OVER (PARTITION BY shape_id ORDER BY i) AS nxt FROM ca WHERE k = 1)
SELECT shape_id, CAST(i AS BIGINT) AS part, ring.seq, px, py FROM cu JOIN ring USING (shape_id) WHERE nxt IS NOT NULL AND ring.seq >= greatest(0, cut - 2) AND ring.seq <= least(last, nxt + 2)"""

CURVE = """, v AS (SELECT *, px - lag(px) OVER w AS ax, py - lag(py) OVER w AS ay, lead(px) OVER w - px AS bx, lead(py) OVER w - py AS byy FROM pl WINDOW w AS (PARTITION BY shape_id ORDER BY seq)),
an AS (SELECT *, round(coalesce(acos(greatest(-1, least(1, (ax * bx + ay * byy) / nullif(sqrt((ax * ax + ay * ay) * (bx * bx + byy * byy)), 0)))), 0), 9) AS angle FROM v),
ra AS (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY (seq = lo OR seq = hi) DESC, angle DESC, seq) AS k FROM (SELECT *, min(seq) OVER (PARTITION BY shape_id) AS lo, max(seq) OVER (PARTITION BY shape_id) AS hi FROM an))
SELECT shape_id, seq, px, py FROM ra WHERE k <= 20"""

DEDUPE = """, dd AS (SELECT shape_id, seq, floor(px / 8) AS px, CAST(1 AS DOUBLE) AS py FROM pl)
SELECT shape_id, seq, px, py FROM (SELECT *, lag(px) OVER (PARTITION BY shape_id ORDER BY seq) AS q FROM dd) WHERE q IS NULL OR q <> px"""

#: White components of 20 pixels or more, as a map `big`.
BIG = ", big AS (SELECT f4.image_id, f4.y, f4.x, CAST(CASE WHEN st.area >= 20 THEN 255 ELSE 0 END AS BIGINT) AS v FROM f4 LEFT JOIN lab ON lab.y = f4.y AND lab.x = f4.x LEFT JOIN st ON st.label = lab.label)\n"

_AROUND = " + ".join(f"(coalesce(max(v) OVER ({w} ROWS BETWEEN {a} AND {b}), 0) > 0)::INT" for w in ("wx", "wy") for a, b in (("5 PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", "5 FOLLOWING")))
GAP_DENSE = (
    box(5)
    + _sobel("f4", "v")
    + ", mg AS (SELECT image_id, y, x, gx * gx + gy * gy AS v FROM sob)"
    + near(1, "mg", "v", "m1")
    + f""", sides AS (SELECT y, x, v, {_AROUND} AS n FROM f4 WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y))
SELECT m1.image_id, y, x, CAST(CASE WHEN v = 0 AND box.hits >= 10 AND n >= 3 AND hi <= 10000 THEN 255 ELSE v END AS BIGINT) AS v FROM sides JOIN box USING (y, x) JOIN m1 USING (y, x)"""
)

_SIDE = {"l": "lag({c}) OVER wx, lead({c}) OVER wx", "w": "lead({c}) OVER wx, lag({c}) OVER wx", "u": "lag({c}) OVER wy, lead({c}) OVER wy", "e": "lead({c}) OVER wy, lag({c}) OVER wy"}
_WEIGHT = "exp(-power(CAST(abs({s}r - r) + abs({s}g - g) + abs({s}b - b) AS DOUBLE), 2) / 200 - 1 / CAST(200 AS DOUBLE))"
BILATERAL = (
    ", sd AS (SELECT *, "
    + ", ".join(f"coalesce({text.format(c=c)}, {c}) AS {s}{c}" for s, text in _SIDE.items() for c in "rgb")
    + " FROM f3 WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)), we AS (SELECT *, "
    + ", ".join(f"{_WEIGHT.format(s=s)} AS w{s}" for s in _SIDE)
    + " FROM sd) SELECT image_id, y, x, "
    + ", ".join(f"CAST(floor(round(({c} + " + " + ".join(f"w{s} * {s}{c}" for s in _SIDE) + f") / (1 + {' + '.join(f'w{s}' for s in _SIDE)}), 6)) AS BIGINT) AS {c}" for c in "rgb")
    + " FROM we"
)

THIN_WEIGHTED = THINNESS.rsplit("\nSELECT", 1)[0] + """
SELECT q.image_id, q.label, round(greatest(0, least(1, CAST((1 - a) * 0.3 + (1 - f) * 0.25 + (1 - c) * 0.25 + CASE WHEN least(height, width) <= 1 THEN 0.2 ELSE 0 END AS DOUBLE))), 6) AS thin_score FROM q JOIN st USING (label)"""

NOISE = (
    components(True)
    + box(5)
    + """, dirt AS (SELECT label FROM lab JOIN box USING (y, x) GROUP BY label HAVING count(*) < 75 AND sum(hits) < count(*) * 10),
once AS (SELECT f4.image_id, f4.pid, f4.y, f4.x, CASE WHEN dirt.label IS NOT NULL THEN 0 ELSE f4.v END AS v FROM f4 LEFT JOIN lab USING (y, x) LEFT JOIN dirt ON dirt.label = lab.label),
fgb AS (SELECT pid, image_id, y, x FROM once WHERE v = 0)
"""
    + components(True, "fgb", "labb", "b")
    + """, spots AS (SELECT label FROM labb JOIN box USING (y, x) GROUP BY label HAVING count(*) < 75 AND sum(hits) < count(*) * 10)
SELECT once.image_id, once.y, once.x, CAST(CASE WHEN spots.label IS NOT NULL THEN 255 ELSE once.v END AS BIGINT) AS v FROM once LEFT JOIN labb USING (y, x) LEFT JOIN spots ON spots.label = labb.label"""
)

REGION_LIST = (
    diamond(3)
    + ", fga AS (SELECT y * 100 + x AS pid, image_id, y, x FROM dia WHERE near_white), fgb AS (SELECT y * 100 + x AS pid, image_id, y, x FROM dia WHERE near_black)"
    + components(True, "fga", "laba", "a")
    + components(True, "fgb", "labb", "b")
    + stats("laba", "sta")
    + stats("labb", "stb")
    + f"""SELECT image_id, CASE WHEN area < {_LIMIT} THEN 'nonroi' ELSE 'roi' END AS kind, label, top, "left", height, width, area FROM sta UNION ALL SELECT image_id, 'nonroi', label, top, "left", height, width, area FROM stb"""
)

REGION_SWAP = (
    ", fga AS (SELECT pid, image_id, y, x FROM f4 WHERE v > 0), fgb AS (SELECT pid, image_id, y, x FROM f4 WHERE v <= 0)"
    + components(True, "fga", "laba", "a")
    + components(True, "fgb", "labb", "b")
    + stats("laba", "sta")
    + stats("labb", "stb")
    + f""", moved AS (SELECT l.image_id, l.y, l.x, area >= {_LIMIT} AS roi FROM laba l JOIN sta USING (label) UNION ALL SELECT l.image_id, l.y, l.x, area < {_LIMIT} FROM labb l JOIN stb USING (label)),
fgc AS (SELECT y * 100 + x AS pid, image_id, y, x FROM moved WHERE roi), fgd AS (SELECT y * 100 + x AS pid, image_id, y, x FROM moved WHERE NOT roi)
"""
    + components(True, "fgc", "labc", "c")
    + components(True, "fgd", "labd", "d")
    + "SELECT image_id, 'roi' AS kind, label, y, x FROM labc UNION ALL SELECT image_id, 'nonroi', label, y, x FROM labd"
)

CONTEXT = (
    near(1)
    + near(1, "nb", "lo", "nb2")
    + ", fg AS (SELECT y * 100 + x AS pid, image_id, y, x FROM nb2 WHERE hi > 0)"
    + components(True)
    + STATS
    + """, up AS (SELECT st.label, p.area AS parent FROM st JOIN lab ON lab.y = st.top + CAST(floor(st.height / 2) AS BIGINT) AND lab.x = st.left + CAST(floor(st.width / 2) AS BIGINT) JOIN st p ON p.label = lab.label WHERE lab.label <> st.label),
keep AS (SELECT st.label FROM st LEFT JOIN up USING (label) WHERE area >= 10 AND (parent IS NULL OR area >= parent * 0.1))
SELECT f4.image_id, f4.y, f4.x, CAST(CASE WHEN keep.label IS NOT NULL THEN 255 ELSE 0 END AS BIGINT) AS v FROM f4 LEFT JOIN lab USING (y, x) LEFT JOIN keep ON keep.label = lab.label"""
)

THR_FAST = SOBEL + """, gm AS (SELECT image_id, abs(gx) + abs(gy) AS m FROM sob WHERE abs(gx) + abs(gy) > 0),
gr AS (SELECT image_id, m, row_number() OVER (PARTITION BY image_id ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM gm),
gq AS (SELECT image_id, CAST(CASE WHEN max(n) > 100 THEN max(m) FILTER (i = floor(n * CAST(0.1 AS DOUBLE))) ELSE 50 END AS DOUBLE) AS c, CAST(CASE WHEN max(n) > 100 THEN max(m) FILTER (i = floor(n * CAST(0.9 AS DOUBLE))) ELSE 150 END AS DOUBLE) AS d FROM gr GROUP BY image_id),
gp AS (SELECT image_id, quantile_cont(CAST(v AS DOUBLE), 0.25) * CAST(0.7 AS DOUBLE) AS a, quantile_cont(CAST(v AS DOUBLE), 0.75) * CAST(1.3 AS DOUBLE) AS b FROM sob GROUP BY image_id)
SELECT image_id, round((a + c) / 2, 6) AS low, round((b + d) / 2, 6) AS high FROM gp JOIN gq USING (image_id)"""

BLOCK_BORDERS = """, sg AS (SELECT image_id, y, x, CAST(floor(y / 7) * 100 + floor(x / 9) AS BIGINT) AS segment FROM f3), sd(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
bp AS (SELECT DISTINCT s.image_id, s.segment, s.y, s.x FROM sg s, sd WHERE NOT EXISTS (SELECT 1 FROM sg o WHERE o.image_id = s.image_id AND o.segment = s.segment AND o.y = s.y + dy AND o.x = s.x + dx)),
bn AS (SELECT image_id, segment, count(*) AS n FROM bp GROUP BY image_id, segment),
bs AS (SELECT image_id, segment, CAST(count(*) AS BIGINT) AS area, min(y) = max(y) OR min(x) = max(x) AS flat FROM sg GROUP BY image_id, segment)
SELECT image_id, segment, area, CAST(CASE WHEN flat THEN 4 ELSE n END AS BIGINT) AS num_points FROM bs JOIN bn USING (image_id, segment)"""

_CHANNELS = ", ".join(f"coalesce(lag(d{c}) OVER wy, lead(d{c}) OVER wy, d{c}) + 2 * d{c} + coalesce(lead(d{c}) OVER wy, lag(d{c}) OVER wy, d{c}) AS x{c}, coalesce(lead(s{c}) OVER wy, lag(s{c}) OVER wy, s{c}) - coalesce(lag(s{c}) OVER wy, lead(s{c}) OVER wy, s{c}) AS y{c}" for c in "rgb")
_LINES = ", ".join(f"coalesce(lead({c}) OVER wx, lag({c}) OVER wx, {c}) - coalesce(lag({c}) OVER wx, lead({c}) OVER wx, {c}) AS d{c}, coalesce(lag({c}) OVER wx, lead({c}) OVER wx, {c}) + 2 * {c} + coalesce(lead({c}) OVER wx, lag({c}) OVER wx, {c}) AS s{c}" for c in "rgb")
_STRONGEST = "CASE WHEN abs(xr) + abs(yr) >= abs(xg) + abs(yg) AND abs(xr) + abs(yr) >= abs(xb) + abs(yb) THEN {k}r WHEN abs(xg) + abs(yg) >= abs(xb) + abs(yb) THEN {k}g ELSE {k}b END"
CANNY_RGB = f""", c1 AS (SELECT image_id, y, x, {_LINES} FROM f1 WINDOW wx AS (PARTITION BY image_id, y ORDER BY x)),
c2 AS (SELECT image_id, y, x, {_CHANNELS} FROM c1 WINDOW wy AS (PARTITION BY image_id, x ORDER BY y)),
sob AS (SELECT image_id, y, x, {_STRONGEST.format(k="x")} AS gx, {_STRONGEST.format(k="y")} AS gy FROM c2)
""" + CANNY.removeprefix(_sobel("f1", _GRAY))

DENSE_EDGES = box(3) + """, lv AS (SELECT avg(hits / CAST(9 AS DOUBLE)) * 1.7 AS level FROM box JOIN f4 USING (y, x) WHERE v > 0)
SELECT f4.image_id, y, x, CAST(CASE WHEN v > 0 AND hits / CAST(9 AS DOUBLE) > level THEN 255 ELSE 0 END AS BIGINT) AS v FROM f4 JOIN box USING (y, x), lv"""

#: Coarse pixels, black where pid has few bits left; black components of up to 4 pixels filled.
HOLES = """, hp AS (SELECT image_id, pid, y, x, CASE WHEN pid % 7 < 2 THEN 0 ELSE CAST(floor(r / 64) AS BIGINT) * 64 END AS r, CASE WHEN pid % 7 < 2 THEN 0 ELSE CAST(floor(g / 64) AS BIGINT) * 64 END AS g, CASE WHEN pid % 7 < 2 THEN 0 ELSE CAST(floor(b / 64) AS BIGINT) * 64 END AS b FROM f1),
fg AS (SELECT pid, image_id, y, x FROM hp WHERE r + g + b = 0)
""" + components(False) + STATS + """, hd(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
hn AS (SELECT DISTINCT l.label, l.y + dy AS y, l.x + dx AS x FROM lab l JOIN st USING (label), hd WHERE area <= 4),
hc AS (SELECT hn.label, r, g, b, count(*) AS n, min(hp.pid) AS first FROM hn JOIN hp USING (y, x) WHERE r + g + b > 0 GROUP BY ALL),
hf AS (SELECT label, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, first) AS k FROM hc) WHERE k = 1)
SELECT hp.image_id, hp.y, hp.x, coalesce(hf.r, hp.r) AS r, coalesce(hf.g, hp.g) AS g, coalesce(hf.b, hp.b) AS b FROM hp LEFT JOIN lab USING (y, x) LEFT JOIN hf ON hf.label = lab.label"""

THIN_BOX = """SELECT image_id, label, round(CASE WHEN area <= 4 THEN CASE WHEN least(height, width) = 1 THEN 0 ELSE 0.5 END WHEN least(height, width) = 1 THEN (CASE WHEN width > 1 THEN 1 / CAST(width AS DOUBLE) ELSE 0 END + CASE WHEN height > 1 THEN 1 / CAST(height AS DOUBLE) ELSE 0 END) / 2
ELSE greatest(0, least(1, CAST(0.7 AS DOUBLE) * least(height, width) / greatest(height, width) + CAST(0.3 AS DOUBLE) * 4 * sqrt(area) / (2 * (height + width)))) END, 6) AS thin_box FROM st"""

THIN_FAST = """, fa AS (SELECT *, least(height, width) / CAST(greatest(height, width) AS DOUBLE) AS a, area / CAST(height * width AS DOUBLE) AS f, CAST(greatest(height, width) AS DOUBLE) AS long FROM st),
fb AS (SELECT *, (height + width) + 2 * sqrt(pi() * area) * (1 - a) / 4 + 2 * long * a / 4 AS p FROM fa)
SELECT image_id, label, round(greatest(0, least(1, CAST(a * 0.3 + f * 0.25 + greatest(0, least(1, 4 * pi() * area / (p * p))) * 0.25 + sqrt(f) * 0.15 + (1 - least(1, long / area / 10)) * 0.05 AS DOUBLE))), 6) AS thin_fast FROM fb"""

_LAB8 = ", ".join(f"CAST(greatest(0, least(255, floor({e} + 0.5))) AS BIGINT) AS {n}" for e, n in (("(fcy * 116 - 16) * 2.55", "l"), ("(fcx - fcy) * 500 + 128", "a"), ("(fcy - fcz) * 200 + 128", "bb")))
LAB8 = LAB.rsplit("\nSELECT", 1)[0] + f"\nSELECT image_id, y, x, {_LAB8} FROM ff"
