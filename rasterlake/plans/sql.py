"""DuckDB SQL of the registered queries, written against the same tables."""

from __future__ import annotations

import math

E = """e AS (SELECT vec_id AS image_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5) AS INT) AS v
FROM embeddings, range(len(embedding)) r(i) WHERE embedding[i + 1] IS NOT NULL)"""
SH = "sh AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM e GROUP BY image_id)"
K = "ink AS (SELECT image_id, y, x FROM e WHERE v > 135)"
#: Labels by reachability within each image: pixels of at most 64 cells.
LAB = """p AS (SELECT image_id, y, x, y * 65536 + x AS id FROM ink),
reach(image_id, id, y, x) AS (SELECT image_id, id, y, x FROM p UNION SELECT r.image_id, r.id, p.y, p.x FROM reach r JOIN p ON p.image_id = r.image_id AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1),
lab AS (SELECT image_id, y, x, min(id) AS label FROM reach GROUP BY image_id, y, x),
comp AS (SELECT image_id, CAST(label AS BIGINT) AS label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM lab GROUP BY image_id, label)"""
C = f"WITH RECURSIVE {E}, {SH}, {K}, {LAB} "
T = """t AS (SELECT doc_id AS image_id, CAST(i // 64 AS INT) AS y, CAST(i % 64 AS INT) AS x FROM (SELECT doc_id, text, unnest(range(length(text))) AS i FROM documents) WHERE ascii(substr(text, i + 1, 1)) > 32)"""
ROW, COL = "(PARTITION BY image_id, y ORDER BY x)", "(PARTITION BY image_id, x ORDER BY y)"


def reflect(v: str, w: str, k: int) -> str:
    if k == 0:
        return v
    there, back = (f"lead({v},{k}) OVER {w}", f"lag({v},{k}) OVER {w}") if k > 0 else (f"lag({v},{-k}) OVER {w}", f"lead({v},{-k}) OVER {w}")
    if abs(k) == 1:
        return f"coalesce({there}, {back}, {v})"
    one = f"lead({v}) OVER {w}" if k > 0 else f"lag({v}) OVER {w}"
    return f"coalesce({there}, CASE WHEN {one} IS NOT NULL THEN {v} ELSE {back} END, {v})"


def replicate(v: str, w: str, k: int) -> str:
    if k == 0:
        return v
    full = w[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"coalesce(lead({v},{k}) OVER {w}, last_value({v}) OVER {full})" if k > 0 else f"coalesce(lag({v},{-k}) OVER {w}, first_value({v}) OVER {full})"


def two_pass(kx: list[float], ky: list[float], rule=reflect, src: str = "e") -> str:
    r = len(kx) // 2
    a = " + ".join(f"{k!r}::DOUBLE * {rule('v', ROW, i - r)}" for i, k in enumerate(kx) if k)
    b = " + ".join(f"{k!r}::DOUBLE * {rule('s', COL, i - r)}" for i, k in enumerate(ky) if k)
    return f"(SELECT image_id, y, x, v AS v0, {b} AS v FROM (SELECT *, {a} AS s FROM {src}))"


B3, B5 = [0.25, 0.5, 0.25], [0.0625, 0.25, 0.375, 0.25, 0.0625]
POL = f"b AS {two_pass(B3, B3)}, pol AS (SELECT image_id, (quantile_cont(v,0.5) - quantile_cont(v,0.005)) > (quantile_cont(v,0.995) - quantile_cont(v,0.5)) AS dark FROM b GROUP BY image_id)"


def median5() -> str:
    row = ", ".join(replicate("v", ROW, k) for k in range(-2, 3))
    col = ", ".join(replicate("a", COL, k) for k in range(-2, 3))
    return f"m AS (SELECT image_id, y, x, list_sort(flatten([{col}]))[13] AS v FROM (SELECT *, [{row}] AS a FROM e))"


def morph(src: str, f: str, lo: str, hi: str) -> str:
    fr = f"ROWS BETWEEN {lo} AND {hi})"
    return f"(SELECT image_id, y, x, {f}(s) OVER {COL[:-1]} {fr} AS v FROM (SELECT *, {f}(v) OVER {ROW[:-1]} {fr} AS s FROM {src}))"


def ellipse(src: str, f: str, half: dict[int, int]) -> str:
    cond = " OR ".join(f"(q.y - p.y = {dy} AND abs(q.x - p.x) <= {hw})" for dy, hw in half.items())
    return f"(SELECT p.image_id, p.y, p.x, {f}(q.v) AS v FROM {src} p JOIN {src} q ON p.image_id = q.image_id AND ({cond}) GROUP BY ALL)"


G5 = [math.exp(-((i - 2) ** 2) / (2 * 1.1**2)) for i in range(5)]
G5 = [g / sum(G5) for g in G5]
BOX = "struct_pack(x := {x}, y := {y}, w := {w}, h := {h}, labels := {labels})"
NEW = BOX.format(x="c.x", y="c.y", w="c.w", h="c.h", labels="[c.label]")


def grown(g: str) -> str:
    """Group ``g`` with component ``c``."""
    side = lambda a, s: f"greatest({g}.{a} + {g}.{s}, c.{a} + c.{s}) - least({g}.{a}, c.{a})"
    return BOX.format(x=f"least({g}.x, c.x)", y=f"least({g}.y, c.y)", w=side("x", "w"), h=side("y", "h"), labels=f"list_append({g}.labels, c.label)")


def over(g: str) -> str:
    return f"least({g}.x + {g}.w, c.x + c.w) - greatest({g}.x, c.x) >= 0.5 * least({g}.w, c.w)"


def folded(rule: str) -> str:
    """Components of each image in order, folded into boxes by ``rule(gs, c)``."""
    return f""", o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x, label, y, w, h) AS i, count(*) OVER (PARTITION BY image_id) AS n FROM comp),
f(image_id, i, gs) AS (SELECT image_id, i, [{NEW}] FROM o c WHERE i = 1 UNION ALL SELECT f.image_id, c.i, {rule} FROM f JOIN o c ON c.image_id = f.image_id AND c.i = f.i + 1)
SELECT image_id, g.x AS x, g.y AS y, g.w AS w, g.h AS h, array_to_string(g.labels, ',') AS labels FROM (SELECT image_id, unnest(gs) AS g FROM f JOIN (SELECT DISTINCT image_id, n FROM o) USING (image_id) WHERE i = n)"""


FITS = f"list_position(list_transform(gs, lambda g: {over('g')} AND greatest(g.y, c.y) - least(g.y + g.h, c.y + c.h) < 0.5 * greatest(g.h, c.h)), true)"
H5 = {-2: 0, -1: 2, 0: 2, 1: 2, 2: 0}
CLOSE = f"c1 AS {ellipse('e', 'max', H5)}, cl AS {ellipse('c1', 'min', H5)}"
FRAMES = "f AS (SELECT user_id AS camera_id, event_id AS seq, ts, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN '' ELSE event_type END AS text, value FROM events)"
FO = "PARTITION BY camera_id ORDER BY ts, seq"
SMP = """s AS (SELECT d.doc_id AS sample_id, source, quality AS label, ln(n + 1) AS f1, CASE WHEN words >= 2 THEN n / words END AS f2, CASE WHEN lines >= 2 THEN ln(n / lines) END AS f3,
length(translate(text, '.,', '')) / (n + 1) AS f4 FROM (SELECT *, CAST(length(text) AS DOUBLE) AS n, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) AS words, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS lines FROM documents) d JOIN labels l ON d.doc_id = l.doc_id WHERE text IS NOT NULL AND quality IS NOT NULL)"""
SC = """sc AS (SELECT sample_id, source, label, 1 / (1 + exp(-greatest(-60, least(60, 0.3 + (coalesce(f1,7.0)-7.0)/1.0*0.4 + (coalesce(f2,6.0)-6.0)/1.5*-0.3 + (coalesce(f3,5.0)-5.0)/1.2*0.2 + (coalesce(f4,0.9)-0.9)/0.1*0.5)))) AS prob, concat_ws(',', CASE WHEN f1 IS NULL THEN 'f1' END, CASE WHEN f2 IS NULL THEN 'f2' END, CASE WHEN f3 IS NULL THEN 'f3' END, CASE WHEN f4 IS NULL THEN 'f4' END) AS imputed FROM s)"""
CLS = """x AS (SELECT vec_id AS item_id, label, i AS p, CAST(embedding[i + 1] AS DOUBLE) AS e FROM embeddings, range(len(embedding)) r(i) WHERE embedding[i + 1] IS NOT NULL AND label IS NOT NULL),
mean AS (SELECT label AS class, p, avg(e) AS m FROM x GROUP BY label, p),
lg AS (SELECT item_id, label, class, sum(e * m) * 10 AS logit FROM x JOIN mean USING (p) GROUP BY item_id, label, class),
pr AS (SELECT item_id, label, class, exp(logit - max(logit) OVER (PARTITION BY item_id)) AS ex, row_number() OVER (PARTITION BY item_id ORDER BY logit DESC, class) AS r FROM lg),
sm AS (SELECT *, ex / sum(ex) OVER (PARTITION BY item_id) AS conf FROM pr),
tt AS (SELECT item_id, label, max(class) FILTER (r = 1) AS char, max(conf) FILTER (r = 1) AS conf, max(class) FILTER (r = 2) AS alt, max(conf) FILTER (r = 2) AS alt_conf FROM sm GROUP BY item_id, label)"""
MET = "count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg, count(*) FILTER (label = 1 AND prob >= 0.5) AS tp, count(*) FILTER (label <> 1 AND prob >= 0.5) AS fp, sqrt(avg((prob - label) ** 2)) AS rmse"

SQL = {
    "raster_percentiles": f"WITH {E} SELECT image_id, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS q{i}" for i, q in enumerate([0.01, 0.5, 0.99, 0.005, 0.995, 0.1, 0.9])) + " FROM e GROUP BY image_id",
    "raster_brightness": f"WITH {E} SELECT image_id, round(avg(v), 6) AS mean, round(CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) END, 6) AS cv, round(avg(CASE WHEN v > 135 THEN 1 ELSE 0 END), 6) AS ink FROM e GROUP BY image_id",
    "raster_blur3": f"WITH {E} SELECT image_id, y, x, round(v, 6) AS v FROM {two_pass(B3, B3)}",
    "raster_blur5": f"WITH {E} SELECT image_id, y, x, round(v, 6) AS v FROM {two_pass(B5, B5)}",
    "raster_polarity": f"WITH {E}, {POL} SELECT * FROM pol",
    "raster_bright_ink": f"WITH {E}, {POL} SELECT image_id, y, x, CASE WHEN dark THEN 255 - v ELSE v END AS v FROM e JOIN pol USING (image_id)",
    "raster_median_blur": f"WITH {E}, {median5()} SELECT * FROM m",
    "raster_denoise_error": f"WITH {E}, {median5()} SELECT image_id, round(avg(abs(e.v - m.v)), 6) AS mae FROM e JOIN m USING (image_id, y, x) GROUP BY image_id",
    "raster_open": f"WITH {E}, o1 AS {morph('e', 'min', '1 PRECEDING', 'CURRENT ROW')} SELECT * FROM {morph('o1', 'max', 'CURRENT ROW', '1 FOLLOWING')}",
    "raster_ellipse_close": f"WITH {E}, {CLOSE} SELECT * FROM cl",
    "raster_ink_strength": f"WITH {E}, {CLOSE} SELECT image_id, y, x, greatest(0, least(255, cl.v - e.v)) AS v FROM cl JOIN e USING (image_id, y, x)",
    "raster_dilate": f"WITH {E}, {K} SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM ink, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)",
    "raster_ring": f"WITH {E}, {K} SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM ink, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) EXCEPT SELECT image_id, y, x FROM ink",
    "raster_sobel": f"WITH {E}, gx AS {two_pass([-1.0, 0, 1.0], [1.0, 2.0, 1.0])}, gy AS {two_pass([1.0, 2.0, 1.0], [-1.0, 0, 1.0])} SELECT image_id, y, x, round(gx.v, 6) AS gx, round(gy.v, 6) AS gy FROM gx JOIN gy USING (image_id, y, x)",
    "raster_otsu": f"""WITH {E}, h AS (SELECT image_id, v, count(*) AS n FROM e GROUP BY image_id, v), c AS (SELECT image_id, v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0, sum(n) OVER a AS wt, sum(n * v) OVER a AS st FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v), a AS (PARTITION BY image_id)),
b AS (SELECT image_id, v, CASE WHEN wt > w0 THEN round(w0::DOUBLE * (wt - w0) * (s0::DOUBLE / w0 - (st - s0)::DOUBLE / (wt - w0)) * (s0::DOUBLE / w0 - (st - s0)::DOUBLE / (wt - w0)), 3) ELSE -1 END AS k FROM c) SELECT image_id, v AS thr FROM b QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k DESC, v) = 1""",
    "raster_noise_threshold": f"WITH {E}, m AS (SELECT image_id, quantile_cont(v, 0.5) AS med FROM e GROUP BY image_id), n AS (SELECT image_id, 1.4826 * quantile_cont(abs(v - med), 0.5) AS noise FROM e JOIN m USING (image_id) GROUP BY image_id) SELECT image_id, round(noise, 6) AS noise, round(greatest(12.0, least(30.0, 5 * noise)), 6) AS thr FROM n",
    "raster_crop": f"WITH {E}, {SH}, bx AS (SELECT image_id, CAST(trunc(w * 0.7) AS INT) AS bw, CAST(trunc(h * 0.5) AS INT) AS bh, w, h FROM sh), o AS (SELECT *, CAST(floor((w - bw) / 2) AS INT) AS x0, CAST(floor((h - bh) / 2) AS INT) AS y0 FROM bx) SELECT image_id, y - y0 AS y, x - x0 AS x, v FROM e JOIN o USING (image_id) WHERE x >= x0 AND x < x0 + bw AND y >= y0 AND y < y0 + bh",
    "raster_rotate": f"WITH {E}, {SH} SELECT image_id, x AS y, h - 1 - y AS x, v FROM e JOIN sh USING (image_id)",
    "raster_resize_area": f"WITH {E} SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, round(avg(v), 6) AS v FROM e GROUP BY image_id, y // 2, x // 2",
    "raster_contrast_map": f"WITH {E}, p AS (SELECT image_id, quantile_cont(v, 0.9) AS q FROM e GROUP BY image_id) SELECT image_id, y, x, CAST(floor(255 - least(255.0, greatest(0.0, v * 200 / greatest(q, 1.0)))) AS INT) AS v FROM e JOIN p USING (image_id)",
    "raster_adaptive": f"WITH {E} SELECT image_id, y, x FROM {two_pass(G5, G5, replicate)} WHERE v0 > v + 2.0",
    "raster_has_ink": f"""WITH {E}, b AS {two_pass(B5, B5)}, p AS (SELECT image_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.99) AS hi FROM b GROUP BY image_id),
s AS (SELECT image_id, greatest(mid - lo, hi - mid) AS c, avg(CASE WHEN mid - lo > hi - mid THEN (mid - v > greatest(mid - lo, hi - mid) / 2)::INT ELSE (v - mid > greatest(mid - lo, hi - mid) / 2)::INT END) AS share FROM b JOIN p USING (image_id) GROUP BY image_id, c)
SELECT image_id, round(c, 6) AS contrast, round(share, 6) AS share, c >= 40 AND share BETWEEN 0.003 AND 0.35 AS has_ink FROM s""",
    "raster_resize_linear": f"""WITH {E}, {SH}, n AS (SELECT *, greatest(1, CAST(round_even(h * 0.75, 0) AS INT)) AS nh, greatest(1, CAST(round_even(w * 0.75, 0) AS INT)) AS nw FROM sh),
g AS (SELECT n.*, oy, ox, (oy + 0.5) * h / nh - 0.5 AS sy, (ox + 0.5) * w / nw - 0.5 AS sx FROM n, range(64) a(oy), range(64) b(ox) WHERE oy < nh AND ox < nw),
k AS (SELECT g.*, CASE dy WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END * CASE dx WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END AS k, greatest(0, least(h - 1, floor(sy) + dy)) AS y, greatest(0, least(w - 1, floor(sx) + dx)) AS x FROM g, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))
SELECT image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, round(sum(k * v), 6) AS v FROM k JOIN e USING (image_id, y, x) GROUP BY image_id, oy, ox""",
    "hull_areas": C + """, hp AS (SELECT image_id, label, y, min(x) AS x FROM lab GROUP BY ALL UNION SELECT image_id, label, y, max(x) FROM lab GROUP BY ALL),
hs AS (SELECT a.image_id, a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM hp a JOIN hp b ON a.image_id = b.image_id AND a.label = b.label AND (a.x, a.y) <> (b.x, b.y)),
e2 AS (SELECT hs.* FROM hs JOIN hp r ON r.image_id = hs.image_id AND r.label = hs.label GROUP BY ALL HAVING bool_and((bx - ax) * (r.y - ay) - (bz - ay) * (r.x - ax) > 0 OR ((bx - ax) * (r.y - ay) = (bz - ay) * (r.x - ax) AND (r.x - ax) * (r.x - bx) + (r.y - ay) * (r.y - bz) <= 0)))
SELECT c.image_id, c.label, coalesce(abs(sum(ax * bz - bx * ay)) / 2.0, 0.0) AS hull FROM comp c LEFT JOIN e2 ON e2.image_id = c.image_id AND e2.label = c.label GROUP BY c.image_id, c.label""",
    "corpus_padded": f"""WITH {E}, {SH}, c AS (SELECT vec_id AS image_id, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS label FROM embeddings),
q AS (SELECT image_id, c.label, count(*) AS c, sum(v) AS s, CAST(trunc(CASE c.label WHEN 1 THEN quantile_cont(v, 0.7) ELSE quantile_cont(v, 0.3) END) AS INT) AS fill FROM e JOIN c USING (image_id) GROUP BY image_id, c.label),
t AS (SELECT q.*, (h + 2 * (h // 2)) * (w + 2 * (h // 2)) AS n, h * w AS inner_n FROM q JOIN sh USING (image_id))
SELECT image_id, label, CAST(c + n - inner_n AS BIGINT) AS n, round(CASE label WHEN 1 THEN (s + (n - inner_n) * fill) / (c + n - inner_n) ELSE 255 - (s + (n - inner_n) * fill) / (c + n - inner_n) END, 6) AS mean FROM t""",
    "glyph_boxes": C + folded(f"CASE WHEN {over('gs[-1]')} THEN list_append(gs[:-2], {grown('gs[-1]')}) ELSE list_append(gs, {NEW}) END"),
    "glyph_groups": C + folded(f"CASE WHEN {FITS} > 0 THEN list_transform(gs, lambda g, j: CASE WHEN j = {FITS} THEN {grown('g')} ELSE g END) ELSE list_append(gs, {NEW}) END"),
    "ink_runs": f"WITH {T}, g AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM t) SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM g GROUP BY image_id, y, g",
    "ink_components": C + "SELECT * FROM comp",
    "ink_clean": C + "SELECT comp.* FROM comp JOIN sh USING (image_id) WHERE area >= greatest(6, 0.0002 * sh.h * sh.w) AND NOT (x <= 1 OR y <= 1 OR x + comp.w >= sh.w - 1 OR y + comp.h >= sh.h - 1) AND NOT ((comp.w > 0.5 * sh.w AND comp.w > 6 * comp.h) OR (comp.h > 0.8 * sh.h AND comp.h > 6 * comp.w))",
    "ink_size_kinds": C + ", k AS (SELECT comp.*, CASE WHEN area < 3 THEN 'tiny' WHEN x <= 1 OR y <= 1 OR x + comp.w >= sh.w - 1 OR y + comp.h >= sh.h - 1 THEN 'border' ELSE 'candidate' END AS kind FROM comp JOIN sh USING (image_id)) SELECT image_id, coalesce(sum(area) FILTER (kind = 'tiny'), 0) AS tiny, coalesce(sum(area) FILTER (kind = 'border'), 0) AS border, coalesce(sum(area) FILTER (kind = 'candidate'), 0) AS candidate FROM k GROUP BY image_id",
    "ink_largest_share": C + "SELECT image_id, label, area FROM comp QUALIFY area >= greatest(2.0, 0.3 * max(area) OVER (PARTITION BY image_id))",
    "component_features": C + "SELECT image_id, round(CASE WHEN count(*) >= 2 THEN stddev_pop(area) / avg(area) ELSE 0.0 END, 6) AS cc_size_var, round(1.0::DOUBLE / count(*), 6) AS stroke_connectivity FROM comp GROUP BY image_id",
    "distance": f"WITH {E}, {K}, z AS (SELECT image_id, y, x FROM e WHERE v <= 135) SELECT ink.image_id, ink.y, ink.x, round(sqrt(min((ink.x - z.x) ** 2 + (ink.y - z.y) ** 2)), 6) AS d FROM ink LEFT JOIN z ON ink.image_id = z.image_id GROUP BY ALL",
    "thinning_once": f"""WITH {E}, {K}, q AS (SELECT p.image_id, p.y, p.x, """ + ", ".join(f"max(CASE WHEN q.y - p.y = {dy} AND q.x - p.x = {dx} THEN 1 ELSE 0 END) AS n{i}" for i, (dy, dx) in enumerate([(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)])) + """ FROM ink p LEFT JOIN ink q ON p.image_id = q.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL)
SELECT image_id, y, x FROM q WHERE NOT (n0+n1+n2+n3+n4+n5+n6+n7 BETWEEN 2 AND 6 AND (CASE WHEN n0=0 AND n1=1 THEN 1 ELSE 0 END)+(CASE WHEN n1=0 AND n2=1 THEN 1 ELSE 0 END)+(CASE WHEN n2=0 AND n3=1 THEN 1 ELSE 0 END)+(CASE WHEN n3=0 AND n4=1 THEN 1 ELSE 0 END)+(CASE WHEN n4=0 AND n5=1 THEN 1 ELSE 0 END)+(CASE WHEN n5=0 AND n6=1 THEN 1 ELSE 0 END)+(CASE WHEN n6=0 AND n7=1 THEN 1 ELSE 0 END)+(CASE WHEN n7=0 AND n0=1 THEN 1 ELSE 0 END) = 1 AND n0*n2*n4 = 0 AND n2*n4*n6 = 0)""",
    "glyph_lines": C + ", g AS (SELECT *, y + h / 2.0 AS cy, quantile_cont(h, 0.5) OVER (PARTITION BY image_id) AS m FROM comp), n AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY image_id ORDER BY cy, x, y, w) > 0.6 * m THEN 1 ELSE 0 END AS new FROM g) SELECT image_id, label, CAST(sum(new) OVER (PARTITION BY image_id ORDER BY cy, x, y, w ROWS UNBOUNDED PRECEDING) AS INT) AS line FROM n",
    "glyph_top": C + ", k AS (SELECT image_id, x, y, w, h FROM comp QUALIFY h >= greatest(2.0, 0.35 * quantile_cont(h, 0.5) OVER (PARTITION BY image_id))) SELECT image_id, x, y, w, h FROM k QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, x, y, w) <= 3",
    "glyph_gaps": C + ", g AS (SELECT *, CASE WHEN lead(x) OVER o IS NOT NULL THEN greatest(lead(x) OVER o - (x + w), 0) END AS gap FROM comp WINDOW o AS (PARTITION BY image_id ORDER BY x, y, w, h)) SELECT image_id, round(CASE WHEN count(*) >= 2 AND avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END, 6) AS spacing_dev, round(CASE WHEN count(*) >= 2 THEN (max(y + h) - min(y + h)) / quantile_cont(h, 0.5) END, 6) AS baseline_wobble FROM g GROUP BY image_id",
    "line_texts": "WITH l AS (SELECT user_id AS image_id, day(ts) AS line, string_agg(CASE WHEN abs(value) / 100 >= 0.3 THEN substr(event_type, 1, 1) ELSE '?' END, '' ORDER BY event_id) AS t FROM events GROUP BY ALL) SELECT image_id, string_agg(t, ' / ' ORDER BY line) AS text FROM l GROUP BY image_id",
    "top_readings": f"WITH {CLS} SELECT item_id, char, round(conf, 6) AS conf, alt, round(alt_conf, 6) AS alt_conf, CASE WHEN round(conf, 6) >= 0.8 THEN 'green' WHEN round(conf, 6) >= 0.5 THEN 'yellow' ELSE 'red' END AS band FROM tt",
    "frames_majority": f"WITH {FRAMES} SELECT camera_id, seq, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER w > count(*) OVER w / 2 AS stable FROM f WINDOW w AS ({FO} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)",
    "frames_stable_text": f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER ({FO}) AS i FROM f WHERE text IS NOT NULL), j AS (SELECT a.camera_id, a.seq, b.text, count(*) AS n, min(b.i) AS p FROM r a LEFT JOIN r b ON a.camera_id = b.camera_id AND b.i BETWEEN a.i - 9 AND a.i AND b.text <> '' GROUP BY ALL)
SELECT camera_id, seq, CASE WHEN n >= 5 AND text IS NOT NULL THEN text END AS shown FROM j QUALIFY row_number() OVER (PARTITION BY camera_id, seq ORDER BY n DESC, p) = 1""",
    "frames_missed": f"WITH {FRAMES}, g AS (SELECT *, sum(CASE WHEN text IS NULL THEN 0 ELSE 1 END) OVER ({FO} ROWS UNBOUNDED PRECEDING) AS g FROM f), m AS (SELECT *, CAST(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, g ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS misses FROM g) SELECT camera_id, seq, misses, misses = 3 AS failed FROM m",
    "frames_rate": f"""WITH RECURSIVE {FRAMES}, d AS (SELECT camera_id, row_number() OVER ({FO}) AS i, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({FO})) / 1e6 AS dt FROM f), s(camera_id, i, fps) AS (SELECT camera_id, i, 0.1 / greatest(dt, 1e-6) FROM d WHERE i = 2 UNION ALL SELECT d.camera_id, d.i, 0.9 * fps + 0.1 / greatest(dt, 1e-6) FROM s JOIN d ON d.camera_id = s.camera_id AND d.i = s.i + 1)
SELECT camera_id, round(arg_max(fps, i), 6) AS fps FROM s GROUP BY camera_id""",
    "frames_most_common": f"WITH {FRAMES}, c AS (SELECT camera_id, text, count(*) AS n FROM f WHERE text <> '' GROUP BY ALL) SELECT camera_id, text, n FROM c QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY n DESC, text) = 1",
    "frames_health": f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY seq) AS i FROM f), k AS (SELECT * FROM r WHERE i <= 15 AND text IS NOT NULL)
SELECT camera_id, count(*) AS n, arg_max(text, i) AS last_text, round(arg_max(value, i), 6) AS last_value, CASE WHEN arg_max(value, i) < 10 THEN 'dark' END AS note FROM k GROUP BY camera_id""",
    "samples_by_source": f"WITH {SMP} SELECT source, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive FROM s GROUP BY source",
    "samples_standardized": f"WITH {SMP}, m AS (SELECT " + ", ".join(f"quantile_cont(f{i}, 0.5) AS m{i}" for i in range(1, 5)) + ", avg(label) AS p FROM s), f AS (SELECT sample_id, label, p, " + ", ".join(f"coalesce(f{i}, m{i}) AS f{i}" for i in range(1, 5)) + " FROM s, m), z AS (SELECT " + ", ".join(f"avg(f{i}) AS u{i}, stddev_pop(f{i}) + 1e-9 AS d{i}" for i in range(1, 5)) + " FROM f) SELECT sample_id, label, round(CASE WHEN label = 1 THEN 0.5 / p ELSE 0.5 / (1 - p) END, 6) AS cw, " + ", ".join(f"round((f{i} - u{i}) / d{i}, 6) AS f{i}" for i in range(1, 5)) + " FROM f, z",
    "samples_scored": f"WITH {SMP}, {SC} SELECT sample_id, round(prob, 6) AS prob, prob >= 0.5 AS is_handwritten, imputed FROM sc",
    "samples_metrics": f"""WITH {SMP}, {SC}, q AS (SELECT label, round(prob, 6) AS prob FROM sc), k AS (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rk FROM q),
m AS (SELECT count(*) AS n, {MET}, coalesce(-avg(ln(greatest(prob, 1e-12))) FILTER (label = 1), 0) AS l1, coalesce(-avg(ln(greatest(1 - prob, 1e-12))) FILTER (label <> 1), 0) AS l0, sum(rk) FILTER (label = 1) AS sr, -avg(ln(greatest(CASE WHEN label = 1 THEN prob ELSE 1 - prob END, 1e-12))) AS bce, 1 - avg((prob - label) ** 2) / nullif(var_pop(label), 0) AS r2 FROM k)
SELECT round(bce, 6) AS bce, round(r2, 6) AS r2, n, round(tp / greatest(pos, 1), 6) AS tpr, round((neg - fp) / greatest(neg, 1), 6) AS tnr, round((tp / greatest(pos, 1) + (neg - fp) / greatest(neg, 1)) / 2, 6) AS balanced_accuracy, round(1 - (neg - fp) / greatest(neg, 1), 6) AS fp_share, round(0.5 * l1 + 0.5 * l0, 6) AS balanced_log_loss, round(tp / greatest(tp + fp, 1), 6) AS precision, round(2 * tp / greatest(2 * tp + fp + pos - tp, 1), 6) AS f1, round(rmse, 6) AS rmse, round((sr - pos * (pos + 1) / 2) / (pos * neg), 6) AS auc FROM m""",
    "samples_metrics_by_source": f"WITH {SMP}, {SC}, m AS (SELECT source, count(*) AS n, {MET} FROM sc GROUP BY source) SELECT source, n, round(tp / greatest(pos, 1), 6) AS tpr, round((neg - fp) / greatest(neg, 1), 6) AS tnr, round((tp / greatest(pos, 1) + (neg - fp) / greatest(neg, 1)) / 2, 6) AS balanced_accuracy, round(rmse, 6) AS rmse FROM m",
    "samples_folds": f"WITH {SMP} SELECT sample_id, CAST(repeat AS INT) AS repeat, CAST((row_number() OVER (PARTITION BY repeat, label ORDER BY ((sample_id + 1) * (7919 + 104729 * repeat)) % 1000003, sample_id) - 1) % 5 AS INT) AS fold FROM s, range(10) r(repeat)",
    "samples_drift": f"WITH {SMP}, l AS (" + " UNION ALL ".join(f"SELECT 'f{i}' AS key, f{i} AS v FROM s" for i in range(1, 5)) + ") SELECT key, round(avg(v), 6) AS measured_mean, round(stddev_pop(v), 6) AS measured_std, CASE key WHEN 'f1' THEN 7.0 WHEN 'f2' THEN 6.0 WHEN 'f3' THEN 5.0 ELSE 0.9 END AS mean, CASE key WHEN 'f1' THEN 1.0 WHEN 'f2' THEN 1.5 WHEN 'f3' THEN 1.2 ELSE 0.1 END AS std FROM l GROUP BY key",
    "class_confusions": f"WITH {CLS} SELECT label, char AS predicted, count(*) AS n FROM tt WHERE label <> char GROUP BY ALL ORDER BY n DESC, label, predicted LIMIT 10",
    "class_accuracy": f"WITH {CLS} SELECT label, count(*) AS n, round(avg(CASE WHEN label = char THEN 1 ELSE 0 END), 6) AS accuracy FROM tt GROUP BY label",
}
SQL["frames_streamed"] = f"""
SELECT camera_id, seq, stable, shown, misses, failed FROM ({SQL["frames_majority"]}) LEFT JOIN ({SQL["frames_stable_text"]}) USING (camera_id, seq)
JOIN ({SQL["frames_missed"]}) USING (camera_id, seq) JOIN (SELECT event_id AS seq FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) USING (seq)
"""
SQL["decisions_streamed"] = f"""
WITH {FRAMES},
g AS (SELECT seq, CASE WHEN text IS NOT NULL THEN value / 100 END AS f1, CAST(length(nullif(text, '')) AS DOUBLE) AS f2 FROM f WHERE ts IS NOT NULL AND camera_id IS NOT NULL),
p AS (SELECT *, 1 / (1 + exp(-greatest(-60, least(60, -0.2 + (coalesce(f1, 0.5) - 0.5) / 0.3 * 0.8 + (coalesce(f2, 5.0) - 5.0) / 2.0 * 0.5)))) AS prob, coalesce(f1, f2) IS NOT NULL AS gate FROM g),
h AS (SELECT *, gate AND prob >= 0.5 AS hit FROM p)
SELECT seq AS image_id, CASE WHEN hit THEN 'handwritten' ELSE 'printed' END AS cls, CASE WHEN hit THEN '1' ELSE '' END AS shown, CASE WHEN NOT gate THEN 'no frame' END AS reason,
       CASE WHEN gate THEN round(prob, 4) END AS prob, CASE WHEN gate THEN round(f1, 4) END AS f1, CASE WHEN gate THEN round(f2, 4) END AS f2 FROM h
"""
SQL["samples_scored_by_record"] = SQL["samples_scored"]
SQL["raster_reader_input"] = f"WITH {E} SELECT image_id, y, x, round((v / 255.0::DOUBLE - 0.449) / 0.226, 6) AS v FROM e"
H15 = {dy: round(7 * math.sqrt((49 - dy * dy) / 49)) for dy in range(-7, 8)}
for _name, _first, _second in (("close", "max", "min"), ("open", "min", "max")):
    SQL[f"raster_ellipse_{_name}15"] = f"WITH {E}, c1 AS {ellipse('e', _first, H15)}, cl AS {ellipse('c1', _second, H15)} SELECT * FROM cl"
SQL["raster_rotate_180"] = f"WITH {E}, {SH} SELECT image_id, h - 1 - y AS y, w - 1 - x AS x, v FROM e JOIN sh USING (image_id)"
SQL["raster_rotate_270"] = f"WITH {E}, {SH} SELECT image_id, w - 1 - x AS y, y AS x, v FROM e JOIN sh USING (image_id)"
