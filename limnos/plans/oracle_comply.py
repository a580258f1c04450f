"""SQL of the whole rule book and of the chain of repairs: every stage a table, every document's shapes compared in pairs."""

from __future__ import annotations

from ..sources.bridge import ADVANCE, ASCENT, CANVAS, DESCENT, SHAPES_SQL
from . import catalog as K
from .oracle import FONTS, TOKENS, lab_of, lum, num

A = CANVAS * CANVAS
PAINTS = f"""
{TOKENS}, tlab AS (SELECT *, {", ".join(f"{e} AS t{k}" for e, k in zip(lab_of("rgb"), "LAB", strict=True))}, {lum("rgb")} AS tlum FROM tokens),
paints AS (
  SELECT doc_id, shape_index, 'f' AS p, tag = 'text' AS of_text, area, fill_r AS pr, fill_g AS pg, fill_b AS pb FROM shapes
  UNION ALL SELECT doc_id, shape_index, 's', false, area, stroke_r, stroke_g, stroke_b FROM shapes WHERE stroke_width > 0),
plab AS (SELECT *, {", ".join(f"{e} AS s{k}" for e, k in zip(lab_of(("pr", "pg", "pb")), "LAB", strict=True))} FROM paints),
pnear AS (
  SELECT s.*, i, r = pr AND g = pg AND b = pb AS same, sqrt((sL - tL) * (sL - tL) + (sA - tA) * (sA - tA) + (sB - tB) * (sB - tB)) AS d,
    CASE WHEN of_text THEN role IN ('ink', 'text', 'primary', 'accent') WHEN coalesce(area / {A}e0 >= {K.LARGE_AREA}, false) THEN role IN ('surface', 'background', 'ink', 'text') ELSE true END AS suits
  FROM plab s CROSS JOIN tlab t),
psnap AS (
  SELECT doc_id, shape_index, p, any_value(area) AS area, coalesce(min(i) FILTER (same), arg_min(i, (d, i)) FILTER (suits)) AS token,
    CASE WHEN bool_or(same) THEN NULL WHEN min(d) FILTER (suits) <= {K.SNAP_WARNING} THEN 'warning' ELSE 'error' END AS severity FROM pnear GROUP BY doc_id, shape_index, p)"""


def near(value: str, steps) -> str:
    """The nearest step, the first of equals."""
    out = num(steps[-1])
    for s in reversed(steps[:-1]):
        others = [abs_of(value, o) for o in steps]
        out = f"CASE WHEN {abs_of(value, s)} <= least({', '.join(others)}) THEN {num(s)} ELSE {out} END"
    return f"({out})"


def abs_of(value: str, s: float) -> str:
    return f"abs({value} - {num(s)})"


def off(value: str, steps) -> str:
    return f"abs({value} - {near(value, steps)}) > greatest(abs({value}), abs({near(value, steps)})) * 1e-9"


def snap(value: str) -> str:
    return f"(round_even(({value}) / {num(K.GRID)}, 0) * {num(K.GRID)})"


def checks(t: str) -> str:
    """The checks of single shapes of a table."""
    grid = " OR ".join(f"({w} AND abs({snap(k)} - {k}) > 1e-6)" for k, w in (("x", "true"), ("y", "true"), ("width", "tag = 'rect'"), ("height", "tag = 'rect'"), ("radius", "tag = 'circle'")))
    return f"""SELECT doc_id, shape_index, 'layout.min-size' AS rule, 'info' AS severity FROM {t} WHERE tag <> 'text' AND area < {K.MIN_SIZE**2}
  UNION ALL SELECT doc_id, shape_index, 'stroke.width', 'warning' FROM {t} WHERE stroke_width > 0 AND {off("stroke_width", K.STROKES)}
  UNION ALL SELECT doc_id, shape_index, 'layout.grid', 'warning' FROM {t} WHERE {grid}
  UNION ALL SELECT doc_id, shape_index, 'type.font', CASE WHEN font_family IS NULL THEN 'warning' ELSE 'error' END FROM {t} WHERE tag = 'text' AND (font_family IS NULL OR font_family NOT IN ({FONTS}))
  UNION ALL SELECT doc_id, shape_index, 'type.scale', 'warning' FROM {t} WHERE tag = 'text' AND {off("font_size", K.TYPE_SCALE)}"""


INSIDE = "CASE WHEN b.tag = 'circle' THEN pow(t.px - (b.x0 + b.x1) / 2, 2) + pow(t.py - (b.y0 + b.y1) / 2, 2) <= b.radius * b.radius ELSE t.px BETWEEN b.x0 AND b.x1 AND t.py BETWEEN b.y0 AND b.y1 END"


def scene(t: str, n: str) -> str:
    """Tables on a table with a column light: contrasts, laid-out boxes, collisions, buried texts, edges."""
    shared = "greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
    return f"""
back{n} AS (SELECT doc_id, arg_min(light, shape_index) AS back FROM {t} WHERE area >= 0.9e0 * {A}e0 GROUP BY doc_id),
spots{n} AS (SELECT s.*, k, x0 + (x1 - x0) * u AS px, y0 + (y1 - y0) * v AS py FROM {t} s, (VALUES (0, 0.5e0, 0.5e0), (1, 0.08e0, 0.5e0), (2, 0.92e0, 0.5e0), (3, 0.5e0, 0.2e0), (4, 0.5e0, 0.8e0)) AS p(k, u, v) WHERE tag = 'text'),
seen{n} AS (SELECT t.doc_id, t.shape_index, t.k, t.font_size, t.light AS own, arg_max(b.light, b.shape_index) AS ground
  FROM spots{n} t LEFT JOIN {t} b ON b.doc_id = t.doc_id AND b.tag <> 'text' AND b.shape_index < t.shape_index AND {INSIDE} GROUP BY ALL),
stood{n} AS (SELECT s.* EXCLUDE (ground), coalesce(ground, back) AS ground FROM seen{n} s LEFT JOIN back{n} USING (doc_id)),
worst{n} AS (SELECT doc_id, shape_index, min(q) AS ratio, arg_min(ground, (q, k)) AS ground, CASE WHEN any_value(font_size) >= 24 THEN 3e0 ELSE 4.5e0 END AS need
  FROM (SELECT *, (greatest(own, ground) + 0.05e0) / (least(own, ground) + 0.05e0) AS q FROM stood{n} WHERE ground IS NOT NULL) GROUP BY doc_id, shape_index),
laid{n} AS (SELECT *, greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0) AS box_area FROM {t} WHERE greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0) < {0.9 * A}e0),
hit{n} AS (SELECT a.doc_id, a.shape_index, b.shape_index AS other, a.y, a.y0, a.y1, b.y1 AS oy1, {shared} / greatest(1e-6, least(a.box_area, b.box_area)) AS share
  FROM laid{n} a JOIN laid{n} b ON a.doc_id = b.doc_id AND a.shape_index < b.shape_index AND a.tag = 'text' AND b.tag = 'text'
    AND a.x0 + 1 < b.x1 - 1 AND b.x0 + 1 < a.x1 - 1 AND a.y0 + 1 < b.y1 - 1 AND b.y0 + 1 < a.y1 - 1),
buried{n} AS (SELECT DISTINCT a.doc_id, a.shape_index FROM laid{n} a JOIN laid{n} b ON a.doc_id = b.doc_id AND a.tag = 'text' AND b.tag <> 'text' AND b.opacity >= 0.9e0 AND b.shape_index > a.shape_index
  WHERE {shared} / greatest(1e-6, a.box_area) >= 0.6e0)"""


def edges(t: str, n: str) -> str:
    return f"""
ebox{n} AS (SELECT *, greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0) AS box_area FROM {t}),
elaid{n} AS (SELECT * FROM ebox{n} WHERE box_area < {0.9 * A}e0),
edge{n} AS (SELECT doc_id, shape_index, CASE WHEN n >= 2 AND hi - lo >= 1e-6 AND abs(x0 - target) >= 1e-6 THEN target - x0 END AS shift
  FROM (SELECT *, CASE WHEN abs({snap("lo")} - lo) <= 2 THEN {snap("lo")} ELSE lo END AS target
    FROM (SELECT *, count(*) OVER g AS n, min(x0) OVER g AS lo, max(x0) OVER g AS hi
      FROM (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY x0, shape_index ROWS UNBOUNDED PRECEDING) AS cl
        FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0, shape_index) <= 2 THEN 0 ELSE 1 END AS nw FROM elaid{n}))
      WINDOW g AS (PARTITION BY doc_id, cl))))"""


def advice(t: str, n: str) -> str:
    """Over a table with the final boxes; areas are those before the shift."""
    return f"""
gap{n} AS (SELECT doc_id, y0 - lag(y1) OVER (PARTITION BY doc_id ORDER BY y0, shape_index) AS gap FROM {t} WHERE box_area < {0.9 * A}e0),
rhythm{n} AS (SELECT doc_id FROM gap{n} WHERE gap > 0 GROUP BY doc_id HAVING count(*) >= 2 AND count(*) FILTER (abs(gap - {snap("gap")}) > 1) > 0),
sums{n} AS (SELECT doc_id, count(*) AS items, sum(box_area) AS a, sum(box_area * (x0 + x1) / 2) AS mx, sum(box_area * (y0 + y1) / 2) AS my FROM {t} WHERE box_area < {0.9 * A}e0 GROUP BY doc_id),
advice{n} AS (
  SELECT doc_id, 'layout.rhythm' AS rule FROM rhythm{n}
  UNION ALL SELECT doc_id, 'layout.balance' FROM sums{n} WHERE items >= 2 AND a > 0 AND (abs(mx / a - {CANVAS / 2}e0) / {CANVAS}e0 > 0.25e0 OR abs(my / a - {CANVAS / 2}e0) / {CANVAS}e0 > 0.25e0)
  UNION ALL SELECT doc_id, 'layout.whitespace' FROM sums{n} WHERE 1e0 - least({A}e0, a) / {A}e0 < 0.15e0
  UNION ALL SELECT doc_id, 'type.hierarchy' FROM {t} WHERE tag = 'text' GROUP BY doc_id HAVING count(*) >= 2 AND count(DISTINCT font_size) < 2)"""


AUDIT = f"""{SHAPES_SQL}, {PAINTS},
lit AS (SELECT *, {lum(("fill_r", "fill_g", "fill_b"))} AS light FROM shapes), {scene("lit", "0")}, {edges("lit", "0")}, {advice("ebox0", "0")},
single0 AS ({checks("shapes")}),
audit AS (SELECT doc_id, rule, severity, count(*) AS findings FROM (
  SELECT doc_id, 'color.palette' AS rule, severity FROM psnap WHERE severity IS NOT NULL
  UNION ALL SELECT doc_id, 'color.max', 'error' FROM (SELECT DISTINCT doc_id, pr, pg, pb FROM paints) GROUP BY doc_id HAVING count(*) > {K.MAX_COLORS}
  UNION ALL SELECT doc_id, rule, severity FROM single0
  UNION ALL SELECT doc_id, 'a11y.contrast', 'error' FROM worst0 WHERE ratio < need
  UNION ALL SELECT doc_id, 'layout.collision', CASE WHEN share > 0.25 THEN 'error' ELSE 'warning' END FROM hit0
  UNION ALL SELECT doc_id, 'layout.collision', 'error' FROM buried0
  UNION ALL SELECT doc_id, 'layout.alignment', 'warning' FROM edge0 WHERE shift IS NOT NULL
  UNION ALL SELECT doc_id, rule, 'info' FROM advice0) GROUP BY ALL)"""

BOX = f"""CASE tag WHEN 'circle' THEN x - radius ELSE x END AS x0, CASE tag WHEN 'rect' THEN y WHEN 'circle' THEN y - radius ELSE y - font_size * {ASCENT}e0 END AS y0,
  CASE tag WHEN 'rect' THEN x + width WHEN 'circle' THEN x + radius ELSE x + font_size * {ADVANCE}e0 * text_len END AS x1,
  CASE tag WHEN 'rect' THEN y + height WHEN 'circle' THEN y + radius ELSE y + font_size * {DESCENT}e0 END AS y1,
  CASE tag WHEN 'rect' THEN width * height WHEN 'circle' THEN 3.14159e0 * radius * radius END AS area"""

COMPLY = f"""{AUDIT},
use AS (SELECT doc_id, token, sum(coalesce(nullif(area, 0e0), 1e0)) AS u, min(shape_index * 2 + CASE p WHEN 's' THEN 1 ELSE 0 END) AS o FROM psnap GROUP BY doc_id, token),
rank AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(u, 6) DESC, o) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM use),
merge AS (SELECT x.doc_id, x.token, arg_min(y.token, (sqrt(pow(a.tL - b.tL, 2) + pow(a.tA - b.tA, 2) + pow(a.tB - b.tB, 2)), y.k)) AS into_token
  FROM rank x JOIN rank y ON x.doc_id = y.doc_id AND x.k > {K.MAX_COLORS} AND y.k <= {K.MAX_COLORS} JOIN tlab a ON a.i = x.token JOIN tlab b ON b.i = y.token GROUP BY x.doc_id, x.token),
painted AS (SELECT p.doc_id, p.shape_index, max(coalesce(m.into_token, p.token)) FILTER (p = 'f') AS f2, max(coalesce(m.into_token, p.token)) FILTER (p = 's') AS s2, count(severity) AS snaps
  FROM psnap p LEFT JOIN merge m ON m.doc_id = p.doc_id AND m.token = p.token GROUP BY p.doc_id, p.shape_index),
specks AS (SELECT doc_id, shape_index FROM shapes WHERE tag <> 'text' AND area < {K.MIN_SIZE**2}),
singles AS (SELECT doc_id, count(*) AS n FROM single0 s LEFT JOIN specks k USING (doc_id, shape_index) WHERE k.doc_id IS NULL OR rule = 'layout.min-size' GROUP BY doc_id),
fixed1 AS (SELECT doc_id, shape_index, tag, {snap("x")} AS x, {snap("y")} AS y, CASE tag WHEN 'rect' THEN {snap("width")} ELSE width END AS width, CASE tag WHEN 'rect' THEN {snap("height")} ELSE height END AS height,
  CASE tag WHEN 'circle' THEN {snap("radius")} ELSE radius END AS radius, text_len, opacity, CASE WHEN tag <> 'text' OR font_family IN ({FONTS}) THEN font_family ELSE '{K.FONTS[0]}' END AS font_family,
  CASE WHEN tag = 'text' THEN {near("font_size", K.TYPE_SCALE)} ELSE font_size END AS font_size, CASE WHEN stroke_width > 0 THEN {near("stroke_width", K.STROKES)} ELSE stroke_width END AS stroke_width FROM shapes ANTI JOIN specks USING (doc_id, shape_index)),
stage AS (SELECT b.*, f2, s2, tlum AS light FROM (SELECT *, {BOX} FROM fixed1) b JOIN painted USING (doc_id, shape_index) JOIN tlab ON tlab.i = f2), {scene("stage", "1")},
poor AS (SELECT doc_id, shape_index, max(q) >= any_value(need) AS recolored, arg_max(i, (q, -i)) AS f3
  FROM (SELECT w.*, i, (greatest(ground, tlum) + 0.05e0) / (least(ground, tlum) + 0.05e0) AS q FROM worst1 w, tlab WHERE ratio < need) GROUP BY doc_id, shape_index),
hits AS (SELECT doc_id, shape_index, any_value(y) AS y, any_value(y0) AS y0, any_value(y1) AS y1, list({{'o': other, 'oy1': oy1, 'share': share}} ORDER BY other) AS met FROM hit1 GROUP BY doc_id, shape_index),
walk(doc_id, shape_index, k, y, y0, y1, met, moves, errors, warnings) AS (
  SELECT doc_id, shape_index, 0, y, y0, y1, met, 0, 0, 0 FROM hits
  UNION ALL
  SELECT doc_id, shape_index, k + 1, CASE WHEN fits THEN target ELSE y END, y0, y1, met, moves + CAST(fits AS INT), errors + CAST(NOT fits AND share > 0.25 AS INT), warnings + CAST(NOT fits AND share <= 0.25 AS INT)
  FROM (SELECT *, target + (y1 - y) <= {CANVAS}e0 AS fits FROM (SELECT *, met[k + 1].share AS share, {snap("met[k + 1].oy1 + (y1 - y0) * 0.15e0 + (y - y0)")} AS target FROM walk WHERE k < len(met)))),
moves AS (SELECT doc_id, shape_index, y AS new_y, moves, errors, warnings FROM walk WHERE k = len(met)),
placed AS (SELECT s.* EXCLUDE (x0, y0, x1, y1, area, y, f2), coalesce(new_y, s.y) AS y, CASE WHEN recolored THEN f3 ELSE f2 END AS f2 FROM stage s LEFT JOIN poor USING (doc_id, shape_index) LEFT JOIN moves USING (doc_id, shape_index)),
boxed AS (SELECT *, {BOX} FROM placed), {edges("boxed", "2")},
done AS (SELECT *, {BOX} FROM (SELECT b.* EXCLUDE (x0, y0, x1, y1, area, x), b.x + coalesce(shift, 0e0) AS x FROM ebox2 b LEFT JOIN edge2 USING (doc_id, shape_index))), {advice("done", "2")},
told AS (
  SELECT doc_id, 'none' AS severity, 0 AS open, sum(snaps) AS fixed FROM painted GROUP BY doc_id
  UNION ALL SELECT doc_id, 'none', 0, n FROM singles
  UNION ALL SELECT DISTINCT doc_id, 'none', 0, 1 FROM rank WHERE n > {K.MAX_COLORS}
  UNION ALL SELECT doc_id, 'error', count(*) FILTER (NOT recolored), count(*) FILTER (recolored) FROM poor GROUP BY doc_id
  UNION ALL SELECT doc_id, 'error', sum(errors), sum(moves) FROM moves GROUP BY doc_id
  UNION ALL SELECT doc_id, 'warning', sum(warnings), 0 FROM moves GROUP BY doc_id
  UNION ALL SELECT doc_id, 'error', count(*), 0 FROM buried1 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'none', 0, count(shift) FROM edge2 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'info', 1, 0 FROM advice2)"""

WEIGHT = "CASE severity WHEN 'error' THEN 5e0 WHEN 'warning' THEN 2e0 WHEN 'info' THEN 0.5e0 ELSE 0e0 END"
RULES = "color.palette color.max layout.min-size stroke.width layout.grid type.font type.scale a11y.contrast layout.collision layout.alignment layout.rhythm layout.balance layout.whitespace type.hierarchy".split()
COLORS = ", ".join("#" + "".join(f"{v:02x}" for v in t[1:4]) for t in K.TOKENS)
SQL = {
    "feedback_top5": f"""WITH {AUDIT}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_position({RULES}, rule), list_position(['error', 'warning', 'info'], severity)) AS k FROM audit),
f AS (SELECT doc_id, sum({WEIGHT} * findings) AS lost, string_agg(rule, '; ' ORDER BY k) FILTER (k <= 5) AS told FROM k GROUP BY doc_id)
SELECT o_orderkey AS doc_id, concat_ws('. ', 'Previous attempt scored ' || greatest(0e0, round_even(100e0 - coalesce(lost, 0e0), 1)) || '/100', told, 'Use ONLY these colors: {COLORS}') AS feedback FROM orders LEFT JOIN f ON f.doc_id = o_orderkey""",
    "audit_documents": f"WITH {AUDIT} SELECT * FROM audit",
    "text_moves": f"WITH RECURSIVE {COMPLY} SELECT doc_id, shape_index, new_y, moves, errors, warnings FROM moves",
    "complied_shapes": f"WITH RECURSIVE {COMPLY} SELECT doc_id, shape_index, tag, x, y, name AS fill, font_family, font_size, stroke_width FROM done JOIN tokens ON i = f2",
    "comply_documents": f"""WITH RECURSIVE {COMPLY},
b AS (SELECT doc_id, sum({WEIGHT} * findings) AS lost, sum(findings) AS n FROM audit GROUP BY doc_id), a AS (SELECT doc_id, sum({WEIGHT} * open) AS lost, sum(open) AS n, sum(fixed) AS f FROM told GROUP BY doc_id)
SELECT o_orderkey AS doc_id, greatest(0e0, round_even(100e0 - coalesce(b.lost, 0e0), 1)) AS score_before, CAST(coalesce(b.n, 0) AS BIGINT) AS open_before,
  greatest(0e0, round_even(100e0 - coalesce(a.lost, 0e0), 1)) AS score_after, CAST(coalesce(a.n, 0) AS BIGINT) AS open_after, CAST(coalesce(a.f, 0) AS BIGINT) AS fixed
FROM orders LEFT JOIN b ON b.doc_id = o_orderkey LEFT JOIN a ON a.doc_id = o_orderkey""",
}
