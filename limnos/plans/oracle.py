"""SQL that the registered queries are held against, over the same tables."""

from __future__ import annotations

from ..functions import color as C
from ..sources.bridge import CANDIDATES_SQL, CANVAS, LIFECYCLE_SQL, SHAPES_SQL
from . import catalog as K


def num(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255e0 <= 0.04045e0 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END)"


def dot(row, xs) -> str:
    return "(" + " + ".join(f"({num(k)}) * {x}" for k, x in zip(row, xs, strict=True)) + ")"


def lab_of(rgb) -> list[str]:
    roots = [f"(CASE WHEN {v} > 0 THEN pow({v}, {num(1 / 3)}) ELSE 0e0 END)" for v in (dot(row, [lin(c) for c in rgb]) for row in C.TO_LMS)]
    return [dot(row, roots) for row in C.TO_LAB]


def lum(rgb) -> str:
    return dot(C.LUMA, [lin(c) for c in rgb])


FILL = ("fill_r", "fill_g", "fill_b")
TOKENS = "tokens AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {r}, {g}, {b}, '{role}')" for i, (n, r, g, b, role) in enumerate(K.TOKENS)) + ") AS t(i, name, r, g, b, role))"
LABS = f"""{SHAPES_SQL}, {TOKENS},
tlab AS (SELECT *, {", ".join(f"{e} AS t{k}" for e, k in zip(lab_of("rgb"), "LAB", strict=True))}, {lum("rgb")} AS tlum FROM tokens),
slab AS (SELECT *, {", ".join(f"{e} AS s{k}" for e, k in zip(lab_of(FILL), "LAB", strict=True))}, {lum(FILL)} AS slum FROM shapes),
near AS (SELECT s.*, i, name, role, r, g, b, tlum, sqrt((sL - tL) * (sL - tL) + (sA - tA) * (sA - tA) + (sB - tB) * (sB - tB)) AS d FROM slab s CROSS JOIN tlab t)"""
INK = f"(CASE WHEN greatest({', '.join(FILL)}) = 0 THEN 100e0 ELSE 100e0 * (3 * greatest({', '.join(FILL)}) / 255e0 - ({' + '.join(FILL)}) / 255e0) / (greatest({', '.join(FILL)}) / 255e0) + 100e0 * (1e0 - greatest({', '.join(FILL)}) / 255e0) END)"
LAID = f"{SHAPES_SQL}, laid AS (SELECT *, greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0) AS box_area FROM shapes WHERE greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0) < {0.9 * CANVAS * CANVAS}e0)"
SHARED = "greatest(0e0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0e0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
A = CANVAS * CANVAS


def scale(column: str, steps, out: str, where: str = "true") -> str:
    table = ", ".join(f"({i}, {num(s)})" for i, s in enumerate(steps))
    return f"""WITH {SHAPES_SQL}, steps AS (SELECT * FROM (VALUES {table}) AS t(i, s)),
r AS (SELECT doc_id, shape_index, {column}, arg_min(s, (abs({column} - s), i)) AS {out} FROM shapes CROSS JOIN steps WHERE {where} GROUP BY ALL)
SELECT doc_id, shape_index, round({column}, 6) AS {column}, {out}, abs({column} - {out}) > greatest(abs({column}), abs({out})) * 1e-9 AS off_scale FROM r"""


def clamp(v: str, lo: str, hi: str) -> str:
    out = f"least(greatest({v}, {lo}), {hi})"
    step = f"(round_even({out} / 8e0, 0) * 8e0)"
    up = f"(CASE WHEN {step} < {lo} THEN {step} + 8e0 ELSE {step} END)"
    down = f"(CASE WHEN {up} > {hi} THEN {up} - 8e0 ELSE {up} END)"
    return f"(CASE WHEN {lo} > {hi} THEN ({lo} + {hi}) / 2e0 WHEN {out} = {v} THEN {out} WHEN {down} >= {lo} AND {down} <= {hi} THEN {down} ELSE {out} END)"


def idle(status: str, minutes: int) -> str:
    return f"""WITH {LIFECYCLE_SQL}, l AS (SELECT request, arg_max(status, (ts, event_id)) AS status, max(ts) AS since FROM lifecycle GROUP BY request)
SELECT request, since FROM l WHERE status = '{status}' AND since < (SELECT max(ts) FROM lifecycle) - INTERVAL {minutes} MINUTE"""


GRID = """SELECT doc_id, shape_index, tag, xs AS x_snapped, ys AS y_snapped, ws AS w_snapped, hs AS h_snapped,
  abs(xs - x) > 1e-6 OR abs(ys - y) > 1e-6 OR coalesce(abs(ws - w) > 1e-6, false) OR coalesce(abs(hs - h) > 1e-6, false) AS off_grid
FROM (SELECT *, round_even(x / 8e0, 0) * 8e0 AS xs, round_even(y / 8e0, 0) * 8e0 AS ys, round_even(w / 8e0, 0) * 8e0 AS ws, round_even(h / 8e0, 0) * 8e0 AS hs
      FROM (SELECT *, CASE tag WHEN 'rect' THEN width WHEN 'circle' THEN radius END AS w, CASE tag WHEN 'rect' THEN height END AS h FROM shapes))"""
EXACT = "bool_or(fill_r = r AND fill_g = g AND fill_b = b)"
SEVERITY = f"CASE WHEN {EXACT} THEN NULL WHEN min(d) <= {K.SNAP_WARNING} THEN 'warning' ELSE 'error' END"
FONTS = ", ".join(f"'{f}'" for f in K.FONTS)
ALIGN = """SELECT *, CASE WHEN abs(round_even(lo / 8e0, 0) * 8e0 - lo) <= 2 THEN round_even(lo / 8e0, 0) * 8e0 ELSE lo END AS target
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, cl) AS n, min(x0) OVER (PARTITION BY doc_id, cl) AS lo, max(x0) OVER (PARTITION BY doc_id, cl) AS hi
      FROM (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY x0, shape_index ROWS UNBOUNDED PRECEDING) AS cl
            FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id ORDER BY x0, shape_index) <= 2 THEN 0 ELSE 1 END AS nw FROM laid)))
WHERE n >= 2 AND hi - lo >= 1e-6"""
BALANCE = f"""SELECT doc_id, round(ox, 6) AS off_x, round(oy, 6) AS off_y, ox > 0.25 OR oy > 0.25 AS lopsided
FROM (SELECT doc_id, count(*) AS items, sum(box_area) AS a, abs(sum(box_area * (x0 + x1) / 2) / sum(box_area) - {CANVAS / 2}e0) / {CANVAS}e0 AS ox,
             abs(sum(box_area * (y0 + y1) / 2) / sum(box_area) - {CANVAS / 2}e0) / {CANVAS}e0 AS oy FROM laid GROUP BY doc_id) WHERE items >= 2 AND a > 0"""
WHITE = f"SELECT doc_id, round(1e0 - least({A}e0, sum(box_area)) / {A}e0, 6) AS whitespace, 1e0 - least({A}e0, sum(box_area)) / {A}e0 < 0.15e0 AS crowded FROM laid GROUP BY doc_id"
HIERARCHY = "SELECT doc_id, count(*) AS texts, count(DISTINCT font_size) AS sizes FROM shapes WHERE tag = 'text' GROUP BY doc_id HAVING count(*) >= 2 AND count(DISTINCT font_size) < 2"
COLORS = """SELECT *, count(*) OVER (PARTITION BY doc_id) AS colors, row_number() OVER (PARTITION BY doc_id ORDER BY round(usage, 6) DESC, first) AS rank
FROM (SELECT doc_id, fill_r, fill_g, fill_b, sum(coalesce(area, 1e0)) AS usage, min(shape_index) AS first FROM shapes GROUP BY ALL)"""
FINDINGS = f"""{LABS}, laid AS (SELECT *, greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0) AS box_area FROM shapes WHERE greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0) < {0.9 * A}e0),
pal AS (SELECT doc_id, shape_index, {SEVERITY} AS severity FROM near GROUP BY ALL),
found AS (
  SELECT doc_id, 'color.palette' AS rule, severity FROM pal WHERE severity IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, 'color.max', 'error' FROM ({COLORS}) WHERE colors > {K.MAX_COLORS}
  UNION ALL SELECT doc_id, 'geometry.min-size', 'info' FROM shapes WHERE tag <> 'text' AND area < 16
  UNION ALL SELECT doc_id, 'geometry.stroke-width', 'warning' FROM shapes WHERE stroke_width NOT IN (1, 2, 4, 8) AND least(abs(stroke_width - 1), abs(stroke_width - 2), abs(stroke_width - 4), abs(stroke_width - 8)) > 1e-8
  UNION ALL SELECT doc_id, 'geometry.grid', 'warning' FROM ({GRID}) WHERE off_grid
  UNION ALL SELECT doc_id, 'type.font', 'error' FROM shapes WHERE tag = 'text' AND font_family NOT IN ({FONTS})
  UNION ALL SELECT doc_id, 'type.scale', 'warning' FROM shapes WHERE tag = 'text' AND least({", ".join(f"abs(font_size - {s})" for s in K.TYPE_SCALE)}) > 1e-7
  UNION ALL SELECT doc_id, 'layout.alignment', 'warning' FROM ({ALIGN}) WHERE abs(x0 - target) >= 1e-6
  UNION ALL SELECT doc_id, 'layout.balance', 'info' FROM ({BALANCE}) WHERE lopsided
  UNION ALL SELECT doc_id, 'layout.whitespace', 'info' FROM ({WHITE}) WHERE crowded
  UNION ALL SELECT doc_id, 'type.hierarchy', 'info' FROM ({HIERARCHY}))"""
FORMATS = "formats AS (SELECT * FROM (VALUES " + ", ".join(f"('{f.name}', {float(f.width)}e0, {float(f.height)}e0, '{f.category}', {float(f.margin)}e0, {float(f.min_text)}e0, {float(f.dpi)}e0)" for f in K.FORMATS) + ") AS t(name, width, height, category, margin, min_text, dpi))"
S = f"WITH {SHAPES_SQL} "
L = f"WITH {LAID} "
N = f"WITH {LABS} "

SQL = {
    "palette_snap": N + f"SELECT doc_id, shape_index, arg_min(name, (d, i)) AS token, round(min(d), 6) AS dist, {SEVERITY} AS severity FROM near GROUP BY ALL",
    "palette_snap_strokes": f"""WITH {SHAPES_SQL}, {TOKENS}, tlab AS (SELECT *, {", ".join(f"{e} AS t{k}" for e, k in zip(lab_of("rgb"), "LAB", strict=True))} FROM tokens),
slab AS (SELECT *, {", ".join(f"{e} AS s{k}" for e, k in zip(lab_of(("stroke_r", "stroke_g", "stroke_b")), "LAB", strict=True))} FROM shapes WHERE stroke_width > 0),
near AS (SELECT s.*, i, name, sqrt((sL - tL) * (sL - tL) + (sA - tA) * (sA - tA) + (sB - tB) * (sB - tB)) AS d FROM slab s CROSS JOIN tlab t)
SELECT doc_id, shape_index, format('#{{:02x}}{{:02x}}{{:02x}}', any_value(stroke_r), any_value(stroke_g), any_value(stroke_b)) AS stroke, arg_min(name, (d, i)) AS token, round(min(d), 6) AS dist,
  CASE WHEN min(d) <= {K.SNAP_WARNING} THEN 'warning' ELSE 'error' END AS severity FROM near GROUP BY doc_id, shape_index HAVING min(d) > 0""",
    "background_color": S + "SELECT doc_id, min(shape_index) AS shape_index, arg_min(format('#{:02x}{:02x}{:02x}', fill_r, fill_g, fill_b), shape_index) AS background FROM shapes WHERE greatest(0e0, x1 - x0) * greatest(0e0, y1 - y0) >= 0.9e0 * 1e4 GROUP BY doc_id",
    "palette_snap_roles": N + f"""SELECT doc_id, shape_index, tag, arg_min(name, (d, i)) AS token, arg_min(role, (d, i)) AS role, round(min(d), 6) AS dist FROM near
WHERE CASE WHEN tag = 'text' THEN role IN ('ink', 'text', 'primary', 'accent') WHEN coalesce(area / {A}e0 >= {K.LARGE_AREA}, false) THEN role IN ('surface', 'background', 'ink', 'text') ELSE true END GROUP BY ALL""",
    "contrast_pairs": N + """, c AS (SELECT *, (greatest(slum, tlum) + 0.05e0) / (least(slum, tlum) + 0.05e0) AS q FROM near)
SELECT doc_id, shape_index, round(max(CASE WHEN name = 'white' THEN q END), 6) AS on_white, round(max(CASE WHEN name = 'ink' THEN q END), 6) AS on_ink,
       arg_max(name, (q, -i)) AS best_token, round(max(q), 6) AS best_ratio FROM c GROUP BY doc_id, shape_index""",
    "cmyk_ink": S + """, k AS (SELECT *, 1e0 - greatest(fill_r, fill_g, fill_b) / 255e0 AS k FROM shapes)
SELECT doc_id, shape_index, round(CASE WHEN k >= 1 THEN 0e0 ELSE (1e0 - fill_r / 255e0 - k) / (1e0 - k) END, 6) AS c, round(CASE WHEN k >= 1 THEN 0e0 ELSE (1e0 - fill_g / 255e0 - k) / (1e0 - k) END, 6) AS m,
       round(CASE WHEN k >= 1 THEN 0e0 ELSE (1e0 - fill_b / 255e0 - k) / (1e0 - k) END, 6) AS y, round(k, 6) AS k,
       round(100 * (CASE WHEN k >= 1 THEN k ELSE (1e0 - fill_r / 255e0 - k) / (1e0 - k) + (1e0 - fill_g / 255e0 - k) / (1e0 - k) + (1e0 - fill_b / 255e0 - k) / (1e0 - k) + k END), 6) AS ink FROM k""",
    "oklab_roundtrip": N + "SELECT doc_id, shape_index, round(sL, 6) AS lightness, round(sA, 6) AS a, round(sB, 6) AS b, format('#{:02x}{:02x}{:02x}', fill_r, fill_g, fill_b) AS hex FROM slab",
    "color_parse": S + """, p AS (SELECT *, (doc_id + shape_index) % 10 AS w FROM shapes) SELECT doc_id, shape_index,
  CASE w WHEN 0 THEN format('#{:02x}{:02x}{:02x}', fill_r, fill_g, fill_b) WHEN 1 THEN format('#{:x}{:x}{:x}', fill_r % 16, fill_g % 16, fill_b % 16)
    WHEN 2 THEN 'rgb(' || fill_r || ', ' || fill_g || ', ' || fill_b || ')' WHEN 3 THEN CASE WHEN fill_r < 128 THEN 'navy' ELSE ' Orange ' END WHEN 4 THEN 'none'
    WHEN 5 THEN 'RGB(' || fill_r || '.5 ' || fill_g || '.5 ' || fill_b || '.5)' WHEN 6 THEN 'rgba(10%, 50%, 120%, .5)' WHEN 7 THEN 'rgb(' || fill_r || 'e0 ' || fill_g || 'e0 ' || fill_b || ' / 50%)'
    WHEN 8 THEN '#abcd' ELSE 'url(#fade)' END AS raw,
  CASE w WHEN 1 THEN fill_r % 16 * 17 WHEN 3 THEN CASE WHEN fill_r < 128 THEN 0 ELSE 255 END WHEN 4 THEN NULL
    WHEN 5 THEN CAST(least(255e0, round_even(fill_r + 0.5e0, 0)) AS INT) WHEN 6 THEN CAST(least(255e0, round_even(10e0 * 2.55e0, 0)) AS INT) WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE fill_r END AS r,
  CASE w WHEN 1 THEN fill_g % 16 * 17 WHEN 3 THEN CASE WHEN fill_r < 128 THEN 0 ELSE 165 END WHEN 4 THEN NULL
    WHEN 5 THEN CAST(least(255e0, round_even(fill_g + 0.5e0, 0)) AS INT) WHEN 6 THEN CAST(least(255e0, round_even(50e0 * 2.55e0, 0)) AS INT) WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE fill_g END AS g,
  CASE w WHEN 1 THEN fill_b % 16 * 17 WHEN 3 THEN CASE WHEN fill_r < 128 THEN 128 ELSE 0 END WHEN 4 THEN NULL
    WHEN 5 THEN CAST(least(255e0, round_even(fill_b + 0.5e0, 0)) AS INT) WHEN 6 THEN CAST(least(255e0, round_even(120e0 * 2.55e0, 0)) AS INT) WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE fill_b END AS b FROM p""",
    "stroke_snap": scale("stroke_width", K.STROKES, "nearest_width"),
    "type_scale_snap": scale("font_size", K.TYPE_SCALE, "nearest_size", "tag = 'text'"),
    "grid_snap": S + GRID,
    "font_whitelist": S + f"SELECT doc_id, shape_index, CASE WHEN font_family IN ({FONTS}) THEN font_family ELSE 'Inter' END AS family, CASE WHEN font_family NOT IN ({FONTS}) THEN 'error' END AS severity FROM shapes WHERE tag = 'text'",
    "min_size": S + "SELECT doc_id, shape_index, tag, round(area, 6) AS area FROM shapes WHERE tag <> 'text' AND area < 16",
    "min_text": S + "SELECT doc_id, shape_index, round(font_size, 6) AS font_size, 24e0 AS raised_to FROM shapes WHERE tag = 'text' AND font_size < 24",
    "hairline": S + "SELECT doc_id, shape_index, round(stroke_width, 6) AS stroke_width, 1e0 AS raised_to FROM shapes WHERE stroke_width < 0.75e0",
    "safe_margin": S + f""", m AS (SELECT *, {clamp("x", "54e0", "(1026e0 - 0.55e0 * font_size * text_len)")} AS nx, {clamp("y", "54e0", "1026e0")} AS ny FROM shapes WHERE tag = 'text')
SELECT doc_id, shape_index, round(nx, 6) AS new_x, round(ny, 6) AS new_y FROM m WHERE nx <> x OR ny <> y""",
    "bleed_check": S + "SELECT doc_id, shape_index, tag FROM shapes WHERE (abs(x0) < 1 OR abs(y0) < 1 OR abs(x1 - 1080) < 1 OR abs(y1 - 1080) < 1) AND NOT (x0 <= -8 AND y0 <= -8 AND x1 >= 1088 AND y1 >= 1088)",
    "canvas_rescale": S + "SELECT doc_id, shape_index, round(x0 * (900e0 / 1080e0) + 350e0, 6) AS x0, round(y0 * (900e0 / 1080e0), 6) AS y0, round(x1 * (900e0 / 1080e0) + 350e0, 6) AS x1, round(y1 * (900e0 / 1080e0), 6) AS y1, round(stroke_width * (900e0 / 1080e0), 6) AS stroke_width FROM shapes",
    "max_colors": S + f"SELECT doc_id, fill_r, fill_g, fill_b, round(usage, 6) AS usage, rank, rank <= {K.MAX_COLORS} AS kept, colors FROM ({COLORS}) WHERE colors > {K.MAX_COLORS}",
    "ink_once_per_color": S + f"SELECT doc_id, min(shape_index) AS shape_index, fill_r, fill_g, fill_b, round(any_value({INK}), 6) AS ink FROM shapes WHERE {INK} > 200 GROUP BY doc_id, fill_r, fill_g, fill_b",
    "text_hierarchy": S + HIERARCHY,
    "layout_balance": L + BALANCE,
    "layout_whitespace": L + WHITE,
    "layout_rhythm": L + """, g AS (SELECT doc_id, y0 - lag(y1) OVER (PARTITION BY doc_id ORDER BY y0, shape_index) AS gap FROM laid)
SELECT doc_id, count(*) AS gaps, count(*) FILTER (abs(gap - round_even(gap / 8e0, 0) * 8e0) > 1) AS off_rhythm FROM g WHERE gap > 0 GROUP BY doc_id HAVING count(*) >= 2""",
    "layout_alignment": L + f"SELECT doc_id, shape_index, round(x0, 6) AS edge, round(target, 6) AS target, n FROM ({ALIGN}) WHERE abs(x0 - target) >= 1e-6",
    "text_collisions": L + f"""SELECT a.doc_id, a.shape_index AS text, b.shape_index AS other, round({SHARED} / greatest(1e-6, least(a.box_area, b.box_area)), 6) AS share,
  CASE WHEN {SHARED} / greatest(1e-6, least(a.box_area, b.box_area)) > 0.25 THEN 'error' ELSE 'warning' END AS severity
FROM laid a JOIN laid b ON a.doc_id = b.doc_id AND a.shape_index < b.shape_index AND a.tag = 'text' AND b.tag = 'text'
  AND a.x0 + 1 < b.x1 - 1 AND b.x0 + 1 < a.x1 - 1 AND a.y0 + 1 < b.y1 - 1 AND b.y0 + 1 < a.y1 - 1""",
    "text_buried": L + f"SELECT a.doc_id, a.shape_index, min(b.shape_index) AS covered_by FROM laid a JOIN laid b ON a.doc_id = b.doc_id AND a.tag = 'text' AND b.tag <> 'text' AND b.opacity >= 0.9e0 AND b.shape_index > a.shape_index WHERE {SHARED} / greatest(1e-6, a.box_area) >= 0.6 GROUP BY a.doc_id, a.shape_index",
    "contrast_audit": N + """, spots AS (SELECT s.*, k, x0 + (x1 - x0) * u AS px, y0 + (y1 - y0) * v AS py FROM slab s, (VALUES (0, 0.5e0, 0.5e0), (1, 0.08e0, 0.5e0), (2, 0.92e0, 0.5e0), (3, 0.5e0, 0.2e0), (4, 0.5e0, 0.8e0)) AS p(k, u, v) WHERE tag = 'text'),
seen AS (SELECT t.doc_id, t.shape_index, t.k, t.font_size, t.slum AS own, arg_max(b.slum, b.shape_index) AS ground
  FROM spots t LEFT JOIN slab b ON b.doc_id = t.doc_id AND b.tag <> 'text' AND b.shape_index < t.shape_index
    AND CASE WHEN b.tag = 'circle' THEN pow(t.px - (b.x0 + b.x1) / 2, 2) + pow(t.py - (b.y0 + b.y1) / 2, 2) <= b.radius * b.radius ELSE t.px BETWEEN b.x0 AND b.x1 AND t.py BETWEEN b.y0 AND b.y1 END
  GROUP BY ALL),
q AS (SELECT *, (greatest(own, coalesce(ground, 1e0)) + 0.05e0) / (least(own, coalesce(ground, 1e0)) + 0.05e0) AS r FROM seen)
SELECT doc_id, shape_index, round(min(r), 6) AS ratio, min(r) < CASE WHEN font_size >= 24 THEN 3e0 ELSE 4.5e0 END AS fails FROM q GROUP BY doc_id, shape_index, font_size""",
    "ring_area": S + """, p AS (SELECT doc_id, x, y, row_number() OVER (PARTITION BY doc_id ORDER BY shape_index) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM shapes)
SELECT a.doc_id, count(*) AS points, sum(a.x * b.y - b.x * a.y) / 2 AS area, abs(sum(a.x * b.y - b.x * a.y) / 2) AS size
FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.k = a.k % a.n + 1 GROUP BY a.doc_id HAVING count(*) >= 3""",
    "palette_report": S + """SELECT doc_id, fill_r, fill_g, fill_b, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS DOUBLE), 6) AS coverage,
  row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, fill_r, fill_g, fill_b) AS rank FROM shapes GROUP BY doc_id, fill_r, fill_g, fill_b""",
    "box_coverage": S + f"SELECT doc_id, count(*) AS boxes, round(least(1e0, sum(area) / {A}e0), 6) AS coverage FROM shapes WHERE tag = 'rect' GROUP BY doc_id",
    "report_score": f"WITH {FINDINGS} SELECT o_orderkey AS doc_id, greatest(0e0, round_even(100e0 - coalesce(lost, 0e0), 1)) AS score, coalesce(n, 0) AS open_findings FROM orders LEFT JOIN (SELECT doc_id, count(*) AS n, sum(CASE severity WHEN 'error' THEN 5e0 WHEN 'warning' THEN 2e0 ELSE 0.5e0 END) AS lost FROM found GROUP BY doc_id) f ON f.doc_id = o_orderkey",
    "report_rollup_by_rule": f"WITH {FINDINGS} SELECT rule, severity, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM found GROUP BY rule, severity",
    "best_attempt": f"WITH {CANDIDATES_SQL} SELECT request, arg_max(candidate, (score_after, -attempt)) AS candidate, arg_max(attempt, (score_after, -attempt)) AS attempt, max(score_after) AS score_after FROM candidates GROUP BY request",
    "candidate_gate": f"WITH {CANDIDATES_SQL} SELECT request, count(*) AS candidates, count(*) FILTER (score_after >= 95) AS passed, CASE WHEN count(*) FILTER (score_after >= 95) > 0 THEN 'Ready' ELSE 'Failed' END AS outcome FROM candidates GROUP BY request",
    "master_pick": f"WITH {CANDIDATES_SQL} SELECT request, candidate, score_after FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score_after >= 95 DESC, score_after DESC, attempt DESC) AS k FROM candidates) WHERE k = 1",
    "stuck_requests": idle("Processing", 120),
    "queue_sweep": idle("Queued", 15),
    "raw_retention": f"WITH {LIFECYCLE_SQL} SELECT request, count(*) AS expired FROM lifecycle WHERE ts < (SELECT max(ts) FROM lifecycle) - INTERVAL 10 DAY GROUP BY request",
    "status_violations": f"""WITH {LIFECYCLE_SQL}, s AS (SELECT *, lag(status) OVER (PARTITION BY request ORDER BY ts, event_id) AS before FROM lifecycle)
SELECT before, status AS after, count(*) AS steps FROM s WHERE before <> status AND (before, status) NOT IN ({", ".join(str(e) for e in K.EDGES)}) GROUP BY before, status""",
    "formats_catalog": f"""WITH {FORMATS}, m AS (SELECT 400e0 + o_orderkey % 1300 AS mw, 400e0 + o_custkey % 1700 AS mh FROM orders)
SELECT f.*, count(*) FILTER (fits) AS derived, count(*) FILTER (NOT fits) AS regenerated
FROM (SELECT name, 1e0 - (mw * least(width / mw, height / mh) * mh * least(width / mw, height / mh)) / (width * height) <= 0.35e0 AS fits FROM m CROSS JOIN formats) x JOIN formats f USING (name) GROUP BY ALL""",
    "campaign_plan": f"""WITH {FORMATS}, m AS (SELECT o_orderkey AS master, 400e0 + o_orderkey % 1300 AS mw, 400e0 + o_custkey % 1700 AS mh FROM orders),
w AS (SELECT master, name AS format, 1e0 - (mw * least(width / mw, height / mh) * mh * least(width / mw, height / mh)) / (width * height) AS waste FROM m CROSS JOIN formats)
SELECT master, format, floor(waste * 10000e0 + 0.5e0) / 10000e0 AS waste, CASE WHEN waste <= 0.35e0 THEN 'derive' ELSE 'regenerate' END AS action FROM w""",
    "grid_flow": """WITH u AS (SELECT p_partkey AS unit, CAST(p_size AS INT) AS n FROM part),
t AS (SELECT unit, n, c, CAST(ceil(n / CAST(c AS DOUBLE)) AS INT) AS r FROM u, unnest(range(1, 15)) AS x(c) WHERE c <= n),
s AS (SELECT *, 1012e0 / c - 12e0 AS cw, 712e0 / r - 12e0 AS ch FROM t),
b AS (SELECT *, round_even(least(cw, ch), 1) AS side, round_even(least(cw, ch) * least(cw, ch) / greatest(1e-6, cw * ch), 3) AS fill FROM s)
SELECT unit, n, CAST(arg_max(c, (side, fill, -c)) AS INT) AS cols, arg_max(r, (side, fill, -c)) AS rows, max(side) AS cell, max(side) >= 60 AS fits FROM b GROUP BY unit, n""",
}
