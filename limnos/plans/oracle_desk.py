"""SQL that the desk's and the geometry queries are held against."""

from __future__ import annotations

from ..operators import desk as D
from ..sources.bridge import CANDIDATES_SQL
from ..sources.desk import sql
from . import catalog as K
from .oracle import FONTS, LABS, SHAPES_SQL, lab_of, num

PAGE = f"WITH {SHAPES_SQL} "
SCOPES = ", ".join(f"'{s}'" for s in D.SCOPES)
STEMS = "list_filter(list_transform(string_split(replace(coalesce(artifacts, ''), chr(10), ','), ','), lambda s: trim(s)), lambda s: s <> '')"
ONCE = f"list_filter({STEMS}, lambda s, i: list_position({STEMS}, s) = i)"
ASSETS = "CASE trim(coalesce(asset_type, '')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.ASSETS.items()) + " END"
REVIEWS = f"""{CANDIDATES_SQL}, {sql("approvals")}, r AS (SELECT a.candidate, request, creation, decision,
  length(token) >= {D.TOKEN_LEAST} AND NOT coalesce((SELECT max(o_orderdate) FROM orders) >= linked_on + INTERVAL {D.LINK_DAYS} DAY, false) AS usable
  FROM desk_approvals a JOIN candidates c ON a.candidate = c.candidate),
reviews AS (SELECT *, usable AND decision IN ({", ".join(f"'{d}'" for d in D.DECISIONS)}) AS counts FROM r)"""


def usable(c: str) -> str:
    v = f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
    marked = " OR ".join([f"{v} = ''", *[f"starts_with({v}, '{m}')" for m in D.MARKERS]])
    return f"(CASE WHEN NOT ({marked}) THEN trim(string_split({v}, chr(10))[1]) END)"


def product(m: str, n: str, x: str) -> str:
    """One entry of the product of two maps whose entries are columns with these prefixes."""
    return {
        "a": f"{m}a * {n}a + {m}c * {n}b", "b": f"{m}b * {n}a + {m}d * {n}b", "c": f"{m}a * {n}c + {m}c * {n}d", "d": f"{m}b * {n}c + {m}d * {n}d",
        "e": f"{m}a * {n}e + {m}c * {n}f + {m}e", "f": f"{m}b * {n}e + {m}d * {n}f + {m}f",
    }[x]


COS, SIN = "cos(radians({0}e0))", "sin(radians({0}e0))"
FIRST = {
    "a": f"CASE k WHEN 1 THEN 1.5e0 WHEN 2 THEN {COS.format(30)} ELSE 1e0 END", "b": f"CASE k WHEN 2 THEN {SIN.format(30)} WHEN 4 THEN 0.5e0 ELSE 0e0 END",
    "c": f"CASE k WHEN 2 THEN -{SIN.format(30)} ELSE 0e0 END", "d": f"CASE k WHEN 1 THEN 1.5e0 WHEN 2 THEN {COS.format(30)} ELSE 1e0 END",
    "e": f"CASE k WHEN 0 THEN round(x, 1) WHEN 2 THEN 540e0 - 540e0 * {COS.format(30)} + 540e0 * {SIN.format(30)} WHEN 3 THEN 10e0 WHEN 4 THEN 3e0 ELSE 0e0 END",
    "f": f"CASE k WHEN 0 THEN round(y, 1) WHEN 2 THEN 540e0 - 540e0 * {SIN.format(30)} - 540e0 * {COS.format(30)} WHEN 3 THEN 20e0 WHEN 4 THEN 4e0 ELSE 0e0 END",
}
SECOND = {
    "a": f"CASE k WHEN 3 THEN {COS.format(45)} ELSE 1e0 END", "b": f"CASE k WHEN 3 THEN {SIN.format(45)} ELSE 0e0 END",
    "c": f"CASE k WHEN 3 THEN -{SIN.format(45)} WHEN 4 THEN tan(radians(10e0)) ELSE 0e0 END", "d": f"CASE k WHEN 3 THEN {COS.format(45)} ELSE 1e0 END", "e": "0e0", "f": "0e0",
}
MAPS = f"""{SHAPES_SQL}, t0 AS (SELECT *, shape_index % 5 AS k FROM shapes),
t1 AS (SELECT *, {", ".join(f"{v} AS f{k}" for k, v in FIRST.items())}, {", ".join(f"{v} AS s{k}" for k, v in SECOND.items())} FROM t0),
t AS (SELECT doc_id, shape_index, x, y, {", ".join(f"{product('f', 's', k)} AS m{k}" for k in "abcdef")} FROM t1)"""
HYPOT = "sqrt({0} * {0} + {1} * {1})"
SX, SY = HYPOT.format("ma", "mb"), HYPOT.format("mc", "md")
RING = """ring AS (SELECT * FROM (SELECT doc_id, shape_index, x, y, count(*) OVER (PARTITION BY doc_id) AS places,
  coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny,
  coalesce(lag(x) OVER w, last_value(x) OVER u) AS px, coalesce(lag(y) OVER w, last_value(y) OVER u) AS py FROM shapes
  WINDOW w AS (PARTITION BY doc_id ORDER BY shape_index), u AS (PARTITION BY doc_id ORDER BY shape_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE places >= 3)"""
CUBIC = "((1 - t) * (1 - t) * (1 - t) * {0} + 3 * (1 - t) * (1 - t) * t * {1} + 3 * (1 - t) * t * t * {2} + t * t * t * {3})"
QUADRATIC = "((1 - t) * (1 - t) * {0} + 2 * (1 - t) * t * {1} + t * t * {2})"
CURVES = {"cx": CUBIC.format("x0", "(x1 * 2 - x0)", "(x0 * 2 - x1)", "x1"), "cy": CUBIC.format("y0", "y0", "y1", "y1"), "qx": QUADRATIC.format("x0", "(x1 * 2 - x0)", "x0"), "qy": QUADRATIC.format("y0", "y0", "y1")}
STEPS = "[" + ", ".join(num(s) for s in K.TYPE_SCALE) + "]"


def nearest(column: str, steps) -> str:
    """The nearest of a few steps, the first of equals."""
    least = ", ".join(f"abs({column} - {num(s)})" for s in steps)
    return "CASE " + " ".join(f"WHEN abs({column} - {num(s)}) = least({least}) THEN {num(s)}" for s in steps) + " END"


SQL = {
    "request_validation": f"""WITH {sql("requests")} SELECT request, CAST(greatest(1, least({D.MOST_CANDIDATES}, coalesce(TRY_CAST(n_asked AS INT), 1))) AS INT) AS n_candidates,
  coalesce(mode_asked, 'Uploaded Artwork') AS source_mode, coalesce(upload_bytes <= {D.UPLOAD_CAP}, true) AS within_cap,
  coalesce(trim(prompt) <> '', false) AND coalesce(upload_bytes <= {D.UPLOAD_CAP}, true) AS valid FROM desk_requests""",
    "document_validation": f"""WITH {sql("documents")} SELECT request, CASE WHEN coalesce(trim(business_name), '') = '' THEN 'name' WHEN scope NOT IN ({SCOPES}) THEN 'scope'
  WHEN len({STEMS}) > 0 AND scope <> 'Full Suite' THEN 'selection' END AS problem, array_to_string({ONCE}, '|') AS stems,
  scope IN ('Pitch Deck', 'Financial Model') OR (render_asked AND scope = 'Full Suite') AS renders FROM desk_documents""",
    "document_outputs": f"""WITH {sql("documents")}, f AS (SELECT unnest([{", ".join(f"'{p}'" for p in D.FILES)}]) AS path)
SELECT request, path, CASE WHEN ends_with(path, '.pptx') THEN 'deck' WHEN ends_with(path, '.xlsx') THEN 'model' ELSE 'document' END AS kind FROM desk_documents, f
WHERE scope = 'Full Suite' OR (scope = 'Plan Chapters' AND ends_with(path, '.md')) OR (scope = 'Pitch Deck' AND ends_with(path, '.pptx')) OR (scope = 'Financial Model' AND ends_with(path, '.xlsx'))""",
    "brief_plan": f"""WITH {sql("briefs")} SELECT brief, format, brief || ' -> ' || format || CASE WHEN trim(headline) <> '' THEN ': ' || trim(headline) ELSE '' END AS line
FROM (SELECT *, {ASSETS} AS format FROM desk_briefs) WHERE format IS NOT NULL""",
    "brief_skips": f"""WITH {sql("briefs")} SELECT brief, CASE WHEN trim(asset_type) <> '' THEN asset_type ELSE '(missing)' END AS asset_type FROM desk_briefs WHERE {ASSETS} IS NULL""",
    "approval_lookup": f"WITH {REVIEWS} SELECT candidate, request, usable, counts FROM reviews",
    "selected_candidate": f"WITH {REVIEWS} SELECT request, arg_max(candidate, (creation, candidate)) AS candidate, 'Delivered' AS status FROM reviews WHERE counts AND decision = 'Approved' GROUP BY request",
    "candidate_revisions": f"""WITH {CANDIDATES_SQL} SELECT request, candidate, lead(creation) OVER w AS replaced_at, lead(candidate) OVER w IS NULL AS current
FROM candidates WINDOW w AS (PARTITION BY request ORDER BY attempt)""",
    "campaign_status": f"""WITH {CANDIDATES_SQL}, {sql("requests")}, f AS (SELECT customer AS campaign, [{", ".join(f"'{x.name}'" for x in K.FORMATS)}][CAST(request % {len(K.FORMATS)} AS INT) + 1] AS format,
  CASE WHEN raw_status = 'F' THEN 'Failed' WHEN c.candidate IS NOT NULL THEN 'Ready' ELSE 'Pending' END AS state
  FROM desk_requests r LEFT JOIN (SELECT candidate FROM candidates WHERE score_after >= 40) c ON c.candidate = r.request),
n AS (SELECT campaign, format, state, count(*) AS n FROM f GROUP BY ALL)
SELECT campaign, string_agg(format || ':' || state || ':' || n, ',' ORDER BY format || ':' || state || ':' || n) AS formats, CAST(sum(n) AS BIGINT) AS requests,
  CAST(sum(CASE WHEN state = 'Ready' THEN n ELSE 0 END) AS BIGINT) AS ready FROM n GROUP BY campaign""",
    "system_problems": f"""WITH {sql("systems")}, p AS (SELECT system, list_filter([CASE WHEN token_hex IS NULL THEN 'no color token' END,
  CASE WHEN NOT regexp_matches(token_hex, '{D.HEX}') THEN 'color token ' || token_hex END, CASE WHEN seed <> '' AND NOT regexp_matches(seed, '{D.HEX}') THEN 'seed color ' || seed END,
  CASE WHEN len(list_filter(string_split(coalesce(type_scale, ''), ','), lambda x: trim(x) <> '' AND TRY_CAST(trim(x) AS DOUBLE) IS NULL)) > 0 THEN 'type scale ' || type_scale END], lambda x: x IS NOT NULL) AS p FROM desk_systems)
SELECT system, array_to_string(p, '; ') AS problems FROM p WHERE len(p) > 0""",
    "default_system": f"""WITH {sql("systems")}, own AS (SELECT owner, min(system) AS by_owner FROM desk_systems WHERE is_default GROUP BY owner)
SELECT c_custkey AS profile, coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 7 END, by_owner, (SELECT min(system) FROM desk_systems WHERE is_default AND owner % 2 = 0), (SELECT min(system) FROM desk_systems)) AS system
FROM customer LEFT JOIN own ON owner = c_nationkey""",
    "profile_slots": f"""WITH {sql("profiles")} SELECT profile, coalesce({usable("trading_name")}, {usable("company_name")}) AS business_name,
  coalesce({usable("vision")}, {usable("proposition")}) AS heading, {usable("proposition")} AS tagline FROM desk_profiles""",
    "latest_requests": f"WITH {sql('requests')} SELECT request, creation FROM desk_requests WHERE raw_status = 'F' ORDER BY creation DESC, request LIMIT 20",
    "transform_parse": f"WITH {MAPS} SELECT doc_id, shape_index, {', '.join(f'round(m{k}, 6) AS m{k}' for k in 'abcdef')} FROM t",
    "transform_measures": f"""WITH {MAPS} SELECT doc_id, shape_index, round(ma * x + mc * y + me, 4) AS px, round(mb * x + md * y + mf, 4) AS py, round(({SX} + {SY}) / 2, 6) AS scale, round(degrees(atan2(mb, ma)), 6) AS rotation,
  abs(ma - 1) <= 1e-9 AND abs(mb) <= 1e-9 AND abs(mc) <= 1e-9 AND abs(md - 1) <= 1e-9 AND abs(me) <= 1e-9 AND abs(mf) <= 1e-9 AS identity,
  abs(mb) <= 1e-6 AND abs(mc) <= 1e-6 AS axis_aligned, abs({SX} - {SY}) <= 1e-6 * greatest(1e0, {SX}) AS uniform FROM t""",
    "curve_bounds": PAGE + f""", p AS (SELECT doc_id, shape_index, {", ".join(f"{v} AS {k}" for k, v in CURVES.items())} FROM shapes, (SELECT i / 4e0 AS t FROM range(5) AS r(i)))
SELECT doc_id, shape_index, {", ".join(f"round({f}({k}), 6) AS {k}_{n}" for k in CURVES for n, f in (("lo", "min"), ("hi", "max")))} FROM p GROUP BY doc_id, shape_index""",
    "ring_turns": PAGE + f""", {RING}, d AS (SELECT *, x - px AS ax, y - py AS ay, nx - x AS bx, ny - y AS by_, nx - px AS dx, ny - py AS dy, abs(atan2(ny - y, nx - x) - atan2(y - py, x - px)) AS raw FROM ring)
SELECT doc_id, shape_index, round(degrees(CASE WHEN raw > pi() THEN 2 * pi() - raw ELSE raw END), 6) AS turn,
  round(CASE WHEN dx = 0 AND dy = 0 THEN sqrt(ax * ax + ay * ay) ELSE abs(dx * (py - y) - dy * (px - x)) / sqrt(dx * dx + dy * dy) END, 6) AS away, ax * by_ - ay * bx = 0 AND ax * bx + ay * by_ >= 0 AS straight FROM d""",
    "ring_hits": PAGE + f""", {RING} SELECT doc_id, count(*) FILTER ((y > 540) <> (ny > 540) AND 540 < x + (540 - y) / nullif(ny - y, 0) * (nx - x)) AS crossings,
  count(*) FILTER ((y > 540) <> (ny > 540) AND 540 < x + (540 - y) / nullif(ny - y, 0) * (nx - x)) % 2 = 1 AS inside FROM ring GROUP BY doc_id""",
    "text_fit": PAGE + f""", f AS (SELECT doc_id, shape_index, list_max(list_filter({STEPS}, lambda s: s * 0.58e0 * text_len <= width * 2 AND s * (0.8e0 + 0.2e0) <= height AND s <= font_size)) AS best FROM shapes WHERE tag = 'text')
SELECT doc_id, shape_index, coalesce(best, 12e0) AS fitted, best IS NULL AS overflows FROM f""",
    "lch_values": PAGE + f""", u AS (SELECT DISTINCT fill_r, fill_g, fill_b FROM shapes), l AS (SELECT *, {", ".join(f"{e} AS {k}" for e, k in zip(lab_of(("fill_r", "fill_g", "fill_b")), ("ll", "la", "lb"), strict=True))} FROM u)
SELECT fill_r, fill_g, fill_b, round(ll, 5) AS lightness, round(sqrt(la * la + lb * lb), 5) AS chroma, format('#{{:02x}}{{:02x}}{{:02x}}', fill_r, fill_g, fill_b) AS hex FROM l""",
    "paint_operators": PAGE + """, u AS (SELECT DISTINCT fill_r, fill_g, fill_b FROM shapes), p AS (SELECT *, printf('%.4f %.4f %.4f', fill_r / 255e0, fill_g / 255e0, fill_b / 255e0) AS rgb FROM u)
SELECT fill_r, fill_g, fill_b, rgb || ' rg' AS fill, rgb || ' RG' AS stroke, 37.8e0 AS slug FROM p""",
    "font_matches": PAGE + """, a AS (SELECT doc_id, shape_index, CASE (doc_id + shape_index) % 5 WHEN 0 THEN font_family WHEN 1 THEN upper(font_family) || '!' WHEN 2 THEN 'Sans-Serif' WHEN 3 THEN '--' ELSE 'Inter Tight' END AS asked,
  CASE WHEN shape_index % 2 = 0 THEN 'DejaVu Sans, Comic Sans MS Bold' ELSE ' Inter ,,Arial' END AS found FROM shapes WHERE tag = 'text')
SELECT *, CASE asked WHEN '--' THEN false WHEN 'Sans-Serif' THEN true WHEN 'Inter Tight' THEN found LIKE '%Inter%' ELSE found LIKE '%' || CASE WHEN lower(asked) LIKE 'inter%' THEN 'Inter' ELSE 'Comic Sans MS' END || '%' END AS same FROM a""",
    "font_names": PAGE + f"SELECT doc_id, shape_index, font_family AS family, replace(lower(font_family), ' ', '') AS plain, font_family IN ({FONTS}) AS known FROM shapes WHERE tag = 'text'",
    "comply_shapes": f"""WITH {LABS}, own AS (SELECT doc_id, shape_index, arg_min(name, (d, i)) AS token FROM near GROUP BY ALL),
r AS (SELECT *, {nearest("stroke_width", K.STROKES)} AS new_stroke, round_even(x / 8e0, 0) * 8e0 AS new_x, round_even(y / 8e0, 0) * 8e0 AS new_y,
  CASE WHEN tag = 'text' THEN CASE WHEN font_family IN ({FONTS}) THEN font_family ELSE 'Inter' END END AS new_family, CASE WHEN tag = 'text' THEN {nearest("font_size", K.TYPE_SCALE)} END AS new_size FROM shapes)
SELECT r.doc_id, r.shape_index, token, new_stroke, new_x, new_y, new_family, new_size,
  CAST(abs(stroke_width - new_stroke) > 1e-6 AS INT) + CAST(abs(x - new_x) > 1e-6 AS INT) + CAST(abs(y - new_y) > 1e-6 AS INT) + coalesce(CAST(abs(font_size - new_size) > 1e-6 AS INT), 0) + coalesce(CAST(font_family <> new_family AS INT), 0) AS repairs
FROM r JOIN own ON own.doc_id = r.doc_id AND own.shape_index = r.shape_index""",
}

__all__ = ["SQL"]
