"""Checks that need one shape: narrow projections over the shapes table, no exchange.

Each takes the shapes table and returns a row for every shape (or every offending shape); severity is that of the finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.scalars import first_least, is_step, least_at_least, nearest, snap
from ..plans import catalog as K
from ..sources.bridge import CANVAS

KEYS = ("doc_id", "shape_index")
FILL = ("fill_r", "fill_g", "fill_b")


def _fill() -> C.RGB:
    return C.RGB.of("fill_")


def _token_structs(lab, allowed=None) -> Column:
    """Distance and place of every token (or of those allowed, as a condition for each), for the row's colour."""
    out = [C.distance(lab, C.oklab(C.RGB.lit(t[1:4]))) for t in K.TOKENS]
    return first_least(out if allowed is None else [F.when(allowed(t[4]), d) for t, d in zip(K.TOKENS, out, strict=True)])


def _named(i: Column, k: int = 0) -> Column:
    return F.element_at(F.array(*[F.lit(t[k]) for t in K.TOKENS]), i + 1)


def palette_snap(shapes: DataFrame) -> DataFrame:
    """The nearest token of every fill, the first of equals, with its distance and the finding's severity."""
    lab = shapes.select(*KEYS, *FILL, *[v.alias(k) for k, v in zip(("L", "A", "B"), C.oklab(_fill()), strict=True)])
    found = lab.select(*KEYS, *FILL, _token_structs((F.col("L"), F.col("A"), F.col("B"))).alias("t"))
    exact = F.lit(False)
    for _, r, g, b, _ in K.TOKENS:
        exact = exact | ((F.col("fill_r") == r) & (F.col("fill_g") == g) & (F.col("fill_b") == b))
    severity = F.when(exact, F.lit(None)).when(F.col("t.d") <= K.SNAP_WARNING, "warning").otherwise("error")
    return found.select(*KEYS, _named(F.col("t.i")).alias("token"), F.round("t.d", 6).alias("dist"), severity.alias("severity"))


def palette_snap_strokes(shapes: DataFrame) -> DataFrame:
    """The nearest token of every stroke's colour that is none itself, with the finding's severity."""
    stroke = C.RGB.of("stroke_")
    lab = shapes.filter("stroke_width > 0").select(*KEYS, "stroke_r", "stroke_g", "stroke_b", *[v.alias(k) for k, v in zip(("L", "A", "B"), C.oklab(stroke), strict=True)])
    found = lab.select(*KEYS, C.to_hex(stroke).alias("stroke"), _token_structs((F.col("L"), F.col("A"), F.col("B"))).alias("t"))
    off = found.select(*KEYS, "stroke", F.explode(F.array_compact(F.array(F.when(F.col("t.d") > 0, F.col("t"))))).alias("t"))  # a filter would compute it a second time
    return off.select(*KEYS, "stroke", _named(F.col("t.i")).alias("token"), F.round("t.d", 6).alias("dist"), F.when(F.col("t.d") <= K.SNAP_WARNING, "warning").otherwise("error").alias("severity"))


def palette_snap_roles(shapes: DataFrame, canvas: float = CANVAS * CANVAS) -> DataFrame:
    """The nearest token among those whose role suits the shape: text, large area, any."""
    share = F.col("area") / canvas
    text, large = F.col("tag") == "text", F.coalesce(share >= K.LARGE_AREA, F.lit(False))
    lab = shapes.select(*KEYS, "tag", "area", *[v.alias(k) for k, v in zip(("L", "A", "B"), C.oklab(_fill()), strict=True)])

    def allowed(role: str) -> Column:
        of_text, of_surface = role in K.TEXT_ROLES + K.ACCENT_ROLES, role in K.SURFACE_ROLES + K.TEXT_ROLES
        return F.when(text, F.lit(of_text)).when(large, F.lit(of_surface)).otherwise(F.lit(True))

    found = lab.select(*KEYS, "tag", _token_structs((F.col("L"), F.col("A"), F.col("B")), allowed).alias("t"))
    return found.select(*KEYS, "tag", _named(F.col("t.i")).alias("token"), _named(F.col("t.i"), 4).alias("role"), F.round("t.d", 6).alias("dist"))


def contrast_pairs(shapes: DataFrame) -> DataFrame:
    """Contrast of every fill with white and with ink, and the best token on it."""
    own = shapes.select(*KEYS, C.luminance(_fill()).alias("lum"))
    light = [C.luminance(C.RGB.lit(t[1:4])) for t in K.TOKENS]
    ratio = [C.contrast(F.col("lum"), v) for v in light]
    best = F.array_max(F.array(*[F.struct(r.alias("r"), F.lit(-i).alias("i")) for i, r in enumerate(ratio)]))
    return own.select(*KEYS, F.round(ratio[6], 6).alias("on_white"), F.round(ratio[3], 6).alias("on_ink"), _named(-best["i"]).alias("best_token"), F.round(best["r"], 6).alias("best_ratio"))


def cmyk_ink(shapes: DataFrame) -> DataFrame:
    c, m, y, k = C.cmyk(_fill())
    return shapes.select(*KEYS, *[F.round(v, 6).alias(n) for n, v in zip("cmyk", (c, m, y, k), strict=True)], F.round(C.total_ink(_fill()), 6).alias("ink"))


def oklab_roundtrip(shapes: DataFrame) -> DataFrame:
    """OKLab of the fill, rounded in IEEE arithmetic so that a small negative keeps its sign, and the colour read back from it."""
    lab = shapes.select(*KEYS, *FILL, *[v.alias(k) for k, v in zip(("L", "A", "B"), C.oklab(_fill()), strict=True)])
    back = C.from_oklab((F.col("L"), F.col("A"), F.col("B")))
    return lab.select(*KEYS, *[(F.rint(F.col(k) * 1e6) / 1e6).alias(n) for k, n in (("L", "lightness"), ("A", "a"), ("B", "b"))], C.to_hex(C.RGB(*back)).alias("hex"))


def color_parse(shapes: DataFrame) -> DataFrame:
    """Colours written in ten ways, read back."""
    r, g, b = (F.col(c) for c in FILL)
    short = F.concat(F.lit("#"), *[F.lower(F.hex((c % 16).cast("long"))) for c in (r, g, b)])
    joined = lambda head, between, tail: F.concat(F.lit(head), r.cast("string"), F.lit(between), g.cast("string"), F.lit(between), b.cast("string"), F.lit(tail))
    ways = [
        C.to_hex(C.RGB(r, g, b)), short, joined("rgb(", ", ", ")"), F.when(r < 128, "navy").otherwise(" Orange "), F.lit("none"), joined("RGB(", ".5 ", ".5)"),
        F.lit("rgba(10%, 50%, 120%, .5)"), joined("rgb(", "e0 ", " / 50%)"), F.lit("#abcd"), F.lit("url(#fade)"),
    ]
    raw = F.element_at(F.array(*ways), ((F.col("doc_id") + F.col("shape_index")) % 10 + 1).cast("int"))
    p = shapes.select(*KEYS, raw.alias("raw")).select(*KEYS, "raw", C.parse(F.col("raw")).alias("p"))
    return p.select(*KEYS, "raw", F.col("p.r").alias("r"), F.col("p.g").alias("g"), F.col("p.b").alias("b"))


def _scaled(shapes: DataFrame, column: str, scale: tuple[float, ...], out: str) -> DataFrame:
    rows = shapes.select(*KEYS, column, nearest(F.col(column), scale).alias(out))
    off = F.abs(F.col(column) - F.col(out)) > F.greatest(F.abs(column), F.abs(out)) * 1e-9
    return rows.select(*KEYS, F.round(column, 6).alias(column), out, off.alias("off_scale"))


def stroke_snap(shapes: DataFrame) -> DataFrame:
    return _scaled(shapes, "stroke_width", K.STROKES, "nearest_width")


def type_scale_snap(shapes: DataFrame) -> DataFrame:
    return _scaled(shapes.filter("tag = 'text'"), "font_size", K.TYPE_SCALE, "nearest_size")


def _snapped(grid: float) -> tuple[dict[str, Column], Column]:
    """Positions on the grid, sizes too for rectangles, and whether any of them was off it."""
    size = lambda c: F.when(F.col("tag") == "rect", F.col(c)).when((F.col("tag") == "circle") & F.lit(c == "width"), F.col("radius"))
    cols = {"x": F.col("x"), "y": F.col("y"), "w": size("width"), "h": size("height")}
    snapped = {k: snap(v, grid) for k, v in cols.items()}
    off = F.lit(False)
    for k, v in cols.items():
        off = off | F.coalesce(F.abs(snapped[k] - v) > 1e-6, F.lit(False))
    return snapped, off


def grid_snap(shapes: DataFrame, grid: float = K.GRID) -> DataFrame:
    """Positions on the grid, sizes too for rectangles; ties go to even steps."""
    snapped, off = _snapped(grid)
    return shapes.select(*KEYS, "tag", *[v.alias(f"{k}_snapped") for k, v in snapped.items()], off.alias("off_grid"))


def local_findings(shapes: DataFrame, grid: float = K.GRID, least: float = K.MIN_SIZE) -> DataFrame:
    """doc_id, shape_index, rule, severity of the checks that need one shape: all in one pass over the shapes."""
    lab = C.with_oklab(shapes, _fill())
    near = lab.withColumn("d", _token_structs((F.col("L"), F.col("A"), F.col("B")))["d"])
    exact = F.lit(False)
    for _, r, g, b, _ in K.TOKENS:
        exact = exact | ((F.col("fill_r") == r) & (F.col("fill_g") == g) & (F.col("fill_b") == b))

    text = F.col("tag") == "text"
    family = F.when(text & F.col("font_family").isNull(), "warning").when(text & ~F.col("font_family").isin(*K.FONTS), "error")
    found = {
        "color.palette": F.when(~exact, F.when(F.col("d") <= K.SNAP_WARNING, "warning").otherwise("error")), "geometry.min-size": F.when(~text & (F.col("area") < least * least), "info"),
        "geometry.stroke-width": F.when(~is_step(F.col("stroke_width"), K.STROKES), "warning"), "geometry.grid": F.when(_snapped(grid)[1], "warning"), "type.font": family, "type.scale": F.when(text & ~is_step(F.col("font_size"), K.TYPE_SCALE), "warning"),
    }
    # Severities first, as plain columns, and a filter on the rows: the array's own filter would be evaluated row by row outside compiled code.
    ready = near.select(*KEYS, *[v.alias(f"_{i}") for i, v in enumerate(found.values())])
    each = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"_{i}").alias("severity")) for i, k in enumerate(found)])
    return ready.select(*KEYS, F.explode(each).alias("f")).select(*KEYS, "f.rule", "f.severity").filter("severity IS NOT NULL")


def font_whitelist(shapes: DataFrame) -> DataFrame:
    ok = F.col("font_family").isin(*K.FONTS)
    severity = F.when(F.col("font_family").isNull(), "warning").when(~ok, "error")
    return shapes.filter("tag = 'text'").select(*KEYS, F.when(ok, F.col("font_family")).otherwise(K.FONTS[0]).alias("family"), severity.alias("severity"))


def min_size(shapes: DataFrame, least: float = K.MIN_SIZE) -> DataFrame:
    """Shapes too small to print; unknown areas are never too small."""
    return shapes.filter((F.col("tag") != "text") & (F.col("area") < least * least)).select(*KEYS, "tag", F.round("area", 6).alias("area"))


def min_text(shapes: DataFrame, form: str = "instagram-post") -> DataFrame:
    floor = K.format_named(form).min_text
    return shapes.filter((F.col("tag") == "text") & (F.col("font_size") < floor)).select(*KEYS, F.round("font_size", 6).alias("font_size"), F.lit(least_at_least(floor, K.TYPE_SCALE)).alias("raised_to"))


def hairline(shapes: DataFrame, floor: float = K.MIN_PRINT_STROKE) -> DataFrame:
    return shapes.filter(F.col("stroke_width") < floor).select(*KEYS, F.round("stroke_width", 6).alias("stroke_width"), F.lit(least_at_least(floor, K.STROKES)).alias("raised_to"))


def safe_margin(shapes: DataFrame, form: str = "instagram-post", grid: float = K.GRID) -> DataFrame:
    """Text moved into the safe area of a format; centred where it cannot fit, on the grid where that stays inside."""
    margin = K.format_named(form).margin * CANVAS
    wide = F.lit(0.55) * F.col("font_size") * F.col("text_len")

    def clamp(v: Column, lo: Column, hi: Column) -> Column:
        out = F.least(F.greatest(v, lo), hi)
        step = F.bround(out / grid) * grid
        up = F.when(step < lo, step + grid).otherwise(step)
        down = F.when(up > hi, up - grid).otherwise(up)
        return F.when(lo > hi, (lo + hi) / 2).when(out == v, out).when((down >= lo) & (down <= hi), down).otherwise(out)

    nx = clamp(F.col("x"), F.lit(margin), F.lit(CANVAS - margin) - wide)
    ny = clamp(F.col("y"), F.lit(margin), F.lit(CANVAS - margin))
    rows = shapes.filter("tag = 'text'").select(*KEYS, "x", "y", nx.alias("nx"), ny.alias("ny"))
    return rows.filter("nx <> x OR ny <> y").select(*KEYS, F.round("nx", 6).alias("new_x"), F.round("ny", 6).alias("new_y"))


def bleed_check(shapes: DataFrame, bleed: float = 9.0) -> DataFrame:
    """Shapes that reach an edge of the canvas without running out into the bleed on all sides."""
    c = F.col
    near = (F.abs(c("x0")) < 1) | (F.abs(c("y0")) < 1) | (F.abs(c("x1") - CANVAS) < 1) | (F.abs(c("y1") - CANVAS) < 1)
    out = (c("x0") <= 1 - bleed) & (c("y0") <= 1 - bleed) & (c("x1") >= CANVAS + bleed - 1) & (c("y1") >= CANVAS + bleed - 1)
    return shapes.filter(near & ~out).select(*KEYS, "tag")


def canvas_rescale(shapes: DataFrame, form: str = "x-post") -> DataFrame:
    """Bounds after the uniform scale and centring that fits the canvas into a format."""
    f = K.format_named(form)
    s = min(f.width / CANVAS, f.height / CANVAS)
    dx, dy = (f.width - CANVAS * s) / 2, (f.height - CANVAS * s) / 2
    moved = {k: F.round(F.col(k) * s + d, 6) for k, d in (("x0", dx), ("y0", dy), ("x1", dx), ("y1", dy))}
    return shapes.select(*KEYS, *[v.alias(k) for k, v in moved.items()], F.round(F.col("stroke_width") * s, 6).alias("stroke_width"))
