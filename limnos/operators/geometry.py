"""Geometry of shapes and of the rings through them: transforms, curves, turns, hits, fitted text, local repairs.

Transforms, curves, fitted text and repairs are projections; rings take one exchange by document. Nulls in a position leave a shape out of
its ring; documents with fewer than three places have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import matrix as M
from ..functions.scalars import families_match, family, format_mm, nearest, snap
from ..plans import catalog as K
from ..sources.bridge import ADVANCE, ASCENT, CANVAS, DESCENT
from . import rules
from .rules import KEYS


def with_transform(shapes: DataFrame) -> DataFrame:
    """Shapes with a transform list, written in five ways."""
    x, y = (F.col(k).cast("decimal(18,1)").cast("string") for k in "xy")
    k = F.col("shape_index") % 5
    text = F.when(k == 0, F.concat(F.lit("translate("), x, F.lit(" "), y, F.lit(")"))).when(k == 1, "scale(1.5)").when(k == 2, "rotate(30, 540, 540)").when(k == 3, "translate(10,20) rotate(45)").otherwise("matrix(1 0.5 0 1 3 4), skewX(10)")
    return shapes.withColumn("transform", text)


def transform_parse(shapes: DataFrame) -> DataFrame:
    m = with_transform(shapes).select(*KEYS, M.parse(F.col("transform")).alias("m"))
    return m.select(*KEYS, *[F.round(F.col("m")[k], 6).alias("m" + k) for k in "abcdef"])


def transform_measures(shapes: DataFrame) -> DataFrame:
    """Where a transform puts a shape's position, how it scales and turns, and what it keeps."""
    m = M.Matrix.read(F.col("m"))
    px, py = m.apply(F.col("x"), F.col("y"))
    rows = with_transform(shapes).select(*KEYS, "x", "y", M.parse(F.col("transform")).alias("m"))
    return rows.select(
        *KEYS, F.round(px, 4).alias("px"), F.round(py, 4).alias("py"), F.round(m.scale_factor(), 6).alias("scale"), F.round(m.rotation(), 6).alias("rotation"),
        m.is_identity().alias("identity"), m.is_axis_aligned().alias("axis_aligned"), m.is_uniform_scale().alias("uniform"),
    )


def cubic(t: Column, p: tuple) -> Column:
    u = 1 - t
    return u * u * u * p[0] + 3 * u * u * t * p[1] + 3 * u * t * t * p[2] + t * t * t * p[3]


def quadratic(t: Column, p: tuple) -> Column:
    u = 1 - t
    return u * u * p[0] + 2 * u * t * p[1] + t * t * p[2]


def curve_bounds(shapes: DataFrame, samples: int = 4) -> DataFrame:
    """Bounds of the sampled cubic and quadratic curves across a shape's box, the start included."""
    c = F.col
    steps = F.sequence(F.lit(0), F.lit(samples))
    at = lambda f, p: F.transform(steps, lambda i: f(i.cast("double") / samples, p))
    curves = {"cx": at(cubic, (c("x0"), c("x1") * 2 - c("x0"), c("x0") * 2 - c("x1"), c("x1"))), "cy": at(cubic, (c("y0"), c("y0"), c("y1"), c("y1"))), "qx": at(quadratic, (c("x0"), c("x1") * 2 - c("x0"), c("x0"))), "qy": at(quadratic, (c("y0"), c("y0"), c("y1")))}
    rows = shapes.select(*KEYS, *[v.alias(k) for k, v in curves.items()])
    return rows.select(*KEYS, *[F.round(f(k), 6).alias(f"{k}_{n}") for k in curves for n, f in (("lo", F.array_min), ("hi", F.array_max))])


def _ring(shapes: DataFrame) -> DataFrame:
    """Places of a document in order, each with the one before and the one after around the ring."""
    w = Window.partitionBy("doc_id").orderBy("shape_index")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = {f"n{k}": F.coalesce(F.lead(k).over(w), F.first(k).over(whole)) for k in "xy"} | {f"p{k}": F.coalesce(F.lag(k).over(w), F.last(k).over(whole)) for k in "xy"}
    placed = shapes.filter("x IS NOT NULL AND y IS NOT NULL").select(*KEYS, "x", "y")
    return placed.withColumns(cols | {"places": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))}).filter("places >= 3")


def ring_turns(shapes: DataFrame) -> DataFrame:
    """At every place of the ring the turn in degrees, the distance from the line of its neighbours, and whether it can be left out."""
    c = F.col
    ax, ay, bx, by = c("x") - c("px"), c("y") - c("py"), c("nx") - c("x"), c("ny") - c("y")
    turn = F.abs(F.atan2(by, bx) - F.atan2(ay, ax))
    turn = F.degrees(F.when(turn > F.pi(), 2 * F.pi() - turn).otherwise(turn))
    dx, dy = c("nx") - c("px"), c("ny") - c("py")
    length = F.hypot(dx, dy)
    away = F.when(length == 0, F.hypot(ax, ay)).otherwise(F.abs(dx * (c("py") - c("y")) - dy * (c("px") - c("x"))) / length)
    straight = (ax * by - ay * bx == 0) & (ax * bx + ay * by >= 0)
    return _ring(shapes).select(*KEYS, F.round(turn, 6).alias("turn"), F.round(away, 6).alias("away"), straight.alias("straight"))


def ring_hits(shapes: DataFrame, x: float = CANVAS / 2, y: float = CANVAS / 2) -> DataFrame:
    """Sides of a document's ring that a ray to the right of a point crosses; it lies inside where they are odd."""
    c = F.col
    meets = ((c("y") > y) != (c("ny") > y)) & (F.lit(x) < c("x") + (F.lit(y) - c("y")) / F.nullif(c("ny") - c("y"), F.lit(0.0)) * (c("nx") - c("x")))
    got = _ring(shapes).groupBy("doc_id").agg(F.count_if(meets).alias("crossings"))
    return got.withColumn("inside", F.col("crossings") % 2 == 1)


def text_fit(shapes: DataFrame) -> DataFrame:
    """The largest step of the type scale, not above the text's size, that fits the width and height given to it; the least step where none does."""
    c = F.col
    wide, high = c("width") * 2, c("height")
    fits = lambda s: (s * ADVANCE * c("text_len") <= wide) & (s * (ASCENT + DESCENT) <= high) & (s <= c("font_size"))
    best = F.array_max(F.filter(F.array(*map(F.lit, K.TYPE_SCALE)), fits))
    rows = shapes.filter("tag = 'text'").select(*KEYS, best.alias("best"))
    return rows.select(*KEYS, F.coalesce("best", F.lit(K.TYPE_SCALE[0])).alias("fitted"), F.col("best").isNull().alias("overflows"))


def lch_values(shapes: DataFrame) -> DataFrame:
    """Every colour in use as lightness, chroma and hue, and the colour read back from them."""
    used = shapes.select("fill_r", "fill_g", "fill_b").distinct()
    lab = used.select("*", *[v.alias(k) for k, v in zip(("L", "A", "B"), C.oklab(C.RGB.of("fill_")), strict=True)])
    polar = lab.select("fill_r", "fill_g", "fill_b", "L", F.hypot("A", "B").alias("chroma"), F.atan2("B", "A").alias("hue"))
    back = C.from_oklab((F.col("L"), F.col("chroma") * F.cos("hue"), F.col("chroma") * F.sin("hue")))
    return polar.select("fill_r", "fill_g", "fill_b", F.round("L", 5).alias("lightness"), F.round("chroma", 5).alias("chroma"), C.to_hex(C.RGB(*back)).alias("hex"))


def paint_operators(shapes: DataFrame, dpi: float = 96.0) -> DataFrame:
    """Fill and stroke of every colour in use as operators of a page, and the page's marks in pixels."""
    r, g, b = (F.format_string("%.4f", F.col(c) / 255.0) for c in ("fill_r", "fill_g", "fill_b"))
    used = shapes.select("fill_r", "fill_g", "fill_b").distinct()
    return used.select("fill_r", "fill_g", "fill_b", F.concat_ws(" ", r, g, b, F.lit("rg")).alias("fill"), F.concat_ws(" ", r, g, b, F.lit("RG")).alias("stroke"), format_mm(F.lit(10.0), F.lit(dpi)).alias("slug"))


def font_names(shapes: DataFrame) -> DataFrame:
    """Families as written in a list, the first without quotes, and whether one of the brand's."""
    raw = F.when(F.col("shape_index") % 2 == 0, F.concat(F.lit("'"), F.col("font_family"), F.lit("', serif"))).otherwise(F.concat(F.lit(' "'), F.col("font_family"), F.lit('"')))
    rows = shapes.filter("tag = 'text'").select(*KEYS, family(raw).alias("family"))
    return rows.select(*KEYS, "family", F.regexp_replace(F.lower("family"), "[^a-z0-9]", "").alias("plain"), F.col("family").isin(*K.FONTS).alias("known"))


def font_matches(shapes: DataFrame) -> DataFrame:
    """Families asked for in five ways, the faces found for them, and whether these are the same."""
    c = F.col
    way = (c("doc_id") + c("shape_index")) % 5
    asked = F.when(way == 0, c("font_family")).when(way == 1, F.concat(F.upper("font_family"), F.lit("!"))).when(way == 2, "Sans-Serif").when(way == 3, "--").otherwise("Inter Tight")
    found = F.when(c("shape_index") % 2 == 0, "DejaVu Sans, Comic Sans MS Bold").otherwise(" Inter ,,Arial")
    rows = shapes.filter("tag = 'text'").select(*KEYS, asked.alias("asked"), found.alias("found"))
    return rows.withColumn("same", families_match(c("asked"), c("found")))


def comply_shapes(shapes: DataFrame, grid: float = K.GRID) -> DataFrame:
    """Every shape after the repairs that need no other shape: token, stroke, grid, family and type scale, and how many changed it."""
    c = F.col
    fixed = C.with_oklab(shapes.select(*KEYS, "tag", "x", "y", "stroke_width", "font_size", "font_family", *rules.FILL), C.RGB.of("fill_"))
    fixed = fixed.withColumn("token", rules._named(rules._token_structs((c("L"), c("A"), c("B")))["i"]))
    text = c("tag") == "text"
    new = {"new_stroke": nearest(c("stroke_width"), K.STROKES), "new_x": snap(c("x"), grid), "new_y": snap(c("y"), grid), "new_family": F.when(text, F.when(c("font_family").isin(*K.FONTS), c("font_family")).otherwise(K.FONTS[0])), "new_size": F.when(text, nearest(c("font_size"), K.TYPE_SCALE))}
    changed = F.lit(0)
    for was, now in (("stroke_width", "new_stroke"), ("x", "new_x"), ("y", "new_y"), ("font_size", "new_size")):
        changed = changed + F.coalesce((F.abs(c(was) - c(now)) > 1e-6).cast("int"), F.lit(0))
    changed = changed + F.coalesce((c("font_family") != c("new_family")).cast("int"), F.lit(0))
    return fixed.withColumns(new).select(*KEYS, "token", *new, changed.alias("repairs"))
