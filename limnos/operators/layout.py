"""Checks that need the whole document: one exchange by document, then windows, sums and joins inside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..plans import catalog as K
from ..sources.bridge import CANVAS
from .rules import FILL, KEYS

AREA = CANVAS * CANVAS
SEE_THROUGH = 0.9  # fixed value: the opacity below which a shape hides nothing


def laid_out(shapes: DataFrame) -> DataFrame:
    """All but backgrounds."""
    return shapes.withColumn("box_area", F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))).filter(F.col("box_area") < 0.9 * AREA)


def max_colors(shapes: DataFrame, cap: int = K.MAX_COLORS) -> DataFrame:
    """Use of each colour of a document by area, its rank (the first seen of equals first) and whether it is kept; documents over the cap."""
    used = shapes.groupBy("doc_id", *FILL).agg(F.sum(F.coalesce("area", F.lit(1.0))).alias("usage"), F.min("shape_index").alias("first"))
    ranked = used.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("usage", 6).desc(), "first")).cast("long"))
    counted = ranked.withColumn("colors", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return counted.filter(F.col("colors") > cap).select("doc_id", *FILL, F.round("usage", 6).alias("usage"), "rank", (F.col("rank") <= cap).alias("kept"), "colors")


def ink_once_per_color(shapes: DataFrame, limit: float = 200.0) -> DataFrame:
    """The first shape of each colour of a document that takes more ink than the limit."""
    over = shapes.withColumn("ink", C.total_ink(C.RGB.of("fill_"))).filter(F.col("ink") > limit)
    return over.groupBy("doc_id", *FILL).agg(F.min("shape_index").alias("shape_index"), F.first("ink").alias("ink")).select(*KEYS, *FILL, F.round("ink", 6).alias("ink"))


def text_hierarchy(shapes: DataFrame) -> DataFrame:
    """Documents with texts of one size only."""
    got = shapes.filter("tag = 'text'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"), F.count_distinct("font_size").alias("sizes"))
    return got.filter("texts >= 2 AND sizes < 2")


def layout_balance(shapes: DataFrame, limit: float = 0.25) -> DataFrame:
    """Offset of the area-weighted centre from the middle, as a share of the canvas."""
    a = F.col("box_area")
    got = laid_out(shapes).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(a).alias("a"), F.sum(a * (F.col("x0") + F.col("x1")) / 2).alias("mx"), F.sum(a * (F.col("y0") + F.col("y1")) / 2).alias("my")
    )
    off = {k: F.abs(F.col(m) / F.col("a") - CANVAS / 2) / CANVAS for k, m in (("off_x", "mx"), ("off_y", "my"))}
    return got.filter("items >= 2 AND a > 0").select("doc_id", *[F.round(v, 6).alias(k) for k, v in off.items()], ((off["off_x"] > limit) | (off["off_y"] > limit)).alias("lopsided"))


def layout_whitespace(shapes: DataFrame, least: float = 0.15) -> DataFrame:
    got = laid_out(shapes).groupBy("doc_id").agg(F.sum("box_area").alias("a"))
    white = F.lit(1.0) - F.least(F.lit(AREA), F.col("a")) / AREA
    return got.select("doc_id", F.round(white, 6).alias("whitespace"), (white < least).alias("crowded"))


def whole_findings(shapes: DataFrame, off_limit: float = 0.25, white_limit: float = 0.15) -> DataFrame:
    """doc_id, rule, severity of balance, whitespace and text sizes: one set of sums for each document."""
    c = F.col
    area = F.greatest(F.lit(0.0), c("x1") - c("x0")) * F.greatest(F.lit(0.0), c("y1") - c("y0"))
    a = F.when(area < 0.9 * AREA, area)
    size = F.when(c("tag") == "text", c("font_size"))
    got = shapes.groupBy("doc_id").agg(
        F.count(a).alias("items"), F.sum(a).alias("a"), F.sum(a * (c("x0") + c("x1")) / 2).alias("mx"), F.sum(a * (c("y0") + c("y1")) / 2).alias("my"),
        F.count_if(c("tag") == "text").alias("texts"), F.min(size).alias("least"), F.max(size).alias("most"),
    )
    off = lambda m: F.abs(c(m) / c("a") - CANVAS / 2) / CANVAS > off_limit
    found = {
        "layout.balance": (c("items") >= 2) & (c("a") > 0) & (off("mx") | off("my")), "layout.whitespace": (c("items") > 0) & (F.lit(1.0) - F.least(F.lit(AREA), c("a")) / AREA < white_limit),
        "type.hierarchy": (c("texts") >= 2) & (c("least").isNull() | (c("least") == c("most"))),
    }
    return got.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in found.items()]))).alias("rule")).withColumn("severity", F.lit("info"))


def layout_rhythm(shapes: DataFrame, grid: float = K.GRID) -> DataFrame:
    """Vertical gaps between neighbours by top edge, and how many stand off the grid by more than one."""
    w = Window.partitionBy("doc_id").orderBy("y0", "shape_index")
    gaps = laid_out(shapes).withColumn("gap", F.col("y0") - F.lag("y1").over(w)).filter("gap > 0")
    off = F.abs(F.col("gap") - F.bround(F.col("gap") / grid) * grid) > 1
    return gaps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("gaps"), F.count_if(off).alias("off_rhythm")).filter("gaps >= 2")


def layout_alignment(shapes: DataFrame, tolerance: float = K.ALIGN_TOLERANCE, grid: float = K.GRID) -> DataFrame:
    """Left edges within a chain of small gaps that miss the chain's common edge."""
    w = Window.partitionBy("doc_id").orderBy("x0", "shape_index")
    chained = laid_out(shapes).withColumn("new", F.coalesce((F.col("x0") - F.lag("x0").over(w) > tolerance).cast("int"), F.lit(1)))
    grouped = chained.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy("doc_id", "cluster")
    edge = grouped.withColumns({"n": F.count(F.lit(1)).over(g), "lo": F.min("x0").over(g), "hi": F.max("x0").over(g)}).filter("n >= 2 AND hi - lo >= 1e-6")
    step = F.bround(F.col("lo") / grid) * grid
    target = F.when(F.abs(step - F.col("lo")) <= tolerance, step).otherwise(F.col("lo"))
    return edge.withColumn("target", target).filter(F.abs(F.col("x0") - F.col("target")) >= 1e-6).select(*KEYS, F.round("x0", 6).alias("edge"), F.round("target", 6).alias("target"), "n")


def _pairs(left: DataFrame, right: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Rows of both sides of one document, the columns as a_* and b_*: an equality join that Spark may split where it is skewed."""
    a = left.select("doc_id", *[F.col(c).alias("a_" + c) for c in cols])
    b = right.select("doc_id", *[F.col(c).alias("b_" + c) for c in cols])
    return a.join(b, "doc_id")


def _shared() -> Column:
    side = lambda k: F.greatest(F.lit(0.0), F.least("a_" + k + "1", "b_" + k + "1") - F.greatest("a_" + k + "0", "b_" + k + "0"))
    return side("x") * side("y")


BOX = ("shape_index", "x0", "y0", "x1", "y1", "box_area")


def text_collisions(shapes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Pairs of texts that overlap, by the share of the smaller box."""
    texts = laid_out(shapes).filter("tag = 'text'")
    c = F.col
    meet = (c("a_shape_index") < c("b_shape_index"))
    for k in "xy":
        meet = meet & (c(f"a_{k}0") + tolerance < c(f"b_{k}1") - tolerance) & (c(f"b_{k}0") + tolerance < c(f"a_{k}1") - tolerance)
    share = _shared() / F.greatest(F.lit(1e-6), F.least("a_box_area", "b_box_area"))
    found = _pairs(texts, texts, BOX).filter(meet)
    return found.select("doc_id", c("a_shape_index").alias("text"), c("b_shape_index").alias("other"), F.round(share, 6).alias("share"), F.when(share > 0.25, "error").otherwise("warning").alias("severity"))


def is_transparent(opacity: Column) -> Column:
    return F.coalesce(opacity < SEE_THROUGH, F.lit(False))


def background_color(shapes: DataFrame, canvas: float = AREA) -> DataFrame:
    """Fill of each document's background: the first shape in paint order that covers nine tenths of the canvas."""
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0"))
    wide = shapes.filter(area >= 0.9 * canvas)
    return wide.groupBy("doc_id").agg(F.min("shape_index").alias("shape_index"), F.min_by(C.to_hex(C.RGB.of("fill_")), "shape_index").alias("background"))


def text_buried(shapes: DataFrame, share: float = 0.6) -> DataFrame:
    """Texts with the first later shape that covers most of them and can't be seen through."""
    items = laid_out(shapes)
    both = _pairs(items.filter("tag = 'text'"), items.filter((F.col("tag") != "text") & ~is_transparent(F.col("opacity"))), BOX)
    over = both.filter((F.col("b_shape_index") > F.col("a_shape_index")) & (_shared() / F.greatest(F.lit(1e-6), F.col("a_box_area")) >= share))
    return over.groupBy("doc_id", F.col("a_shape_index").alias("shape_index")).agg(F.min("b_shape_index").alias("covered_by"))


# Places within a text's box.
SAMPLES = ((0.5, 0.5), (0.08, 0.5), (0.92, 0.5), (0.5, 0.2), (0.5, 0.8))


def contrast_audit(shapes: DataFrame) -> DataFrame:
    """Worst contrast of a text over five places, each seen on the topmost earlier shape there (as-of by paint order), on white elsewhere."""
    c = F.col
    lum = shapes.withColumn("lum", C.luminance(C.RGB.of("fill_")))
    spots = F.array(*[F.struct(F.lit(k).alias("k"), (c("x0") + (c("x1") - c("x0")) * u).alias("px"), (c("y0") + (c("y1") - c("y0")) * v).alias("py")) for k, (u, v) in enumerate(SAMPLES)])
    texts = lum.filter("tag = 'text'").select("doc_id", "shape_index", "font_size", c("lum").alias("own"), F.explode(spots).alias("s")).select("doc_id", "shape_index", "font_size", "own", "s.*")
    under = lum.filter("tag <> 'text'").select("doc_id", c("shape_index").alias("below"), c("tag").alias("kind"), c("x0").alias("u0"), c("y0").alias("v0"), c("x1").alias("u1"), c("y1").alias("v1"), "radius", c("lum").alias("ground"))
    dx, dy = c("px") - (c("u0") + c("u1")) / 2, c("py") - (c("v0") + c("v1")) / 2
    inside = F.when(c("kind") == "circle", dx * dx + dy * dy <= c("radius") * c("radius")).otherwise((c("px") >= c("u0")) & (c("px") <= c("u1")) & (c("py") >= c("v0")) & (c("py") <= c("v1")))
    seen = texts.join(under, "doc_id").filter((c("below") < c("shape_index")) & inside).groupBy("doc_id", "shape_index", "k").agg(F.max_by("ground", "below").alias("ground"))
    every = texts.join(seen, ["doc_id", "shape_index", "k"], "left").withColumn("ratio", C.contrast(c("own"), F.coalesce("ground", F.lit(1.0))))
    worst = every.groupBy("doc_id", "shape_index", "font_size").agg(F.min("ratio").alias("ratio"))
    need = F.when(c("font_size") >= K.LARGE_TEXT, K.CONTRAST_LARGE).otherwise(K.CONTRAST_TEXT)
    return worst.select(*KEYS, F.round("ratio", 6).alias("ratio"), (c("ratio") < need).alias("fails"))
