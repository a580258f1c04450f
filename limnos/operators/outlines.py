"""Outlines and boxes decided in rounds: simplified rings, and boxes that win over those they overlap.

What is a stack or a loop over sorted candidates elsewhere is a few rounds over all documents at once here: each round splits every open
stretch of every ring at its farthest place, or lets every box win that is the best among its undecided neighbours. Rounds are written, so that
plans stay small; their number grows with the depth of the splits or the longest chain of overlaps, not with the number of documents.

Defined cases: rings of fewer than four places are kept whole, and so are those of which fewer than three would be left; places without a position
are left out; of equally far places the first splits; of equally large boxes the first wins; boxes that only touch do not overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import kept
from .rules import KEYS


def ring_simplify(shapes: DataFrame, tolerance: float) -> DataFrame:
    """doc_id, shape_index, keep: the places of a document's ring from which no other place is farther than the tolerance, by splits at the farthest place.

    The ring is opened at the place farthest from its middle and at the one farthest from that.
    """
    c = F.col
    doc = Window.partitionBy("doc_id")
    ring = shapes.filter("x IS NOT NULL AND y IS NOT NULL").select(*KEYS, "x", "y")
    ring = ring.withColumns({"k": F.row_number().over(doc.orderBy("shape_index")) - 1, "n": F.count(F.lit(1)).over(doc), "mx": F.avg("x").over(doc), "my": F.avg("y").over(doc)})
    span = lambda x, y: (c("x") - x) * (c("x") - x) + (c("y") - y) * (c("y") - y)
    farthest = lambda d, by: F.min(F.struct((-d).alias("d"), c(by).alias("k"), "x", "y")).over(doc)
    ring = ring.withColumn("s", farthest(F.round(span(c("mx"), c("my")), 6), "k"))
    ring = ring.withColumn("r", F.pmod(c("k") - c("s.k"), c("n"))).withColumn("e", farthest(F.round(span(c("s.x"), c("s.y")), 6), "r"))
    flat = ["doc_id", "shape_index", "x", "y", "r", "n", c("e.k").alias("far")]
    end = ring.filter("r = 0").withColumn("r", c("n"))
    now = kept(ring.select(*flat).unionByName(end.select(*flat)).withColumn("keep", (c("r") == 0) | (c("r") == c("far")) | (c("r") == c("n")) | (c("n") < 4)), "ring")
    before, after = doc.orderBy("r").rowsBetween(Window.unboundedPreceding, 0), doc.orderBy("r").rowsBetween(0, Window.unboundedFollowing)
    while True:
        mark = F.when(c("keep"), F.struct("r", "x", "y"))
        open_ = now.withColumns({"a": F.last(mark, ignorenulls=True).over(before), "b": F.first(mark, ignorenulls=True).over(after)})
        dx, dy, ux, uy = c("b.x") - c("a.x"), c("b.y") - c("a.y"), c("x") - c("a.x"), c("y") - c("a.y")
        long = F.hypot(dx, dy)
        away = F.when(long == 0, F.hypot(ux, uy)).otherwise(F.abs(dx * uy - dy * ux) / F.nullif(long, F.lit(0.0)))
        open_ = open_.withColumns({"a": c("a.r"), "d": F.when(c("keep"), F.lit(-1.0)).otherwise(F.round(away, 9))})
        first = F.row_number().over(Window.partitionBy("doc_id", "a").orderBy(F.desc("d"), "r")) == 1
        split = kept(open_.withColumn("new", ~c("keep") & first & (c("d") > tolerance)).drop("a", "b", "d"), "ring")
        if split.filter("new").isEmpty():
            break
        now = split.withColumn("keep", c("keep") | c("new")).drop("new")
    few = F.count_if(c("keep") & (c("r") < c("n"))).over(doc) < 3
    return now.withColumn("keep", c("keep") | few).filter("r < n").select(*KEYS, "keep")


def greedy_boxes(boxes: DataFrame) -> DataFrame:
    """doc_id, shape_index of the boxes accepted in the order of falling area, each only if it overlaps none accepted before."""
    c = F.col
    side = lambda a: F.greatest(F.lit(0.0), c(a + "1") - c(a + "0"))
    ranked = boxes.select(*KEYS, "x0", "y0", "x1", "y1", F.round(-side("x") * side("y"), 6).alias("rank"))
    other = ranked.select("doc_id", c("shape_index").alias("loser"), *[c(k).alias("o" + k) for k in ("x0", "y0", "x1", "y1")], c("rank").alias("orank"))
    meet = F.struct("rank", "shape_index") < F.struct("orank", "loser")
    for a in "xy":
        meet = meet & (c(f"{a}0") < c(f"o{a}1")) & (c(f"o{a}0") < c(f"{a}1"))
    beats = kept(ranked.join(other, "doc_id").filter(meet).select("doc_id", c("shape_index").alias("winner"), "loser"), "beats")
    undecided, won = ranked.select(*KEYS), []
    while True:
        undecided = kept(undecided, "undecided")
        if undecided.isEmpty():
            break
        still = beats.join(undecided.select("doc_id", c("shape_index").alias("winner")), ["doc_id", "winner"], "left_semi")
        best = kept(undecided.join(still.select("doc_id", c("loser").alias("shape_index")), list(KEYS), "left_anti"), "best")
        won.append(best)
        lost = beats.join(best.select("doc_id", c("shape_index").alias("winner")), ["doc_id", "winner"], "left_semi").select("doc_id", c("loser").alias("shape_index"))
        undecided = undecided.join(best, list(KEYS), "left_anti").join(lost, list(KEYS), "left_anti")
    out = won[0] if won else ranked.select(*KEYS)
    for more in won[1:]:
        out = out.unionByName(more)
    return out
