"""Stops of gradients: colours held against the tokens, too many stops thinned to evenly placed ones, gradients flattened to one token.

Stops are rows (doc_id, k, r, g, b), in the order of k from 0. Everything is one exchange by gradient; a gradient of any number of stops is thinned by arithmetic on
its stops' places, so none is held as a whole.

Defined cases: stops without a colour count as stops, have no token and no part in the mean; a gradient without any colour is flattened as mid grey; the first
and the last stop always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.scalars import first_least
from ..plans import catalog as K
from .comply import LABS, TOKENS, _exact
from .rules import _named

MOST = 4  # fixed value: stops that the default system allows
LAB = ("_L", "_A", "_B")
GREY = (128, 128, 128)  # fixed value: what a gradient without colours counts as


def _nearest(lab: tuple[Column, Column, Column]) -> Column:
    """Struct (d, i) of the nearest token."""
    return first_least([C.distance(lab, tuple(map(F.lit, LABS[i]))) for i, _ in TOKENS])


def gradient_stops(stops: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, k, token, severity (null for a token's own colour), kept, stops (how many there are)."""
    c, rgb = F.col, C.RGB(F.col("r"), F.col("g"), F.col("b"))
    out = C.with_oklab(stops, rgb, LAB).withColumn("_x", _exact(rgb))
    out = out.withColumn("_n", F.when(c("r").isNotNull(), _nearest((c("_L"), c("_A"), c("_B"))))).withColumn("stops", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    last = (c("stops") - 1).cast("double")
    places = F.array(F.lit(0.0), last, *[F.bround(k * last / (most - 1)) for k in range(1, most - 1)])
    kept = (c("stops") <= most) | F.array_contains(places, c("k").cast("double"))
    severity = F.when(c("_x").isNull() & c("_n").isNotNull(), F.when(c("_n.d") <= K.SNAP_WARNING, "warning").otherwise("error"))
    return out.select("doc_id", "k", F.when(c("r").isNotNull(), _named(F.coalesce("_x", "_n.i"))).alias("token"), severity.alias("severity"), kept.alias("kept"), "stops")


def flattened(stops: DataFrame) -> DataFrame:
    """doc_id, hex, token: the mean of each gradient's colours in OKLab, as a colour, and the token nearest to it."""
    c = F.col
    lab = C.with_oklab(stops, C.RGB(c("r"), c("g"), c("b")), LAB).select("doc_id", *[F.when(c("r").isNotNull(), c(k)).alias(k) for k in LAB])
    mean = lab.groupBy("doc_id").agg(*[F.avg(k).alias(k) for k in LAB])
    cubes = mean.select("doc_id", c("_L").isNull().alias("none"), *[v.alias(k) for k, v in zip(LAB, C.cubes(tuple(map(c, LAB))), strict=True)])
    back = cubes.select("doc_id", "none", *[v.alias(k) for k, v in zip("rgb", C.from_cubes(tuple(map(c, LAB))), strict=True)])
    seen = back.select("doc_id", *[F.when(c("none"), g).otherwise(c(k)).alias(k) for k, g in zip("rgb", GREY, strict=True)])
    again = C.with_oklab(seen, C.RGB(c("r"), c("g"), c("b")), LAB)
    return again.select("doc_id", C.to_hex(C.RGB(c("r"), c("g"), c("b"))).alias("hex"), _named(_nearest((c("_L"), c("_A"), c("_B")))["i"]).alias("token"))
