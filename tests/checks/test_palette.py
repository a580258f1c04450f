import numpy as np
from pyspark.sql import functions as F

from limnos.functions import color as C
from limnos.operators import palette


def _one(spark, front, back):
    return [r.o for r in palette.ensure_contrast(spark.createDataFrame([(0, front, back)], "k int, f int, b int"), "f", "b", "o").collect()]


def test_moved_until_the_contrast_holds(spark):
    rng = np.random.default_rng(3)
    pairs = [(k, int(f), int(b)) for k, (f, b) in enumerate(rng.integers(0, 1 << 24, (300, 2)))]
    rows = palette.ensure_contrast(spark.createDataFrame(pairs, "k int, f int, b int"), "f", "b", "o")
    light = lambda c: C.luminance(palette._rgb(F.col(c)))
    got = rows.select("f", "o", C.contrast(light("f"), light("b")).alias("was"), C.contrast(light("o"), light("b")).alias("now")).collect()
    assert len(got) == 300 and all(r.now >= 4.5 for r in got)
    assert all((r.f == r.o) == (r.was >= 4.5) for r in got)


def test_without_a_colour_there_is_none(spark):
    assert _one(spark, None, 0xFFFFFF) == [None] and _one(spark, 0x808080, None) == [None]
    assert _one(spark, 0x767676, 0xFFFFFF) == [0x767676]


def test_no_colour_is_tried_that_the_search_does_not_reach(spark):
    """Once 303 colours of every row were made before the first that suits was taken."""
    seeds = spark.createDataFrame([(1, 10, 20, 30, 40, 50, 60)], "seed int, " + ", ".join(f"{p}_{k} int" for p in ("primary", "accent") for k in "rgb"))
    plan = palette.palette_tokens(seeds)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
