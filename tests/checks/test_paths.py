import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from limnos.functions import matrix as M
from limnos.operators import paths as P
from limnos.plans import queries


def table(spark, *texts):
    return spark.createDataFrame([(1, k, d) for k, d in enumerate(texts)], "doc_id long, shape_index long, d string")


def read(spark, *texts):
    return [(r.fault, [(q["name"], q["p"]) for q in r.commands or []]) for r in P.commands(table(spark, *texts)).orderBy("shape_index").collect()]


def rings(spark, texts, curve=8):
    """The subpaths of every path."""
    out = [[] for _ in texts]
    for r in P.vertices(table(spark, *texts), curve).orderBy("shape_index", "sub", "v").collect():
        if r.v == 0:
            out[r.shape_index].append([])
        out[r.shape_index][-1].append((round(r.x, 9), round(r.y, 9)))
    return out


def test_grammar(spark):
    got = read(spark, "M 0 0 a5 5 0 0110 10", "M.5.5L10.5.25", "1 2 3", "M 1 2 L 3", None, "", " , ", "M1,2,3-4z", "M0 0z5", "M0 0 L1e2,+.5 x", "m1 2 3 4 5 6", "H3.", "M1 2 A1 1 0 2 1 3 3", "M")
    assert got == [
        (None, [("M", [0, 0]), ("a", [5, 5, 0, 0, 1, 10, 10])]), (None, [("M", [0.5, 0.5]), ("L", [10.5, 0.25])]), ("no command first", []), ("values do not fit", []), ("empty", []), ("empty", []), ("empty", []),
        (None, [("M", [1, 2]), ("L", [3, -4]), ("z", [])]), ("values do not fit", []), ("values do not fit", []), (None, [("m", [1, 2]), ("l", [3, 4]), ("l", [5, 6])]), (None, [("H", [3])]), ("values do not fit", []), ("values do not fit", []),
    ]


def test_current_points(spark):
    # A move after a close is relative to the start of the closed subpath; drawing on after a close stays in it.
    assert rings(spark, ["m 10 10 h 20 v 20 h -20 z", "M1 1h4v4zm10 0h1zl0 5H0V2", "L3 4l1 1M9 9", "m1 1m2 2m3 3l1 0M0 0l1 1m1 1l1 1", "M5 5"]) == [
        [[(10, 10), (30, 10), (30, 30), (10, 30), (10, 10)]], [[(1, 1), (5, 1), (5, 5), (1, 1)], [(11, 1), (12, 1), (11, 1), (11, 6), (0, 6), (0, 2)]], [[(3, 4), (4, 5)]], [[(6, 6), (7, 6)], [(0, 0), (1, 1)], [(2, 2), (3, 3)]], [],
    ]


def test_shorthands(spark):
    same = [
        ("M0 0C0 1 1 1 1 0C1 -1 2 -1 2 0", "M0 0C0 1 1 1 1 0S2 -1 2 0"), ("M0 0C0 1 1 1 1 0C1 -1 2 -1 2 0", "M0 0c0 1 1 1 1 0s1 -1 1 0"), ("M0 0C0 0 1 1 1 0", "M0 0S1 1 1 0"),
        ("M0 0Q1 2 2 0Q3 -2 4 0Q5 2 6 1Q7 0 8 0", "M0 0Q1 2 2 0T4 0T6 1T8 0"), ("M0 0Q0 0 4 0Q8 0 6 2", "M0 0T4 0t2 2"),
    ]
    long, short = (rings(spark, [pair[k] for pair in same], 4) for k in (0, 1))
    assert long == short and all(long)


def test_areas(spark):
    got = [round(r.area, 6) for r in P.areas(table(spark, "M 0 0 L 100 0 L 100 100 L 0 100 Z M 40 40 L 40 60 L 60 60 L 60 40 Z", "M5 5", "x", None, "M 0 50 A 50 50 0 1 1 100 50 A 50 50 0 1 1 0 50 Z"), 16).orderBy("shape_index").collect()]
    assert got[:2] == [9600, 0] and len(got) == 3 and got[2] == pytest.approx(math.pi * 2500, rel=0.02)


def test_arcs(spark):
    """Every vertex lies on one ellipse with the given radii (grown if too small), and the sweep goes the asked way round."""
    asked = [(rest, flags) for rest in ("3 3 0 {} 4 0", "4 2 0 {} 3 1", "4 2 30 {} 1 3", "1 1 0 {} 8 0") for flags in ("0 0", "0 1", "1 0", "1 1")]
    for (rest, flags), got in zip(asked, rings(spark, [f"M0 0A{rest.format(flags)}" for rest, flags in asked], 8), strict=True):
        rx, ry, tilt, *_ = rest.split()
        a = math.radians(float(tilt))
        turned = [(px * math.cos(a) + py * math.sin(a), py * math.cos(a) - px * math.sin(a)) for px, py in got[0]]
        g = max(1.0, math.hypot(turned[-1][0] / 2 / float(rx), turned[-1][1] / 2 / float(ry)))
        unit = [(px / float(rx) / g, py / float(ry) / g) for px, py in turned]
        (x1, y1), (x2, y2), (x3, y3) = unit[0], unit[5], unit[11]
        d = 2 * (x1 * (y2 - y3) + x2 * (y3 - y1) + x3 * (y1 - y2))
        s = [px * px + py * py for px, py in (unit[0], unit[5], unit[11])]
        cx, cy = (s[0] * (y2 - y3) + s[1] * (y3 - y1) + s[2] * (y1 - y2)) / d, (s[0] * (x3 - x2) + s[1] * (x1 - x3) + s[2] * (x2 - x1)) / d
        assert all(abs(math.hypot(px - cx, py - cy) - 1) < 1e-6 for px, py in unit)
        turns = sum((p[0] - cx) * (q[1] - cy) - (q[0] - cx) * (p[1] - cy) for p, q in zip(unit, unit[1:], strict=False))
        assert (turns > 0) == flags.endswith("1")
        if g == 1:
            assert (abs(turns) > math.pi - 0.2) == flags.startswith("1")


def test_moved_and_mapped(spark):
    texts = ["M 0 0 a5 5 0 0110 10", "M.5.5L10.5.25", "M 1 2 L 3", "M1 1H5V6z", "M1 1L2 3"]
    assert [r.d for r in P.moved(table(spark, *texts), 2.0, 3.0, 4.0).orderBy("shape_index").collect()] == ["M 3 4 a 10 10 0 0 1 20 20", "M 4 5 L 24 4.5", None, "M 5 6 H 13 V 16 z", "M 5 6 L 7 10"]
    by = lambda *m: [(r.d, r.exact) for r in P.mapped(table(spark, *texts).withColumn("matrix", M.Matrix.of(*m).struct())).orderBy("shape_index").collect()]
    assert by(2, 0, 0, 2, 3, 4) == [("M 3 4 a 10 10 0 0 1 20 20", True), ("M 4 5 L 24 4.5", True), (None, False), ("M 5 6 H 13 V 16 z", True), ("M 5 6 L 7 10", True)]
    assert by(0, 1, -1, 0, 0, 0) == [(None, False), ("M -0.5 0.5 L -0.25 10.5", True), (None, False), (None, False), ("M -1 1 L -3 2", True)]
    assert by(1, 0, 0, 2, 0, 0)[0] == (None, False) and by(1, 0, 0, 2, 0, 0)[3] == ("M 1 2 H 5 V 12 z", True)


def test_one_exchange(spark):
    plan = P.segments(table(spark, "M0 0L1 1").select(*P.KEYS, F.col("d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_vertices_and_texts_take_no_exchange(spark):
    """They sorted by path for every running sum, joined the paths with themselves and read them up to three times."""
    df = table(spark, "M0 0L1 1").withColumn("matrix", M.Matrix.of(1, 0, 0, 1, 0, 0).struct())
    for out in (P.vertices(df), P.areas(df), P.bounds(df), P.moved(df, 1.0, 0.0, 0.0), P.mapped(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Exchange", "Join", "Sort", "Window"))
    for name in ("path_area", "path_transform"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("regexp_extract_all(") <= 4


def test_vertices_end_where_segments_do(spark):
    """The numpy pass against the running sums, on paths of all commands, some of them long."""
    r, texts = random.Random(3), ["", "zzM1 1", "m", "M1 1z", *["M0 0" + f"{c}1 2" * 400 for c in "tTlm"]]
    for _ in range(150):
        text = ""
        for _ in range(r.choice((1, 3, 12))):
            name = r.choice("MmLlHhVvCcSsQqTtAaZz")
            values = [f"{r.randrange(2)}" if kind == "f" else f"{r.randrange(-20, 20) / 4}" for kind in P.VALUES[name.upper()]]
            text += name + " ".join(values)
        texts.append(text)
    df = table(spark, *texts)
    ends, rings = {}, {}
    for s in P.segments(df).orderBy("shape_index", "k").collect():
        stays = s.name == "Z" and (s.k == 0 or (s.ax, s.ay) == (s.sx, s.sy))
        n = 0 if stays else 4 if s.name in "CSQT" else 8 if s.name == "A" and s.p[0] and s.p[1] and (s.ax, s.ay) != (s.x, s.y) else 1
        key = (s.shape_index, s.sub)
        rings[key] = rings.get(key, 0) + n
        ends.setdefault(key, {}).update({rings[key] - 1: (s.x, s.y)} if n else {})
        if n == 4 and s.name in "CSQT":  # the second of four chords: half way
            half = lambda a, b, c, d: (a + 3 * b + 3 * c + d) / 8 if s.name in "CS" else (a + 2 * b + d) / 4  # noqa: B023, E731
            ends[key][rings[key] - 3] = (half(s.ax, s.bx, s.cx, s.x), half(s.ay, s.by, s.cy, s.y))
    got = {}
    for v in P.vertices(df, 4).collect():
        got.setdefault((v.shape_index, v.sub), {})[v.v] = (v.x, v.y)
    assert {k: len(v) for k, v in got.items()} == {k: n for k, n in rings.items() if n >= 2}
    assert all(got[key][at] == pytest.approx(xy) for key in got for at, xy in ends[key].items())


def test_halves_of_a_hundredth_as_the_sql_writes_them(spark):
    con = duckdb.connect()
    want = " ".join(con.execute(f"SELECT rtrim(rtrim(format('{{:.2f}}', {v}), '0'), '.')").fetchone()[0] for v in ("0.125e0", "2.675e0"))
    assert [r.d for r in P.moved(table(spark, "M.125 2.675", "M-.001 1200"), 1.0, 0.0, 0.0).orderBy("shape_index").collect()] == [f"M {want}", "M 0 1200"]
