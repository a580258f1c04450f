import math
import random

from limnos.operators import outlines, raster

BOX = "doc_id long, shape_index long, x double, y double, x0 double, y0 double, x1 double, y1 double"


def split(points, lo, hi, tolerance, keep):
    if hi <= lo + 1:
        return
    (ax, ay), (bx, by) = points[lo], points[hi]
    long = math.hypot(bx - ax, by - ay)
    far = lambda p: math.hypot(p[0] - ax, p[1] - ay) if long == 0 else abs((bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)) / long
    d, i = min((-round(far(points[i]), 9), i) for i in range(lo + 1, hi))
    if -d > tolerance:
        keep.add(i)
        split(points, lo, i, tolerance, keep)
        split(points, i, hi, tolerance, keep)


def simplified(points, tolerance):
    n = len(points)
    if n < 4:
        return set(range(n))
    mid = (sum(p[0] for p in points) / n, sum(p[1] for p in points) / n)
    span = lambda p, q: round((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, 6)
    s = min(range(n), key=lambda i: (-span(points[i], mid), i))
    ring = points[s:] + points[:s] + [points[s]]
    far = min(range(n), key=lambda r: (-span(ring[r], points[s]), r))
    keep = {0, far, n}
    split(ring, 0, far, tolerance, keep)
    split(ring, far, n, tolerance, keep)
    kept = {(r + s) % n for r in keep if r < n}
    return kept if len(kept) >= 3 else set(range(n))


def test_rings_match_the_recursion(spark):
    r, rows, want = random.Random(4), [], set()
    for d in range(60):
        n = r.choice((1, 3, 4, 7, 30, 80))
        points = [(100 * math.cos(2 * math.pi * k / n) + r.gauss(0, 6), 100 * math.sin(2 * math.pi * k / n) + r.gauss(0, 6)) for k in range(n)]
        if d % 10 == 9:
            points = [(float(k), 0.0) for k in range(n)]
        rows += [(d, k, x, y, 0.0, 0.0, 0.0, 0.0) for k, (x, y) in enumerate(points)]
        want |= {(d, k) for k in simplified(points, 8.0)}
    got = outlines.ring_simplify(spark.createDataFrame(rows, BOX), 8.0).collect()
    assert len(got) == len(rows) and {(x.doc_id, x.shape_index) for x in got if x.keep} == want


def test_boxes_match_the_greedy_loop(spark):
    r, rows, want = random.Random(5), [], set()
    for d in range(40):
        boxes = []
        for k in range(r.choice((1, 5, 30))):
            x, y = r.randrange(100), r.randrange(100)
            boxes.append((x, y, x + r.randrange(1, 40), y + r.randrange(1, 40)))
        rows += [(d, k, 0.0, 0.0, *map(float, b)) for k, b in enumerate(boxes)]
        won = []
        for k in sorted(range(len(boxes)), key=lambda k: (-(boxes[k][2] - boxes[k][0]) * (boxes[k][3] - boxes[k][1]), k)):
            b = boxes[k]
            if not any(b[0] < o[2] and o[0] < b[2] and b[1] < o[3] and o[1] < b[3] for o in (boxes[j] for j in won)):
                won.append(k)
        want |= {(d, k) for k in won}
    df = spark.createDataFrame(rows, BOX)
    assert {tuple(x) for x in outlines.greedy_boxes(df).collect()} == want
    assert outlines.greedy_boxes(df.limit(0)).count() == 0


def pixels(spark, *pictures):
    rows = [(d, y, x, int(c)) for d, p in enumerate(pictures) for y, line in enumerate(p) for x, c in enumerate(line) if c != "."]
    return spark.createDataFrame(rows, "doc_id long, y int, x int, label int")


SQUARE, HOLE, TOUCH = ["1" * 10] * 10, ["1" * 12] * 4 + ["1111" + "0" * 4 + "1111"] * 4 + ["1" * 12] * 4, ["110", "110", "001"]


def test_regions(spark):
    spiral = ["1111111", "0000001", "1111101", "1000101", "1011101", "1000001", "1111111"]
    got = raster.regions(pixels(spark, SQUARE, HOLE, TOUCH, spiral, [".1", "1."])).collect()
    found = {}
    for r in got:
        found.setdefault((r.doc_id, r.label), set()).add(r.region)
    assert {k: len(v) for k, v in found.items()} == {(0, 1): 1, (1, 1): 1, (1, 0): 1, (2, 1): 2, (2, 0): 2, (3, 1): 1, (3, 0): 1, (4, 1): 2}
    assert sum((r.doc_id, r.label) == (0, 1) for r in got) == 100
    assert raster.regions(pixels(spark, SQUARE).limit(0)).count() == 0


def test_boundaries_close_and_keep_the_area(spark):
    df = pixels(spark, SQUARE, HOLE, TOUCH)
    got = sorted((r.doc_id, r.label, r.sides, r.area) for r in raster.boundary_loops(df).collect())
    assert got == [(0, 1, 40, 100.0), (1, 0, 16, 16.0), (1, 1, 16, -16.0), (1, 1, 48, 144.0), (2, 0, 6, 2.0), (2, 0, 6, 2.0), (2, 1, 4, 1.0), (2, 1, 8, 4.0)]
    chains = {}
    for r in raster.loops(df).collect():
        chains.setdefault((r.doc_id, r.loop), []).append((r.step, (r.x0, r.y0), (r.x1, r.y1)))
    for side in map(sorted, chains.values()):
        assert [s[0] for s in side] == list(range(len(side)))
        assert all(a[2] == b[1] for a, b in zip(side, side[1:] + side[:1], strict=True))


def test_boxes_of_regions(spark):
    got = {(r.doc_id, r.label): (r.pixels, r.x0, r.y0, r.x1, r.y1, r.share) for r in raster.region_boxes(pixels(spark, SQUARE, HOLE)).collect()}
    assert got == {(0, 1): (100, 0, 0, 10, 10, 1.0), (1, 1): (128, 0, 0, 12, 12, 0.888889), (1, 0): (16, 4, 4, 8, 8, 0.111111)}


def test_regions_over_tiles(spark):
    """Pictures of several tiles: the same regions as by a plain flood."""
    r = random.Random(8)
    pictures = [["".join(r.choice("0011.") for _ in range(150)) for _ in range(140)], ["1" * 131] * 131]
    got = {(v.doc_id, v.y, v.x): v.region for v in raster.regions(pixels(spark, *pictures)).collect()}
    for d, lines in enumerate(pictures):
        todo = {(y, x): c for y, line in enumerate(lines) for x, c in enumerate(line) if c != "."}
        for at in sorted(todo):
            if at in todo:
                c, front = todo.pop(at), [at]
                while front:
                    y, x = front.pop()
                    assert got.pop((d, y, x)) == at[0] * raster.WIDE + at[1]
                    front += [n for n in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)) if todo.get(n) == c and todo.pop(n)]
    assert not got


def test_regions_of_small_pictures_take_one_exchange_and_no_rounds(spark, monkeypatch):
    """Every round of spreading was a table of all pixels."""
    tables, real = [], raster.kept
    monkeypatch.setattr(raster, "kept", lambda df, label: tables.append(label) or real(df, label))
    raster.regions(pixels(spark, SQUARE, HOLE, TOUCH)).collect()
    assert tables == ["tiles", "links"]


def test_boundaries_over_tiles(spark):
    """Pictures of several tiles: loops as by walking along each side."""
    r = random.Random(9)
    pictures = [["".join(r.choice("0011.") for _ in range(100)) for _ in range(90)], ["1" * 131] * 131]
    left = {(v.doc_id, v.e): (v.loop, v.step) for v in raster.loops(pixels(spark, *pictures)).collect()}
    for d, lines in enumerate(pictures):
        at = {(y, x): c for y, line in enumerate(lines) for x, c in enumerate(line) if c != "."}
        way = ((-1, 0), (0, 1), (1, 0), (0, -1))
        like = lambda y, x, *ways: at.get((y + sum(way[w % 4][0] for w in ways), x + sum(way[w % 4][1] for w in ways))) == at[y, x]  # noqa: B023, E731
        for y, x in sorted(at):
            for w in range(4):
                if like(y, x, w) or (d, (y * raster.WIDE + x) * 4 + w) not in left:
                    continue
                name, step, (ry, rx, v) = (y * raster.WIDE + x) * 4 + w, 0, (y, x, w)
                while step == 0 or (ry, rx, v) != (y, x, w):
                    assert left.pop((d, (ry * raster.WIDE + rx) * 4 + v)) == (name, step)
                    step += 1
                    if not like(ry, rx, v + 1):
                        v = (v + 1) % 4
                    elif not like(ry, rx, v, v + 1):
                        ry, rx = ry + way[(v + 1) % 4][0], rx + way[(v + 1) % 4][1]
                    else:
                        ry, rx, v = ry + way[v][0] + way[(v + 1) % 4][0], rx + way[v][1] + way[(v + 1) % 4][1], (v + 3) % 4
    assert not left


def test_boundaries_of_small_pictures_take_no_rounds(spark, monkeypatch):
    """Every doubling was a table of all sides."""
    tables, real = [], raster.kept
    monkeypatch.setattr(raster, "kept", lambda df, label: tables.append(label) or real(df, label))
    raster.loops(pixels(spark, SQUARE, HOLE, TOUCH)).collect()
    assert tables == ["sides"]
