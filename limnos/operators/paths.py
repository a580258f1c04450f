"""The path language of drawings: commands, current points, vertices, areas, bounds, maps.

A path is read into commands by patterns of built-in functions. Its vertices, area and bounds are one numpy pass over the commands of an Arrow batch of paths:
no exchange, no sort, no join, so that the time grows with the paths. ``segments`` has the commands in rows with their points instead, built-in functions only: what a
drawing program keeps in variables is a running sum there: an absolute coordinate starts the sum anew, a relative one adds to it, a move or close goes back
to the subpath's start, which is such a sum itself over the moves. Reflected control points are lags, in chains of ``T`` alternating sums. That costs one
exchange by key and some sorts.

Defined cases: a null, empty or malformed path has a fault and no commands, vertices or area; values after a move are lines; flags of arcs are single
characters, also run together; a path that does not begin with a move starts at 0 0; subpaths of fewer than two vertices are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrix as M

# The language. For each command what its values are: positions, lengths, or neither.
VALUES = {"M": "xy", "L": "xy", "H": "x", "V": "y", "C": "xyxyxy", "S": "xyxy", "Q": "xyxy", "T": "xy", "A": "llrffxy", "Z": ""}
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
GAP = r"[ \t\n\r,]*"
LETTERS = "MmLlHhVvCcSsQqTtAaZz"
ARC = GAP + GAP.join(f"({p})" for p in (NUMBER, NUMBER, NUMBER, "[01]", "[01]", NUMBER, NUMBER))
CURVE, ARCS = 8, 2  # vertices of a curve; those of an arc, in curves
COUNTED, COUNTS = "".join(VALUES).lower(), [len(v) for v in VALUES.values()]
KEYS = ("doc_id", "shape_index")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _pick(name: Column, of: dict[str, Column]) -> Column:
    out = F.lit(None)
    for k, v in of.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def parsed(d: Column) -> Column:
    """Struct of commands (array of name, p) and fault (null if all was read)."""
    # Read bottom up, everything once: these expressions run interpreted, for every command of every path.
    parts = F.regexp_extract_all(d, F.lit(f"[{LETTERS}][^{LETTERS}]*"), F.lit(0))
    blank = lambda text: F.btrim(text, F.lit(" \t\n\r,")) == ""
    numbers = lambda v: F.transform(v, lambda x: x.cast("double"))

    def plain(rest: Column) -> Column:
        return F.when(blank(F.regexp_replace(rest, NUMBER, "")), numbers(F.regexp_extract_all(rest, F.lit(NUMBER), F.lit(0))))

    def arc(rest: Column) -> Column:
        """Arcs one by one, then the values of each: flags may run together."""
        one = lambda text: numbers(F.array(*[F.regexp_extract(text, ARC, k) for k in range(1, 8)]))
        return F.when(blank(F.regexp_replace(rest, ARC, "")), F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(ARC), F.lit(0)), one)))

    def steps(name: Column, n: Column, v: Column) -> Column:
        """A command for each n values; after a move the others are lines. Null where the values don't fit."""
        one = lambda name, p: F.struct(name.alias("name"), p.alias("p"))
        later = F.when(name == "M", "L").when(name == "m", "l").otherwise(name)
        many = F.transform(F.sequence(F.lit(0), (F.size(v) / n).cast("int") - 1), lambda i: one(F.when(i == 0, name).otherwise(later), F.slice(v, i * n + 1, n)))
        return F.when(F.size(v) == n, F.array(one(name, v))).when((n > 0) & (F.size(v) > 0) & (F.size(v) % n == 0), many)

    def each(part: Column) -> Column:
        kind = F.lower(F.substring(part, 1, 1))
        cut = F.struct(F.substring(part, 1, 1).alias("name"), F.instr(F.lit(COUNTED), kind).alias("at"), F.substring(part, F.lit(2), F.length(part)).alias("rest"))
        read = lambda c: F.struct(c["name"].alias("name"), F.element_at(F.lit(COUNTS), c["at"]).alias("n"), F.when(kind == "a", arc(c.rest)).otherwise(plain(c.rest)).alias("v"))
        return _let(_let(cut, read), lambda c: steps(c["name"], c.n, c.v))

    def told(found: Column) -> Column:
        fault = (
            F.when(F.coalesce(blank(d), F.lit(True)), "empty").when(~blank(F.regexp_extract(d, f"^([^{LETTERS}]*)", 1)), "no command first")
            .when(F.exists(found, lambda x: x.isNull()), "values do not fit")
        )
        return _let(fault, lambda f: F.struct(F.when(f.isNull(), F.flatten(found)).alias("commands"), f.alias("fault")))

    return _let(F.transform(parts, each), told)


def commands(paths: DataFrame, *more: str) -> DataFrame:
    """doc_id, shape_index, fault and commands of paths (doc_id, shape_index, d), and more of their columns."""
    return paths.select(*KEYS, *more, parsed(F.col("d")).alias("r")).select(*KEYS, *more, "r.commands", "r.fault")


def segments(paths: DataFrame) -> DataFrame:
    """doc_id, shape_index, k, sub, name (in capitals), sx, sy (start of the subpath), ax, ay (from), bx, by (first control), cx, cy (second), x, y (to), p of every command."""
    c, up = F.col, F.upper("name")
    one = commands(paths).select(*KEYS, F.posexplode("commands").alias("k", "q")).select(*KEYS, "k", "q.name", "q.p")
    got = lambda i: F.get("p", F.lit(i))
    end = lambda axis: _pick(up, {n: got(len(v) - 1 - v[::-1].index(axis)) for n, v in VALUES.items() if axis in v})
    rel = c("name") == F.lower("name")
    w = Window.partitionBy(*KEYS).orderBy("k")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumns({"u": up, "rel": rel, "px": end("x"), "py": end("y")})
    one = one.withColumn("sub", F.sum((c("u") == "M").cast("int")).over(run))
    for a in "xy":
        given, home = c(f"p{a}"), c("u").isin("M", "Z")
        anew = home | (~c("rel") & given.isNotNull())
        one = one.withColumn(f"g{a}", F.sum(anew.cast("int")).over(run))
        group = Window.partitionBy(*KEYS, f"g{a}").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # Since the last new beginning: where it was (null: the subpath's start) and what was added.
        one = one.withColumns({
            f"from{a}": F.sum(F.when(anew & ~home, given)).over(group), f"off{a}": F.sum(F.when(c("rel") & ~home, F.coalesce(given, F.lit(0.0))).otherwise(0.0)).over(group),
        })
    for a in "xy":
        before_from, before_off = F.lag(f"from{a}").over(w), F.coalesce(F.lag(f"off{a}").over(w), F.lit(0.0))
        one = one.withColumns({f"_f{a}": before_from, f"_o{a}": before_off})
        move, given = c("u") == "M", c(f"p{a}")
        anew = move & (~c("rel") | c(f"_f{a}").isNotNull())
        added = F.when(move & ~c("rel"), given).when(move, F.coalesce(c(f"_f{a}"), F.lit(0.0)) + c(f"_o{a}") + given).otherwise(0.0)
        one = one.withColumns({f"h{a}": F.sum(anew.cast("int")).over(run), f"_d{a}": added})
        home = Window.partitionBy(*KEYS, f"h{a}").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        one = one.withColumn(f"s{a}", F.sum(f"_d{a}").over(home))
        one = one.withColumn(a, F.coalesce(c(f"from{a}"), c(f"s{a}")) + c(f"off{a}"))
    one = one.withColumns({f"a{a}": F.coalesce(F.lag(a).over(w), F.lit(0.0)) for a in "xy"})
    origin = lambda a: F.when(c("rel"), c(f"a{a}")).otherwise(0.0)
    at = lambda a, i: origin(a) + got(i + (a == "y"))
    one = one.withColumns({f"c{a}": F.when(c("u") == "C", at(a, 2)).when(c("u") == "S", at(a, 0)) for a in "xy"})
    last = F.lag("u").over(w)
    one = one.withColumns({"last": last, **{f"_c{a}": F.lag(f"c{a}").over(w) for a in "xy"}})
    on = (c("u") == "T") & F.coalesce(c("last").isin("Q", "T"), F.lit(False))
    one = one.withColumn("chain", F.sum((~on).cast("int")).over(run))
    chain = Window.partitionBy(*KEYS, "chain").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumn("j", F.row_number().over(chain) - 1).withColumn("sign", 1 - 2 * (c("j") % 2))
    first = {a: F.when(c("u") == "Q", at(a, 0)).when(c("u") == "T", c(f"a{a}")) for a in "xy"}
    one = one.withColumns({f"_t{a}": c("sign") * F.sum(F.when(c("j") == 0, first[a]).otherwise(2 * c("sign") * c(f"a{a}"))).over(chain) for a in "xy"})
    near = lambda a: F.when(c("last").isin("C", "S"), 2 * c(f"a{a}") - c(f"_c{a}")).otherwise(c(f"a{a}"))
    one = one.withColumns({f"b{a}": F.when(c("u") == "C", at(a, 0)).when(c("u") == "S", near(a)).when(c("u").isin("Q", "T"), c(f"_t{a}")) for a in "xy"})
    return one.select(*KEYS, "k", "sub", c("u").alias("name"), "sx", "sy", "ax", "ay", "bx", "by", "cx", "cy", "x", "y", "p")


class _Flat:
    """The commands of a batch of paths, one after the other: path, k, name (a capital's code), sub, ring (number of the subpath in the batch), points as in ``segments``."""

    def __init__(self, batch: pa.Array):
        size = pc.fill_null(pc.list_value_length(batch), 0).to_numpy()
        flat = batch.flatten()
        code, given = pc.struct_field(flat, "name").to_numpy(zero_copy_only=False).astype("S1").view(np.uint8), pc.struct_field(flat, "p")
        self.paths, n = len(batch), len(code)
        self.path, first = np.repeat(np.arange(self.paths), size), np.cumsum(size) - size
        self.k = np.arange(n) - first[self.path]
        self.rel, self.name = code >= ord("a"), code & 0xDF
        move = self.is_("M")
        self.ring = np.cumsum(move | (self.k == 0)) - 1
        moves = np.cumsum(move)
        self.sub = moves - (moves - move)[first[self.path]] if n else moves
        held = given.value_lengths().to_numpy()
        self.p = np.full((n, 7), np.nan)
        self.p[np.repeat(np.arange(n), held), np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)] = given.flatten().to_numpy()
        self._walk(size, first)

    def is_(self, names: str) -> np.ndarray:
        return np.isin(self.name, np.frombuffer(names.encode(), np.uint8))

    def _given(self, axis: str) -> np.ndarray:
        """The coordinate that a command ends at, as written; NaN where it has none."""
        out = np.full(len(self.path), np.nan)
        for name, kinds in VALUES.items():
            if axis in kinds:
                at = self.name == ord(name)
                out[at] = self.p[at, len(kinds) - 1 - kinds[::-1].index(axis)]
        return out

    def _walk(self, size: np.ndarray, first: np.ndarray) -> None:
        """Current points, k by k over all paths that are so long."""
        n, (move, close) = len(self.path), (self.is_("M"), self.is_("Z"))
        longest = np.argsort(-size, kind="stable")
        first, size = first[longest], size[longest]
        for axis in "xy":
            given = self._given(axis)
            some, step = ~np.isnan(given), np.nan_to_num(given)
            # Where the point was set anew (at the subpath's start, if home), and what was added since.
            home, base, off, start = np.ones(self.paths, bool), np.zeros(self.paths), np.zeros(self.paths), np.zeros(self.paths)
            came, ends, starts = np.zeros(n), np.zeros(n), np.zeros(n)
            for k in range(size[0] if self.paths else 0):
                m = np.searchsorted(-size, -k)  # paths with more than k commands
                i = first[:m] + k
                h, b, o, s = home[:m], base[:m], off[:m], start[:m]
                came[i] = np.where(h, s, b) + o
                r, g, mv, anew = self.rel[i], step[i], move[i], some[i] & ~self.rel[i]
                s = np.where(mv, np.where(r, np.where(h, s, b) + o, 0.0) + g, s)
                h = mv | close[i] | (h & ~anew)
                b, o = np.where(anew, g, b), np.where(mv | close[i] | anew, 0.0, np.where(r, o + g, o))
                home[:m], base[:m], off[:m], start[:m] = h, b, o, s
                ends[i], starts[i] = np.where(h, s, b) + o, s
            setattr(self, f"a{axis}", came), setattr(self, axis, ends), setattr(self, f"s{axis}", starts)
            self._controls(axis, first, size)

    def _controls(self, axis: str, first: np.ndarray, size: np.ndarray) -> None:
        here, second = getattr(self, f"a{axis}"), int(axis == "y")
        origin = np.where(self.rel, here, 0.0)
        cubic, smooth, quad = self.is_("C"), self.is_("S"), self.is_("QT")
        c = origin + np.where(cubic, self.p[:, 2 + second], self.p[:, second])
        b, before = origin + self.p[:, second], np.arange(len(here)) - 1
        after = lambda names: (self.k > 0) & self.is_(names)[before]
        b = np.where(smooth, np.where(after("CS"), 2 * here - c[before], here), b)
        on, alone = self.is_("T") & after("QT"), self.is_("T")
        b = np.where(alone, here, b)
        for k in np.unique(self.k[on]):  # each reflects the one before, which is decided by then
            i = np.flatnonzero(on & (self.k == k)) if len(first) < 64 else (first[: np.searchsorted(-size, -k)] + k)
            i = i[on[i]]
            b[i] = 2 * here[i] - b[i - 1]
        setattr(self, f"b{axis}", np.where(cubic | smooth | quad, b, np.nan)), setattr(self, f"c{axis}", c)

    def drawn(self, curve: int) -> _Drawn:
        """Vertices: curves as ``curve`` chords, arcs as twice as many; lines where a radius is 0 or an arc ends where it begins."""
        cubic, quad, arc, close = self.is_("CS"), self.is_("QT"), self.is_("A"), self.is_("Z")
        arc &= (self.p[:, 0] != 0) & (self.p[:, 1] != 0) & ((self.ax != self.x) | (self.ay != self.y))
        n = np.where(cubic | quad, curve, np.where(arc, curve * ARCS, 1))
        n[close & ~(((self.ax != self.sx) | (self.ay != self.sy)) & (self.k > 0))] = 0
        rings = self.ring[-1] + 1 if len(self.ring) else 0
        n[np.bincount(self.ring, n, rings)[self.ring] < 2] = 0
        at = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + 1
        xy = {a: getattr(self, a)[at] for a in "xy"}
        for kind, weights in ((cubic, CUBIC), (quad, QUAD)):
            on = kind[at]
            t, s = i[on] / curve, at[on]
            for a in "xy":
                xy[a][on] = sum(w(t) * getattr(self, k + a)[s] for k, w in weights.items())
        self._arcs(xy, arc[at] & (i < n[at]), at, i / (curve * ARCS))
        return _Drawn(self, at, xy["x"], xy["y"])

    def _arcs(self, xy: dict[str, np.ndarray], on: np.ndarray, at: np.ndarray, share: np.ndarray) -> None:
        """Vertices of arcs by centre, radii and angles."""
        s, t = at[on], share[on]
        v, ax, ay, x, y = self.p[s].T, self.ax[s], self.ay[s], self.x[s], self.y[s]
        cos, sin = np.cos(np.radians(v[2])), np.sin(np.radians(v[2]))
        hx, hy = (ax - x) / 2, (ay - y) / 2
        ux, uy = cos * hx + sin * hy, cos * hy - sin * hx
        grown = np.maximum(1.0, np.sqrt((ux / v[0]) ** 2 + (uy / v[1]) ** 2))  # radii too small to reach are grown
        rx, ry = np.abs(v[0]) * grown, np.abs(v[1]) * grown
        px, py = ux / rx, uy / ry  # the half chord where the ellipse is a circle of radius 1
        q = px * px + py * py
        aside = np.sqrt(np.maximum(0.0, (1 - q) / q)) * np.where(v[3] == v[4], -1.0, 1.0)
        mx, my = aside * py, -aside * px
        begin = np.arctan2(py - my, px - mx)
        swept = np.arctan2(-py - my, -px - mx) - begin
        swept = np.where((v[4] == 0) & (swept > 0), swept - 2 * math.pi, np.where((v[4] != 0) & (swept < 0), swept + 2 * math.pi, swept))
        turn = begin + swept * t
        ex, ey = rx * (mx + np.cos(turn)), ry * (my + np.sin(turn))
        xy["x"][on], xy["y"][on] = (ax + x) / 2 + cos * ex - sin * ey, (ay + y) / 2 + sin * ex + cos * ey


class _Drawn:
    """Vertices of a batch, in order: path, sub, ring, v (from 0 in its subpath), x, y."""

    def __init__(self, flat: _Flat, at: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.paths, self.path, self.sub, self.ring, self.x, self.y = flat.paths, flat.path[at], flat.sub[at], flat.ring[at], x, y
        self.begins = np.flatnonzero(np.diff(self.ring, prepend=-1))
        self.of = np.repeat(self.begins, np.diff(self.begins, append=len(at)))  # the first vertex of each one's subpath
        self.v = np.arange(len(at)) - self.of

    def rows(self, readable: np.ndarray) -> tuple[np.ndarray, dict]:
        return self.path, {"sub": self.sub, "v": self.v.astype(np.int32), "x": self.x, "y": self.y}

    def areas(self, readable: np.ndarray) -> tuple[np.ndarray, dict]:
        ahead = np.arange(1, len(self.x) + 1)
        ahead[np.append(self.begins[1:], len(self.x))[: len(self.begins)] - 1] = self.begins
        cross = self.x * self.y[ahead] - self.x[ahead] * self.y
        each = {"subpaths": np.bincount(self.path[self.begins], minlength=self.paths), "vertices": np.bincount(self.path, minlength=self.paths), "area": np.abs(np.bincount(self.path, cross, self.paths) / 2)}
        return readable, {k: v[readable] for k, v in each.items()}

    def bounds(self, readable: np.ndarray) -> tuple[np.ndarray, dict]:
        first = np.flatnonzero(np.diff(self.path, prepend=-1))
        sides = {"x0": (np.minimum, self.x), "y0": (np.minimum, self.y), "x1": (np.maximum, self.x), "y1": (np.maximum, self.y)}
        return self.path[first], {k: far.reduceat(v, first) if len(first) else v for k, (far, v) in sides.items()}


CUBIC = {"": lambda t: t**3, "a": lambda t: (1 - t) ** 3, "b": lambda t: 3 * (1 - t) ** 2 * t, "c": lambda t: 3 * (1 - t) * t**2}
QUAD = {"": lambda t: t**2, "a": lambda t: (1 - t) ** 2, "b": lambda t: 2 * (1 - t) * t}


def _by_path(paths: DataFrame, curve: int, use, shape: str) -> DataFrame:
    """doc_id, shape_index and what ``use`` makes of the vertices, batch by batch."""
    read = commands(paths)
    types = {f.name: f.dataType for f in read.schema if f.name in KEYS}

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(all="ignore"):
                at, columns = use(_Flat(batch["commands"]).drawn(curve), np.flatnonzero(pc.is_valid(batch["commands"]).to_numpy(zero_copy_only=False)))
            yield pa.record_batch([*[batch[k].take(pa.array(at)) for k in KEYS], *[pa.array(v) for v in columns.values()]], names=[*KEYS, *columns])

    return read.mapInArrow(drawn, ", ".join(f"{k} {types[k].simpleString()}" for k in KEYS) + ", " + shape)


def vertices(paths: DataFrame, curve: int = CURVE) -> DataFrame:
    """doc_id, shape_index, sub, v (from 0 in its subpath), x, y: curves as ``curve`` chords, arcs as twice as many."""
    return _by_path(paths, curve, _Drawn.rows, "sub long, v int, x double, y double")


def areas(paths: DataFrame, curve: int = CURVE) -> DataFrame:
    """doc_id, shape_index, subpaths, vertices, area of every path that can be read: subpaths of opposite turn are holes."""
    return _by_path(paths, curve, _Drawn.areas, "subpaths long, vertices long, area double")


def bounds(paths: DataFrame, curve: int = 4) -> DataFrame:
    """doc_id, shape_index, x0, y0, x1, y1 of every path with vertices."""
    return _by_path(paths, curve, _Drawn.bounds, "x0 double, y0 double, x1 double, y1 double")


def written(commands: Column) -> Column:
    """Commands as text, numbers with two decimals at most (flags are 0 or 1 anyway)."""
    number = lambda v: F.when(F.abs(v) < math.inf, F.call_function("format_number", v, F.lit("0.##"))).otherwise(v.cast("string"))
    plain = lambda t: F.when(t == "-0", "0").otherwise(t)
    return F.array_join(F.transform(commands, lambda q: F.concat_ws(" ", q["name"], F.transform(F.transform(q.p, number), plain))), " ")


def moved_text(scale: float, dx: float, dy: float) -> Column:
    """The path scaled, then moved; null where it can't be read."""

    def each(q):
        up, get = F.upper(q["name"]), lambda i: F.get(q.p, F.lit(i))
        stay = q["name"] != up
        x, y = (lambda v, by=by: v * scale + F.when(stay, 0.0).otherwise(by) for by in (dx, dy))
        arc = F.array(get(0) * scale, get(1) * scale, get(2), get(3), get(4), x(get(5)), y(get(6)))
        pairs = F.transform(q.p, lambda v, i: F.when((i % 2 == 0) & (up != "V"), x(v)).otherwise(y(v)))
        return F.struct(q["name"].alias("name"), F.when(up == "A", arc).when(stay, F.transform(q.p, lambda v: v * scale)).otherwise(pairs).alias("p"))

    return F.when(F.col("fault").isNull(), written(F.transform("commands", each)))


def moved(paths: DataFrame, scale: float, dx: float, dy: float) -> DataFrame:
    """doc_id, shape_index, d with every path scaled, then moved; null where it can't be read."""
    return commands(paths).select(*KEYS, moved_text(scale, dx, dy).alias("d"))


def mapped_text() -> tuple[Column, Column]:
    """The path under its ``matrix``, and whether that is exact: see ``mapped``."""
    m = M.Matrix.read(F.col("matrix"))
    axis, even, factor = m.is_axis_aligned(), m.is_axis_aligned() & m.is_uniform_scale(), m.scale_factor()

    def each(q):
        up, still = F.upper(q["name"]), F.when(q["name"] == F.upper(q["name"]), 1.0).otherwise(0.0)
        get = lambda i: F.get(q.p, i)
        image = lambda x, y: (m.a * x + m.c * y + m.e * still, m.b * x + m.d * y + m.f * still)
        level, upright = F.array(image(get(F.lit(0)), F.lit(0.0))[0]), F.array(image(F.lit(0.0), get(F.lit(0)))[1])
        arc = F.concat(F.array(get(F.lit(0)) * factor, get(F.lit(1)) * factor), F.slice(q.p, 3, 3), F.array(*image(get(F.lit(5)), get(F.lit(6)))))
        pairs = F.transform(q.p, lambda v, i: F.when(i % 2 == 0, image(v, get(i + 1))[0]).otherwise(image(get(i - 1), v)[1]))
        return F.struct(q["name"].alias("name"), F.when(up == "H", level).when(up == "V", upright).when(up == "A", arc).otherwise(pairs).alias("p"))

    bent = F.exists("commands", lambda q: (F.upper(q["name"]) == "A") & ~even | F.upper(q["name"]).isin("H", "V") & ~axis)
    exact = F.col("fault").isNull() & ~F.coalesce(bent, F.lit(False))
    return F.when(exact, written(F.transform("commands", each))), exact


def mapped(paths: DataFrame) -> DataFrame:
    """doc_id, shape_index, d, exact: every path (with its ``matrix``) under an affine map.

    Not exact, and null: arcs under a map that is no uniform scale along the axes, level and upright lines under one that turns them.
    """
    d, exact = mapped_text()
    return commands(paths, "matrix").select(*KEYS, d.alias("d"), exact.alias("exact"))
