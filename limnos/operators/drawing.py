"""Drawings in SVG as tables: instances of elements with what they inherit, shapes, gradients, warnings, transforms put into geometry.

An instance is an element as it is drawn, named by its chain: the nodes from the root to it, through every ``use`` on the way. Groups, links
and nested drawings are walked; ``use`` is resolved by joining references to ids, one join for each level of nesting and ``MAX_USES`` at most.
Style and transform of an instance are folds over its chain.

Defined cases: a reference to an id that is not there, or beyond the depth, draws nothing and is a warning; of equal ids the first counts; a transform
that can't be read counts as none and is a warning; documents without drawable elements have no shapes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..sources.markup import attr
from ..sources.storage import kept
from .styles import KEYS, own_styles, resolved, safe, style_rules

# What is walked, drawn, kept unread in defs, or ignored; how deep references may go.
WALKED = ("g", "svg", "a")
SHAPES = ("path", "rect", "circle", "ellipse", "line", "polygon", "polyline", "text", "image")
KEPT = ("clipPath", "mask", "filter", "pattern", "marker")
GRADIENTS = ("linearGradient", "radialGradient")
IGNORED = ("metadata", "title", "desc", "foreignObject")
PROTOTYPES = ("symbol", "g", *[s for s in SHAPES])
MAX_USES = 6
NUMBER = r"^\s*(-?\d+(?:\.\d+)?)"
WALK = "^(?:(?:" + "|".join(WALKED) + ")/)*[^/]+$"


def number(value: Column, default: float | None = None) -> Column:
    """The number that a length starts with."""
    found = F.regexp_extract(value, NUMBER, 1).try_cast("double")  # no number where nothing is found
    return found if default is None else F.coalesce(found, F.lit(default))


def canvas(nodes: DataFrame) -> DataFrame:
    """doc_id, width, height of each document's root."""
    box = F.transform(F.filter(F.split(attr("viewBox"), r"[,\s]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    side = lambda k, name: F.coalesce(F.get(box, F.lit(k)), number(attr(name), 100.0)).alias(name)
    return nodes.filter("node = 0").select("doc_id", side(2, "width"), side(3, "height"))


def _reference(href: Column) -> Column:
    return F.when(href.startswith("#"), F.substring(href, 2, 1_000_000))


def instances(nodes: DataFrame, most: int = MAX_USES, carried: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, node, tag, href, inst (the chain) and what is carried of all that is reached, uses included; and the uses that were too deep.

    Carried columns are computed from the element's own row. A level of uses is written once: whether it is empty, the next level and every reader need it.
    """
    carried = {"attrs": F.col("attrs")} if carried is None else carried
    columns = [*KEYS, "tag", "href", *carried, "inst"]
    elements = nodes.filter("tag <> '#text'").withColumns({"href": attr("href"), **carried})
    reached = elements.filter(F.col("path").rlike(WALK)).withColumn("inst", F.col("chain")).select(*columns)
    targets = elements.filter(attr("id").isNotNull()).groupBy("doc_id", attr("id").alias("ref")).agg(F.min_by(F.struct("node", "tag", "path", "chain"), "node").alias("t"))
    below = elements.select("doc_id", F.explode("named").alias("top"), "node", "tag", "href", *carried, "path", "chain")
    found, level = [reached], reached.filter("tag = 'use'")
    for _ in range(most):
        if level.isEmpty():
            break
        asked = level.select("doc_id", "inst", _reference(F.col("href")).alias("ref")).filter("ref IS NOT NULL").join(targets, ["doc_id", "ref"])
        group = F.col("t.tag").isin("symbol", "g")
        # Of a group or symbol only the content is drawn, without the style and transform of the group itself.
        start = F.size("t.chain") + group.cast("int")
        asked = asked.select("doc_id", F.col("inst").alias("via"), F.col("t.node").alias("top"), start.alias("start"), (F.length("t.path") - F.length("t.tag")).alias("cut"), F.when(group, F.length("t.tag") + 1).otherwise(0).alias("more"))
        met = asked.join(below, ["doc_id", "top"]).filter((F.size("chain") >= F.col("start")) & F.substring("path", F.col("cut") + F.col("more") + 1, F.length("path")).rlike(WALK))
        new = kept(met.select("doc_id", "node", "tag", "href", *carried, F.concat("via", F.slice("chain", F.col("start"), F.size("chain"))).alias("inst")), "used")
        found.append(new)
        level = new.filter("tag = 'use'")
    return reduce(DataFrame.unionByName, found), level


def _maps(nodes: DataFrame) -> DataFrame:
    """doc_id, _link, own (six numbers) of every element that has a transform or, as a use, a place; a transform that can't be read moves nothing."""
    moved = F.when(F.col("tag") == "use", M.Matrix.of(1, 0, 0, 1, number(attr("x"), 0.0), number(attr("y"), 0.0)).struct()).otherwise(M.Matrix.of(1, 0, 0, 1, 0, 0).struct())
    given = nodes.filter("tag <> '#text'").filter(attr("transform").isNotNull() | (F.col("tag") == "use"))
    one = given.select("doc_id", F.col("node").alias("_link"), M.parse(attr("transform")).alias("m"), moved.alias("u"))
    read = F.coalesce("m", M.Matrix.of(1, 0, 0, 1, 0, 0).struct())
    return one.select("doc_id", "_link", read.alias("r"), "u").select("doc_id", "_link", (M.Matrix.read(F.col("r")) @ M.Matrix.read(F.col("u"))).struct().alias("own"))


def shapes(nodes: DataFrame) -> DataFrame:
    """doc_id, shape_index, inst, node, tag, attrs (own and inherited, safe ones only), text, matrix (null for none), dieline of every shape drawn."""
    every, _ = instances(nodes)
    drawn = every.filter(F.col("tag").isin(*SHAPES))
    links = drawn.select("doc_id", "inst", F.posexplode("inst").alias("_at", "_link"))
    by = ["doc_id", "inst"]
    styles = resolved(drawn, own_styles(nodes), ("doc_id", "inst"), "inst").filter(safe(F.col("name"), F.col("value")))
    styles = styles.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("style"))
    steps = links.join(_maps(nodes), ["doc_id", "_link"]).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", "own"))).alias("steps"))
    none = M.Matrix.of(1, 0, 0, 1, 0, 0).struct()
    steps = steps.select(*by, F.aggregate("steps", none, lambda a, s: (M.Matrix.read(a) @ M.Matrix.read(s.own)).struct()).alias("m"))
    marks = nodes.filter((attr("id") == "dieline") | F.array_contains(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), "dieline")).select("doc_id", F.col("node").alias("_link"))
    marked = links.join(marks, ["doc_id", "_link"]).select(*by).distinct().withColumn("dieline", F.lit(True))
    runs = nodes.filter("tag = '#text'").select("doc_id", "text", "node", F.explode("chain").alias("top")).filter("top <> node")
    inner = nodes.filter("tag = 'text'").select("doc_id", F.col("node").alias("top")).join(runs, ["doc_id", "top"])
    said = inner.groupBy("doc_id", F.col("top").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda r: r.text), "").alias("said"))
    # The text is brought to the instances over narrow rows, so that those with attributes are not exchanged by node too.
    said = drawn.filter("tag = 'text'").select(*KEYS, "inst").join(said, list(KEYS)).select(*by, "said")
    out = drawn.join(styles, by, "left").join(steps, by, "left").join(marked, by, "left").join(said, by, "left")
    own = F.map_filter("attrs", lambda k, v: ~k.isin("style", "transform", "class") & safe(k, v))
    style = F.map_filter(F.coalesce("style", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.map_contains_key(own, k))
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("inst")) - 1).cast("long")
    matrix = F.when(~M.Matrix.read(F.col("m")).is_identity(), F.col("m"))
    text = F.trim(F.regexp_replace(F.coalesce("said", F.lit("")), r"\s+", " "))
    return out.select("doc_id", index.alias("shape_index"), "inst", "node", "tag", F.map_concat(own, style).alias("attrs"), text.alias("text"), matrix.alias("matrix"), F.coalesce("dieline", F.lit(False)).alias("dieline"))


def gradients(nodes: DataFrame) -> DataFrame:
    """doc_id, node, id, kind, coords, stops (offset, color) of every gradient that is defined where the walk or a defs element has it."""
    here = nodes.filter(F.col("tag").isin(*GRADIENTS) & F.col("path").rlike("^(?:(?:" + "|".join(WALKED) + ")/)*(?:defs/)?[^/]+$"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("node")) - 1
    linear = F.col("tag") == "linearGradient"
    keys = F.when(linear, F.array(*map(F.lit, ("x1", "y1", "x2", "y2")))).otherwise(F.array(*map(F.lit, ("cx", "cy", "r"))))
    coords = F.map_from_entries(F.transform(F.filter(keys, lambda k: F.map_contains_key("attrs", k)), lambda k: F.struct(k, number(F.col("attrs")[k], 0.0))))
    heads = here.select(*KEYS, F.coalesce(attr("id"), F.concat(F.lit("grad"), order.cast("string"))).alias("id"), F.when(linear, "linear").otherwise("radial").alias("kind"), coords.alias("coords"))
    raw = F.coalesce(attr("offset"), F.lit("0"))
    offset = F.when(raw.endswith("%"), F.regexp_replace(raw, "%$", "").try_cast("double") / 100).otherwise(raw.try_cast("double"))
    color = F.coalesce(attr("stop-color"), F.nullif(F.trim(F.regexp_extract(attr("style"), r"(?:^|;)\s*stop-color\s*:([^;]*)", 1)), F.lit("")), F.lit("#000000"))
    stops = nodes.filter("tag = 'stop'").select("doc_id", F.col("parent").alias("node"), F.struct(F.col("node").alias("k"), offset.alias("offset"), color.alias("color")).alias("s"))
    stops = stops.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s.offset.alias("offset"), s.color.alias("color"))).alias("stops"))
    return heads.join(stops, list(KEYS), "left")


def paints(drawn: DataFrame, defs: DataFrame) -> DataFrame:
    """doc_id, shape_index, property, kind, stops of every fill or stroke that names a gradient; of equal ids the first counts."""
    named = drawn.select("doc_id", "shape_index", F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.regexp_extract(attr(p), r"^\s*url\(\s*#([^)\s]+)\s*\)", 1).alias("id")) for p in ("fill", "stroke")])).alias("p"))
    named = named.select("doc_id", "shape_index", "p.*").filter("id <> ''")
    first = defs.groupBy("doc_id", "id").agg(F.min_by(F.struct("kind", "stops"), "node").alias("g"))
    return named.join(first, ["doc_id", "id"]).select("doc_id", "shape_index", "property", "id", "g.kind", "g.stops")


def _remarks(known: tuple[str, ...]) -> Column:
    """Array of (kind, detail): what an element's own row tells once it is reached."""
    tag, none = F.col("tag"), F.array().cast("array<struct<kind:string,detail:string>>")
    say = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    one = F.when(tag == "script", say("script", tag)).when(tag == "foreignObject", say("foreign", tag)).when(~tag.isin(*known), say("unknown", tag))
    one = one.when((tag == "use") & _reference(attr("href")).isNull(), say("use without reference", tag))
    bad = F.map_keys(F.map_filter("attrs", lambda k, v: ~safe(k, v) & ~k.isin("style", "transform", "class")))
    unsafe = F.when(tag.isin(*SHAPES), F.transform(bad, lambda k: say("unsafe attribute", k)))
    unread = F.when(attr("transform").isNotNull(), F.when(M.parse(attr("transform")).isNull(), F.array(say("transform", tag))))
    return F.concat(F.array_compact(F.array(one)), F.coalesce(unsafe, none), F.coalesce(unread, none))


def warnings(nodes: DataFrame) -> DataFrame:
    """doc_id, kind, detail of all that was dropped, simplified or not understood; each once for a document.

    What an element's own row tells is told by it and carried along, so that only references and spans are joins.
    """
    known = (*WALKED, *SHAPES, *KEPT, *GRADIENTS, *IGNORED, "defs", "style", "script", "use")
    every, deep = instances(nodes, carried={"remarks": _remarks(known)})
    say = lambda df, kind, detail: df.select("doc_id", F.lit(kind).alias("kind"), detail.alias("detail"))
    tag = F.col("tag")
    in_defs = nodes.filter(F.col("path").rlike("^(?:(?:" + "|".join(WALKED) + ")/)*defs/[^/]+$") & (tag != "#text"))
    in_defs = in_defs.select("doc_id", F.when(tag.isin(*KEPT), "kept").when(~tag.isin(*GRADIENTS, *PROTOTYPES), "dropped").alias("kind"), tag.alias("detail"))
    ids = nodes.filter(attr("id").isNotNull()).select("doc_id", attr("id").alias("ref")).distinct()
    asked = every.filter("tag = 'use'").select("doc_id", "href", _reference(F.col("href")).alias("ref")).filter("ref IS NOT NULL").distinct()
    spans = nodes.filter("tag = 'tspan'").select("doc_id", F.col("parent").alias("node"))
    found = [
        every.filter(F.size("remarks") > 0).select("doc_id", F.explode("remarks").alias("r")).select("doc_id", "r.*"), in_defs.filter("kind IS NOT NULL"),
        say(asked.join(ids, ["doc_id", "ref"], "left_anti"), "use of missing id", F.col("href")), say(deep, "use too deep", tag),
        say(style_rules(nodes).filter("kind IS NULL"), "selector", F.col("selector")), say(every.filter("tag = 'text'").select(*KEYS).join(spans, list(KEYS), "left_semi"), "spans", F.lit("text")),
    ]
    return reduce(DataFrame.unionByName, found).distinct()


#: Lengths that a shape's matrix may change, each read once.
LENGTHS = ("x", "y", "width", "height", "cx", "cy", "r", "rx", "ry", "x1", "y1", "x2", "y2", "stroke-width", "font-size")


def baked(drawn: DataFrame) -> DataFrame:
    """shapes with the matrix put into the geometry where that is exact (then null), and baked: whether that was so; null without a matrix.

    Numbers are read, moved and written in steps: in one, each would be read again wherever it is used, and the row's method would be too long for the JVM to compile.
    """
    m, tag, moved = M.Matrix.read(F.col("matrix")), F.col("tag"), F.col("matrix").isNotNull()
    lengths = F.transform_values(F.map_filter("attrs", lambda k, v: k.isin(*LENGTHS)), lambda k, v: number(v))
    out = drawn.withColumn("_n", F.when(moved, lengths))
    num, zero = lambda k: F.col("_n")[k], lambda k: F.coalesce(F.col("_n")[k], F.lit(0.0))
    axis, uniform, factor = m.is_axis_aligned(), m.is_uniform_scale(), m.scale_factor()
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    scaled = lambda *keys: [F.when(num(k).isNotNull(), entry(k, num(k) * factor)) for k in keys]

    def place(x: str, y: str) -> list[Column]:
        px, py = m.apply(zero(x), zero(y))
        return [entry(x, px), entry(y, py)]

    ax, ay = m.apply(zero("x"), zero("y"))
    bx, by = m.apply(zero("x") + num("width"), zero("y") + num("height"))
    rect = [entry("x", F.least(ax, bx)), entry("y", F.least(ay, by)), entry("width", F.abs(bx - ax)), entry("height", F.abs(by - ay)), *scaled("rx", "ry")]
    cases = [
        (tag.isin("rect", "image") & axis & num("width").isNotNull() & num("height").isNotNull(), rect), ((tag == "circle") & axis & uniform & num("r").isNotNull(), [*place("cx", "cy"), entry("r", num("r") * factor)]),
        ((tag == "ellipse") & axis & num("rx").isNotNull() & num("ry").isNotNull(), [*place("cx", "cy"), entry("rx", num("rx") * F.abs(m.a)), entry("ry", num("ry") * F.abs(m.d))]),
        ((tag == "text") & axis & uniform, place("x", "y")), (tag == "line", [*place("x1", "y1"), *place("x2", "y2")]), (tag.isin("polygon", "polyline"), []),
    ]
    sized = [F.when(uniform, e) for e in scaled("stroke-width", "font-size")]
    new = F.lit(None).cast("array<struct<key:string,value:double>>")
    for when, entries in cases:
        new = F.when(when, F.array_compact(F.array(*entries, *sized))).otherwise(new)
    out = out.withColumn("_values", F.when(moved, new))
    pairs = F.regexp_extract_all(attr("points"), F.lit(r"(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)"), F.lit(1))
    corner = lambda i: m.apply(F.get(pairs, 2 * i).cast("double"), F.get(pairs, 2 * i + 1).cast("double"))
    half = F.floor(F.size(pairs) / 2).cast("int")
    point = lambda i: F.concat(M.two_decimals(corner(i)[0]), F.lit(","), M.two_decimals(corner(i)[1]))
    points = F.when(half > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(half, F.lit(1)) - 1), point), " ")).otherwise("")
    texts = F.transform("_values", lambda e: F.struct(e.key.alias("key"), M.two_decimals(e.value).alias("value")))
    texts = F.when(tag.isin("polygon", "polyline"), F.concat(texts, F.array(entry("points", points)))).otherwise(texts)
    out = out.withColumn("_new", F.when(F.col("_values").isNotNull(), F.map_from_entries(texts)))
    ok = F.col("_new").isNotNull()
    over = F.map_filter("attrs", lambda k, v: ~F.map_contains_key("_new", k))
    return out.select(
        *[c for c in drawn.columns if c not in ("attrs", "matrix")], F.when(ok, F.map_concat(over, "_new")).otherwise(F.col("attrs")).alias("attrs"),
        F.when(~ok, F.col("matrix")).alias("matrix"), F.when(moved, ok).alias("baked"),
    )


def escaped(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def written_shapes(drawn: DataFrame) -> DataFrame:
    """doc_id, shape_index, markup of every shape: its attributes by name, its transform if one is left, its text."""
    entries = F.array_sort(F.map_entries("attrs"))
    attrs = F.array_join(F.transform(entries, lambda e: F.concat(F.lit(" "), e.key, F.lit('="'), escaped(e.value), F.lit('"'))), "")
    six = [M.decimals(F.col(f"matrix.{k}"), 6) for k in "abcdef"]
    move = F.when(F.col("matrix").isNotNull(), F.concat(F.lit(' transform="matrix('), F.concat_ws(" ", *six), F.lit(')"'))).otherwise("")
    end = F.when(F.col("tag") == "text", F.concat(F.lit(">"), escaped(F.col("text")), F.lit("</text>"))).otherwise("/>")
    return drawn.select("doc_id", "shape_index", F.concat(F.lit("<"), "tag", attrs, move, end).alias("markup"))
