"""Drawn shapes of a drawing in one pass over the marks of each Arrow batch, without an exchange.

What needs the whole document and nothing else is looked up while it is read: which elements a walk from the root reaches, what a ``use`` refers to, the
sheet, what is inherited, and the runs of text. All that a row can tell by itself (transforms, geometry, numbers, markup) are columns afterwards.
`drawing.shapes` has the same in joins over the table of nodes; a test holds the two together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..sources.markup import elements
from .drawing import MAX_USES, NUMBER, SHAPES, WALKED
from . import styles
from .styles import SAFE_REFERENCE, SPECIFICITY

FIELDS = {
    "shape_index": pa.int64(), "node": pa.int32(), "parent": pa.int32(), "path": pa.string(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()),
    "said": pa.string(), "moves": pa.list_(pa.string()), "dieline": pa.bool_(),
}
SCHEMA = "shape_index long, node int, parent int, path string, tag string, attrs map<string,string>, said string, moves array<string>, dieline boolean"
BATCH = 16_384  # rows handed over at once, those of a last document beyond that included
_REFERENCE, _NUMBER = re.compile(SAFE_REFERENCE.replace("$", r"(?:\r\n|[\n\r\x85  ])?\Z"), re.A), re.compile(NUMBER, re.A)
_COMMENT, _BLOCK, _BLANK, _SPACE = re.compile(r"/\*.*?\*/", re.S), re.compile(r"([^{}]+)\{([^{}]*)\}"), re.compile(r"[\t\n\r\f]"), re.compile(r"\s+", re.A)
_SELECTOR = re.compile(r"(?:(?P<element>[a-zA-Z][\w-]*|\*)|\.(?P<class>[\w-]+)|#(?P<id>[\w-]+))", re.A)
PROPERTIES = frozenset(styles.PROPERTIES)
WALK, DRAWN, USE = range(3)
PARTS = {**dict.fromkeys(WALKED, WALK), **dict.fromkeys(SHAPES, DRAWN), "use": USE}
_ENDS = " \t\n\x0b\f\r"


class _Policy(dict):
    """name: 0 where an attribute of this name is safe, 1 where it is by its value, 2 where it is not."""

    def __missing__(self, name: str) -> int:
        low = name.lower()
        rule = 2 if low.startswith("on") else int(low in ("href", "xlink:href"))
        if len(self) < 10_000:
            self[name] = rule
        return rule


POLICY = _Policy()
#: Attributes that are told otherwise: the sheet and the style are resolved, transforms are moves.
TOLD = _Policy(POLICY, style=2, transform=2)
TOLD["class"] = 2


def _safe(rule: int, value: str) -> bool:
    return rule == 0 or (rule == 1 and _REFERENCE.search(value) is not None)


def _declarations(body: str, lowered: bool) -> list[tuple[str, str]]:
    if not body.isprintable():
        body = _BLANK.sub(" ", body)
    pairs = []
    for p in body.split(";") if ";" in body else (body,):
        name, colon, value = p.partition(":")
        if colon:
            name, value = name.strip(" "), value.strip(" ")
            if not lowered:
                pairs.append((name, value))
            elif name and value:
                pairs.append((name.lower(), value))
    return pairs


def _sheet(nodes: list[list]) -> tuple[dict[tuple[str, str], list[tuple]], dict[str, int]]:
    """(kind, name): (rank, declarations) of the rules that name it; and the first element of each id."""
    rules: dict[tuple[str, str], list[tuple]] = {}
    ids: dict[str, int] = {}
    for k, (_, _, tag, attrs, text) in enumerate(nodes):
        if "id" in attrs:
            ids.setdefault(attrs["id"], k)
        if text is not None and tag != "#text" and tag.lower() == "style":
            for i, (head, body) in enumerate(_BLOCK.findall(_COMMENT.sub("", text) if "/*" in text else text)):
                found = _declarations(body, True)
                for part, raw in enumerate(head.split(",") if found else ()):
                    m = _SELECTOR.fullmatch(raw.strip(_ENDS))
                    if m:
                        kind = m.lastgroup
                        rules.setdefault((kind, m[kind]), []).append(((SPECIFICITY[kind], k, i, part), found))
    return rules, ids


def _ruled(tag: str, attrs: dict[str, str], rules: dict) -> dict[str, str]:
    """What the sheet says of an element."""
    met = rules.get(("element", tag), [])
    if "class" in attrs:
        for c in {*_SPACE.split(attrs["class"])}:
            met = met + rules.get(("class", c), [])
    if "id" in attrs:
        met = met + rules.get(("id", attrs["id"]), [])
    out: dict[str, str] = {}
    for _, found in sorted(met) if len(met) > 1 else met:
        out.update(found)
    return out


def _place(attrs: dict[str, str]) -> str | None:
    x, y = ((m := _NUMBER.match(attrs.get(k, ""))) and m[1] or "0" for k in "xy")
    return None if x == y == "0" else f"translate({x} {y})"


def document(nodes: list[list], emit: Callable) -> None:
    """Tells every shape that is drawn, in paint order: its node, its attributes with what it inherits, its text, the transforms above it from the root, and whether a dieline is."""
    rules, ids = _sheet(nodes)

    def walk(k: int, last: int, uses: int, base: tuple) -> None:
        inside: dict[int, tuple] = {}
        while k <= last:
            parent, end, tag, attrs, _ = nodes[k]
            part = PARTS.get(tag)
            if part is not None:
                style, moves, die = inside.get(parent, base)
                if "transform" in attrs:
                    moves = (*moves, attrs["transform"])
                if not die and (attrs.get("id") == "dieline" or "dieline" in attrs.get("class", "")):
                    die = attrs.get("id") == "dieline" or "dieline" in _SPACE.split(attrs["class"])
                own = _ruled(tag, attrs, rules) if rules else {}
                if part != DRAWN:  # a shape's own attributes are told as they are
                    for n in PROPERTIES & attrs.keys():
                        own[n] = attrs[n]
                if attrs.get("style"):
                    own.update(_declarations(attrs["style"], False))
                if own:
                    style = {**style, **own} if style else own
                if part == WALK:
                    inside[k] = style, moves, die
                    end = k
                elif part == DRAWN:
                    full = {n: v for n, v in attrs.items() if not (rule := TOLD[n]) or (rule == 1 and _safe(1, v))}
                    for n, v in style.items():
                        if n not in full and _safe(POLICY[n], v):
                            full[n] = v
                    said = "".join(nodes[i][4] for i in range(k + 1, end + 1) if nodes[i][2] == "#text") if tag == "text" else None
                    emit(k, tag, full, said, moves, die)
                elif uses < MAX_USES and attrs.get("href", "").startswith("#"):
                    place, top = _place(attrs), ids.get(attrs["href"][1:])
                    if top is not None:
                        # Of a group or symbol only the content is drawn, without the style and transform of the group itself.
                        walk(top + (nodes[top][2] in ("symbol", "g")), nodes[top][1], uses + 1, (style, (*moves, place) if place else moves, die))
            k = end + 1

    walk(0, len(nodes) - 1, 0, ({}, (), False))


def _path(nodes: list[list], k: int | None) -> str:
    tags = []
    while k is not None:
        tags.append(nodes[k][2])
        k = nodes[k][0]
    return "/".join(reversed(tags))


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_nested(kind):
        return pa.array(values, kind)
    ends = pa.array([0, *accumulate(map(len, values))], pa.int32())
    flat = pa.array(list(chain.from_iterable(values)), pa.string())
    if pa.types.is_map(kind):
        return pa.MapArray.from_arrays(ends, flat, pa.array(list(chain.from_iterable(map(dict.values, values))), pa.string()))
    return pa.ListArray.from_arrays(ends, flat)


def _drawn(also: tuple[str, ...], wanted: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = list(FIELDS)

    def batch(ids: pa.Array, owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [_column(c, FIELDS[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
        return pa.record_batch([ids.take(pa.array(owners, pa.int64())), *columns], names=["doc_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            rows: list[tuple] = []
            owners: list[int] = []
            for i, markup in enumerate(given["markup"].to_pylist()):
                if not markup:
                    continue
                nodes, before, count = elements(markup), len(rows), 0

                def emit(k: int, tag: str, attrs: dict, said: str | None, moves: tuple, die: bool) -> None:
                    nonlocal count
                    if not wanted or any(n in attrs for n in wanted):
                        rows.append((count, k, None, None, tag, {n: attrs[n] for n in wanted if n in attrs} if wanted else attrs, said, moves, die))
                    count += 1

                document(nodes, emit)
                if also:
                    rows += [(None, k, n[0], _path(nodes, k), n[2], n[3], None, (), None) for k, n in enumerate(nodes) if n[2] in also]
                owners += [i] * (len(rows) - before)
                if len(rows) >= BATCH:
                    yield batch(given["doc_id"], owners, rows)
                    rows, owners = [], []
            if rows:
                yield batch(given["doc_id"], owners, rows)

    return run


def read(docs: DataFrame, also: tuple[str, ...] = (), wanted: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, shape_index, node, tag, attrs (own and inherited, safe ones only), said, moves (transforms from the root), dieline of every shape drawn in
    docs (doc_id, markup); and without a shape_index, doc_id, node, parent, path, tag, attrs of every element named in also.

    With wanted, shapes come with these attributes only, and those that have none of them do not come.
    """
    docs = docs.select("doc_id", "markup")
    return docs.mapInArrow(_drawn(also, wanted), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


# Fixed value: how a single move without anything else is written; most transforms are one.
MOVE = r"^\s*translate\(\s*([-+]?\d+(?:\.\d+)?)[\s,]+([-+]?\d+(?:\.\d+)?)\s*\)\s*$"


def _matrix(moves: Column) -> Column:
    """Product of transforms from the root; one that can't be read moves nothing. Null for none and for one that changes nothing."""
    none = M.Matrix.of(1, 0, 0, 1, 0, 0).struct()
    times = lambda a, t: (M.Matrix.read(a) @ M.Matrix.read(t)).struct()
    every = F.aggregate(F.transform(moves, lambda t: F.coalesce(M.parse(t), none)), none, times)
    only = F.get(moves, F.lit(0))
    at = lambda k: F.regexp_extract(only, MOVE, k).cast("double")
    one = F.when((F.size(moves) == 1) & only.rlike(MOVE), M.Matrix.of(1, 0, 0, 1, at(1), at(2)).struct()).otherwise(every)
    return F.when(F.size(moves) > 0, one)


def shapes(drawn: DataFrame) -> DataFrame:
    """The shapes of what `read` gave as `drawing.shapes` has them: doc_id, shape_index, node, tag, attrs, text, matrix (null for none), dieline."""
    out = drawn.filter("shape_index IS NOT NULL").withColumn("_m", _matrix(F.col("moves")))
    text = F.when(F.col("said").isNull(), "").otherwise(F.trim(F.regexp_replace("said", r"\s+", " ")))
    return out.select("doc_id", "shape_index", "node", "tag", "attrs", text.alias("text"), F.when(~M.Matrix.read(F.col("_m")).is_identity(), F.col("_m")).alias("matrix"), "dieline")
