"""Markup as a table of nodes: a row for each element and each run of text, in document order.

The reader folds a document's tags with a stack and works on HTML and SVG alike: void elements have no end, script and style
hold raw text, an end tag closes the nearest open element of its name with all that is open inside it, other end tags are ignored, and the end of
the text closes what is left. Everything after it (cascade, references, transforms) is joins over the table.

Columns: doc_id, node (from 0), parent (null for a root), last (the last node inside), depth, tag (``#text`` for text; without prefix), path (tags from
the root), chain (nodes from the root, the node included), named (those of the chain that have an id), attrs (without prefixes, the first of equal names), text (of text, script and style).

Defined cases: null and empty markup have no nodes; documents are told apart by their id, which must not repeat; comments, declarations and
processing instructions are no nodes; blank runs of text are left out; a document is read whole in one task, whatever its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements without an end, and those whose text is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|</\s*(?P<end>[^\s>/]+)[^>]*>|<(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
FIELDS = {
    "node": pa.int32(), "parent": pa.int32(), "last": pa.int32(), "depth": pa.int32(), "tag": pa.string(), "path": pa.string(), "chain": pa.list_(pa.int32()),
    "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "named": pa.list_(pa.int32()),
}
SCHEMA = "node int, parent int, last int, depth int, tag string, path string, chain array<int>, attrs map<string,string>, text string, named array<int>"
BATCH = 16_384  # nodes handed over at once, those of a last document beyond that included


def plain(name: str) -> str:
    return name.rpartition(":")[2]


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        value = a or b or c
        out.setdefault(plain(name) if ":" in name else name, html.unescape(value) if "&" in value else value)
    return out


TEXT, START, END = range(3)


def _start(tag: str, inner: str, attrs: dict[str, str]) -> tuple:
    tag, closed = plain(tag), inner.endswith("/")
    return START, tag, attrs, not closed and tag.lower() not in VOID, not closed and tag.lower() in RAW


def _searched(markup: str) -> list[tuple]:
    """Marks in order, each looked for where the last one ended: (TEXT, text), (END, name), (START, tag, attributes, opens, holds raw text) with its raw text or null."""
    out: list[tuple] = []
    at = 0
    while at < len(markup):
        m = MARK.search(markup, at)
        before = markup[at : m.start() if m else len(markup)]
        if before:
            out.append((TEXT, html.unescape(before)))
        if not m:
            break
        at, kind = m.end(), m.lastgroup
        if kind == "data":
            out.append((TEXT, m["data"]))
        elif kind == "end":
            out.append((END, plain(m["end"]).lower()))
        elif kind == "attrs":
            mark, text = _start(m["tag"], m["attrs"], attributes(m["attrs"])), None
            if mark[4]:
                end = re.compile(rf"</\s*{mark[1]}\b[^>]*>", re.I).search(markup, at)
                text = markup[at : end.start() if end else len(markup)]
                at = end.end() if end else len(markup)
            out.append((*mark, text))
    return out


# How a start tag without quotes is written, one up to its first value, a further name, an end; and the end of raw text.
BARE = re.compile(r"""([A-Za-z][^\s/>"']*)(?=[\s/]|\Z)(.*)""", re.S)
LEAD = re.compile(r"""([A-Za-z][^\s/>"']*)\s+([^\s=/>"']+)\s*=\s*""")
NAME = re.compile(r"""\s*([^\s=/>"']+)\s*=\s*""")
CLOSE = re.compile(r"/\s*([^\s>/]+)")
RAW_END = {t: re.compile(rf"/\s*{t}\b[^>]*(>?)", re.I) for t in RAW}


@lru_cache(10_000)
def _bare(head: str) -> tuple | None:
    m = BARE.fullmatch(head)
    return m and _start(m[1], m[2], attributes(m[2]))


@lru_cache(10_000)
def _lead(head: str) -> tuple | None:
    m = LEAD.fullmatch(head)
    return m and (_start(m[1], "", {}), _start(m[1], "/", {}), plain(m[2]))


@lru_cache(10_000)
def _name(text: str) -> str | None:
    m = NAME.fullmatch(text)
    return m and plain(m[1])


@lru_cache(10_000)
def _close(head: str) -> str | None:
    m = CLOSE.match(head)
    return m and plain(m[1]).lower()


def _quoted(head: str, parts: list[str]) -> tuple | None:
    """Mark of a start tag with values in double quotes; names are read once for all tags that write them alike."""
    lead, last = _lead(parts[0]), parts[-1]
    if lead is not None and (not last or last == "/" or last.strip() in ("", "/")):
        mark = lead[last.endswith("/")]
        attrs: dict[str, str] = {}
        name = lead[2]
        for k in range(1, len(parts), 2):
            if k > 1:
                name = _name(parts[k - 1])
                if name is None:
                    break
            if name not in attrs:
                value = parts[k]
                attrs[name] = html.unescape(value) if "&" in value else value
        else:
            return START, mark[1], attrs, mark[3], mark[4]
    m = BARE.fullmatch(head)
    return m and _start(m[1], m[2], attributes(m[2]))


#: Pieces read before, with their marks: ends and starts that documents write alike.
_SEEN: dict[str, tuple] = {}


def _piece(piece: str) -> tuple | None:
    """Marks of a piece behind a "<": a tag or a declaration (null for it), and the text after it; null where it is no plain tag."""
    head, end, after = piece.partition(">")
    if not end:
        return None
    if head.startswith("/"):
        name = _close(head)
        if name is None:
            return None
        mark = (END, name)
    elif head.startswith(("!", "?")):
        if head.startswith(("!--", "![CDATA[")):
            return None
        mark = None
    else:
        parts = head.split('"')
        if len(parts) % 2 == 0 or "'" in head:
            return None
        mark = _bare(head) if len(parts) == 1 else _quoted(head, parts)
        if mark is None:
            return None
    if mark is None or not mark[-1] or mark[0] == END:
        after = html.unescape(after) if "&" in after else after
        out = mark if mark is None or mark[0] == END else (*mark, None), after and (TEXT, after)
        if len(piece) < 100 and len(_SEEN) < 10_000:
            _SEEN[piece] = out
        return out
    return (*mark, after), None


def _split(markup: str) -> list[tuple] | None:
    """The same marks from the markup cut at each "<"; null where a piece is no plain tag (comments, sections of data, single or odd quotes, a bare "<")."""
    pieces = markup.split("<")
    out: list[tuple] = [(TEXT, html.unescape(pieces[0]))] if pieces[0] else []
    k, n = 1, len(pieces)
    while k < n:
        found = _SEEN.get(pieces[k]) or _piece(pieces[k])
        k += 1
        if found is None:
            return None
        mark, after = found
        if mark is not None:
            if mark[0] == START and mark[4]:
                text, ends = mark[5], RAW_END[mark[1].lower()]
                while k < n:
                    m = ends.match(pieces[k])
                    k += 1
                    if m:
                        if not m[1]:
                            return None
                        after = pieces[k - 1][m.end() :]
                        after = after and (TEXT, html.unescape(after))
                        break
                    text = f"{text}<{pieces[k - 1]}"
                mark = (*mark[:5], text)
            out.append(mark)
        if after:
            out.append(after)
    return out


def elements(markup: str) -> list[list]:
    """Nodes of one document as lists: parent (null for a root), last (the last node inside), tag, attributes, text."""
    marks = _split(markup)
    if marks is None:
        marks = _searched(markup)
    nodes: list[list] = []
    above: list[int] = []
    for mark in marks:
        if mark[0] == START:
            k = len(nodes)
            nodes.append([above[-1] if above else None, k, mark[1], mark[2], mark[5]])
            if mark[3] and not mark[4]:
                above.append(k)
        elif mark[0] == TEXT:
            if mark[1].strip():
                nodes.append([above[-1] if above else None, len(nodes), "#text", {}, mark[1]])
        else:
            name = mark[1]
            to = next((i for i in range(len(above) - 1, -1, -1) if nodes[above[i]][2].lower() == name), len(above))
            while len(above) > to:
                nodes[above.pop()][1] = len(nodes) - 1
    for k in above:
        nodes[k][1] = len(nodes) - 1
    return nodes


def read(markup: str) -> list[list]:
    """Nodes of one document as lists in the order of FIELDS."""
    nodes: list[list] = []
    for k, (parent, last, tag, attrs, text) in enumerate(elements(markup)):
        above = nodes[parent] if parent is not None else None
        named = above[9] if above else []
        nodes.append([k, parent, last, above[3] + 1 if above else 0, tag, f"{above[5]}/{tag}" if above else tag, [*above[6], k] if above else [k], list(attrs.items()), text, [*named, k] if "id" in attrs else named])
    return nodes


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many small documents make one batch: a batch for each would cost far more than reading it."""
    for batch in batches:
        nodes: list[list] = []
        owners: list[int] = []
        for i, markup in enumerate(batch["markup"]):
            found = read(markup.as_py() or "")
            nodes += found
            owners += [i] * len(found)
            if len(nodes) >= BATCH:
                yield _batch(batch["doc_id"], owners, nodes)
                nodes, owners = [], []
        if nodes:
            yield _batch(batch["doc_id"], owners, nodes)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_nested(kind):
        return pa.array(values, kind)
    ends = pa.array([0, *accumulate(map(len, values))], pa.int32())
    flat = [x for v in values for x in v]
    if pa.types.is_map(kind):
        return pa.MapArray.from_arrays(ends, pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string()))
    return pa.ListArray.from_arrays(ends, pa.array(flat, kind.value_type))


def _batch(ids: pa.Array, owners: list[int], nodes: list[list]) -> pa.RecordBatch:
    columns = [_column(c, t) for c, t in zip(zip(*nodes, strict=True), FIELDS.values(), strict=True)]
    return pa.record_batch([ids.take(pa.array(owners, pa.int64())), *columns], names=["doc_id", *FIELDS])


def nodes(docs: DataFrame, doc_id: str = "doc_id", markup: str = "markup") -> DataFrame:
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{markup}`").alias("markup"))
    return docs.mapInArrow(_read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


#: Marks of each page in order, then the nodes of the elements by a fold over them: stacks of names and numbers as lists.
PAGE_NODES_SQL = r"""
marks AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k, m, count(*) OVER (PARTITION BY page_id) AS n FROM (
    SELECT page_id, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM (
      SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[!?][^>]*>|</[^>]*>|<[A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|[^<]+') AS m FROM pages))
  WHERE NOT starts_with(m, '<!') AND NOT starts_with(m, '<?') AND (starts_with(m, '<') OR trim(m, chr(32) || chr(9) || chr(10) || chr(13)) <> '')
), typed AS (
  SELECT *, CASE WHEN starts_with(m, '</') THEN 'end' WHEN starts_with(m, '<') THEN 'start' ELSE 'text' END AS kind,
    CASE WHEN starts_with(m, '<') THEN lower(regexp_extract(m, '^</?([A-Za-z][^\s/>]*)', 1)) ELSE '#text' END AS tag FROM marks
), fold(page_id, k, node, names, ids, out_node, tag, path, chain, m) AS (
  SELECT page_id, 0::BIGINT, -1::BIGINT, []::VARCHAR[], []::BIGINT[], NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT[], NULL::VARCHAR FROM (SELECT DISTINCT page_id FROM typed)
  UNION ALL
  SELECT page_id, k, CASE WHEN kind = 'end' THEN node ELSE node + 1 END,
    CASE WHEN kind = 'end' THEN CASE WHEN back IS NULL THEN names ELSE names[:len(names) - back] END WHEN opens THEN list_append(names, tag) ELSE names END,
    CASE WHEN kind = 'end' THEN CASE WHEN back IS NULL THEN ids ELSE ids[:len(ids) - back] END WHEN opens THEN list_append(ids, node + 1) ELSE ids END,
    CASE WHEN kind <> 'end' THEN node + 1 END, tag, array_to_string(list_append(names, tag), '/'), list_append(ids, node + 1), m
  FROM (
    SELECT f.node, f.names, f.ids, t.*, list_position(list_reverse(f.names), t.tag) AS back,
      t.kind = 'start' AND t.tag NOT IN ('script', 'style', 'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') AND NOT ends_with(t.m, '/>') AS opens
    FROM fold f JOIN typed t ON t.page_id = f.page_id AND t.k = f.k + 1)
), nodes AS (
  SELECT page_id, out_node AS node, tag, path, chain, len(chain) - 1 AS depth, CASE WHEN len(chain) > 1 THEN chain[-2] END AS parent, m FROM fold WHERE out_node IS NOT NULL
)"""
