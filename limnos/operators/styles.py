"""Style sheets over markup: rules from style elements, the cascade by joins, and the policy for attributes.

A rule applies by the name of the element, by a class or by the id; other selectors are kept as skipped. For an element
and a property the winner is, from weakest to strongest: the nearest ancestor's value, the sheet (by specificity, then order), the presentation attribute,
the style attribute. Elements meet rules by equality of (document, kind, name), ancestors by their chain, so nothing is compared in pairs.

Defined cases: documents without style elements have no rules; rules without a declaration do not count in the order; a later declaration of one
property wins; a property in capitals in a sheet counts as lower case; empty names and values are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.markup import attr

# The properties read as presentation attributes, and the rank of the kinds of selectors.
PROPERTIES = (
    "fill", "stroke", "stroke-width", "font-family", "font-size", "opacity", "fill-opacity", "text-anchor", "font-weight", "font-style", "stroke-linecap",
    "stroke-linejoin", "stroke-dasharray", "fill-rule",
)
SPECIFICITY = {"element": 1, "class": 2, "id": 3}
INHERITED, SHEET, ATTRIBUTE, STYLE = 0, 1, 2, 3
# The references that an attribute may hold.
SAFE_REFERENCE = r"(?i)^\s*(data:image/|https?:|/|\.{0,2}/|[\w.\-]+$)"
KEYS = ("doc_id", "node")


def declarations(body: Column, lowered: bool) -> Column:
    """Array of (name, value) of `name: value; ...`, in order."""
    parts = F.filter(F.split(body, ";"), lambda p: p.contains(":"))
    name = lambda p: F.trim(F.regexp_replace(F.substring_index(p, ":", 1), r"[\t\n\r\f]", " "))
    value = lambda p: F.trim(F.regexp_replace(F.substring(p, F.instr(p, ":") + 1, F.length(p)), r"[\t\n\r\f]", " "))
    pairs = F.transform(parts, lambda p: F.struct((F.lower(name(p)) if lowered else name(p)).alias("name"), value(p).alias("value")))
    return F.filter(pairs, lambda d: (d["name"] != "") & (d["value"] != "")) if lowered else pairs


def style_rules(nodes: DataFrame) -> DataFrame:
    """doc_id, node (of the style element), rule, part, selector, kind, name, specificity, declarations; kind is null where the selector is skipped."""
    css = nodes.filter("lower(tag) = 'style' AND text IS NOT NULL").select(*KEYS, F.regexp_replace("text", r"(?s)/\*.*?\*/", "").alias("css"))
    blocks = lambda k: F.regexp_extract_all("css", F.lit(r"([^{}]+)\{([^{}]*)\}"), F.lit(k))
    rules = css.select(*KEYS, F.posexplode(F.arrays_zip(blocks(1).alias("head"), blocks(2).alias("body"))).alias("rule", "b"))
    rules = rules.select(*KEYS, "rule", "b.head", declarations(F.col("b.body"), True).alias("declarations")).filter(F.size("declarations") > 0)
    one = rules.select(*KEYS, "rule", F.posexplode(F.split("head", ",")).alias("part", "raw"), "declarations")
    s = F.regexp_replace("raw", r"^\s+|\s+$", "")
    one = one.withColumn("selector", s).filter("selector <> ''")
    kind = F.when(F.col("selector").rlike(r"^([a-zA-Z][\w-]*|\*)$"), "element").when(F.col("selector").rlike(r"^\.[\w-]+$"), "class").when(F.col("selector").rlike(r"^#[\w-]+$"), "id")
    rank = F.lit(None).cast("int")
    for k, v in SPECIFICITY.items():
        rank = F.when(F.col("kind") == k, v).otherwise(rank)
    name = F.when(F.col("kind") == "element", F.col("selector")).otherwise(F.substring("selector", 2, 1_000_000))
    return one.withColumn("kind", kind).select(*KEYS, "rule", "part", "selector", "kind", F.when(F.col("kind").isNotNull(), name).alias("name"), rank.alias("specificity"), "declarations")


def own_styles(nodes: DataFrame) -> DataFrame:
    """doc_id, node, name, value, level of every property that an element has itself: from the sheet, an attribute or the style attribute."""
    elements = nodes.filter("tag <> '#text'")
    classes = F.filter(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), lambda c: c != "")
    called = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("key"))
    handles = F.concat(F.array(called("element", F.col("tag")), called("id", attr("id"))), F.transform(F.array_distinct(classes), lambda c: called("class", c)))
    asked = elements.select(*KEYS, F.explode(handles).alias("h")).select(*KEYS, "h.kind", "h.key").filter("key IS NOT NULL")
    rules = style_rules(nodes).filter("kind IS NOT NULL").select("doc_id", "kind", F.col("name").alias("key"), F.struct("specificity", "node", "rule", "part").alias("rank"), "declarations")
    met = asked.join(rules, ["doc_id", "kind", "key"]).select(*KEYS, "rank", F.posexplode("declarations").alias("at", "d"))
    zero = F.lit(0)
    sheet = met.select(*KEYS, "d.name", "d.value", F.lit(SHEET).alias("level"), F.struct("rank.specificity", "rank.node", "rank.rule", "rank.part", "at").alias("rank"))
    none = F.struct(zero.alias("specificity"), zero.alias("node"), zero.alias("rule"), zero.alias("part"), zero.alias("at"))
    given = F.filter(F.map_entries("attrs"), lambda e: e.key.isin(*PROPERTIES))
    plain = elements.select(*KEYS, F.explode(given).alias("e")).select(*KEYS, F.col("e.key").alias("name"), F.col("e.value").alias("value"), F.lit(ATTRIBUTE).alias("level"), none.alias("rank"))
    inline = elements.filter(F.coalesce(attr("style"), F.lit("")) != "").select(*KEYS, F.posexplode(declarations(attr("style"), False)).alias("at", "d"))
    inline = inline.select(*KEYS, "d.name", "d.value", F.lit(STYLE).alias("level"), F.struct(zero.alias("specificity"), zero.alias("node"), zero.alias("rule"), zero.alias("part"), "at").alias("rank"))
    best = F.max_by(F.struct("value", "level"), F.struct("level", "rank")).alias("b")
    # Dealt by element alone, so that those who join by element need no exchange of their own.
    every = sheet.unionByName(plain).unionByName(inline).repartition(*KEYS)
    return every.groupBy(*KEYS, "name").agg(best).select(*KEYS, "name", "b.value", "b.level")


def resolved(instances: DataFrame, own: DataFrame, by: tuple[str, ...] = KEYS, chain: str = "chain") -> DataFrame:
    """by, name, value, level of every property that holds at an instance; chain lists the nodes that it inherits from, itself last."""
    links = instances.select("doc_id", *[c for c in by if c != "doc_id"], F.size(chain).alias("_size"), F.posexplode(chain).alias("_at", "_link"))
    met = links.join(own.select("doc_id", F.col("node").alias("_link"), "name", "value", "level"), ["doc_id", "_link"])
    level = F.when(F.col("_at") + 1 == F.col("_size"), F.col("level")).otherwise(INHERITED)
    return met.repartition(*by).groupBy(*by, "name").agg(F.max_by(F.struct("value", level.alias("level")), "_at").alias("b")).select(*by, "name", "b.value", "b.level")


def safe(name: Column, value: Column) -> Column:
    """No handlers of events, and references only to images, pages and plain names."""
    low = F.lower(name)
    return ~low.startswith("on") & (~low.isin("href", "xlink:href") | F.coalesce(value.rlike(SAFE_REFERENCE), F.lit(False)))


def sanitized(nodes: DataFrame) -> DataFrame:
    """doc_id, node, tag, name, value, safe of every attribute."""
    every = nodes.filter("tag <> '#text'").select(*KEYS, "tag", F.explode("attrs").alias("name", "value"))
    return every.withColumn("safe", safe(F.col("name"), F.col("value")))


def cascade(nodes: DataFrame) -> DataFrame:
    """doc_id, node, tag, name, value, level (0 inherited, 1 sheet, 2 attribute, 3 style) of every property that holds at an element."""
    elements = nodes.filter("tag <> '#text'")
    return resolved(elements, own_styles(nodes)).join(elements.select(*KEYS, "tag"), list(KEYS)).select(*KEYS, "tag", "name", "value", "level")
