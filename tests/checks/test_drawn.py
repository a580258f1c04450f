"""Drawn shapes in one pass over a document, held against the joins over the table of nodes."""

import random
import re

from pyspark.sql import functions as F

from limnos.functions import matrix as M
from limnos.operators import drawing, drawn
from limnos.plans import markup as queries
from limnos.sources import markup

ODD = [
    None, "", " ", "<!-- x --><svg><rect/></svg>", "<svg><rect x='1' y=\"2\"/>a < b<text>1 &lt; 2<!-- n --> t</text></svg>", '<rect fill="a"/><g fill="b"><text>a<tspan> b </tspan><![CDATA[c<d]]></text></g>',
    '<svg><style>rect{fill:a;opacity:1} .k{fill:b} #i{fill:c} .k{stroke:one} .j{stroke:two}</style><g fill="g" font-size="9"><rect/><rect class="k j"/><rect class="k" id="i"/><rect fill="f"/><rect class=" k" style="fill:s; fill: t;:u"/><circle/></g></svg>',
    '<svg><style>/* .a{fill:no} */ .a , #b,rect.a{FILL: url(a:b) ; onx:1;;stroke:} *{fill:all} rect{}</style><rect class="a"/><rect id="b"/><rect id="b" class="b"/><STYLE>rect{fill:later}</STYLE></svg>',
    '<svg><defs><rect id="p" width="2" transform="scale(2)"/><g id="q" fill="no" transform="scale(9)"><circle r="1"/><use href="#p" x="1"/></g><symbol id="s"><a fill="in"><rect/></a><b><rect/></b></symbol></defs><g fill="red"><use xlink:href="#p" x="100" y="-1.5e3"/>'
    '<use href="#q" y="3" transform="rotate(30) translate(1 2)"/><use href="#s" x="0"/></g><use href="#gone"/><use href="a.svg"/><use/><use href="#"/></svg>',
    '<svg><g id="l"><rect width="1" height="1"/><use href="#l" x="1"/></g><use id="u" href="#u"/></svg>', '<svg><g transform="spin(3)"><g transform="translate(1,2)"><rect transform="  "/><rect transform="translate(3)"/><rect transform="translate( -3 , 4.50 )"/></g></g><g id="dieline"><rect/><use href="#d"/></g><rect id="d" class="x  dieline"/><rect class="dielines"/></svg>',
    '<svg><image href="javascript:a(1)" onload="x"/><image href="../a.png"/><image href="a.png&#10;"/><a href="#x" xlink:href="#y" style="href:evil:1;onclick:2;fill:ok"><rect ONCLICK="1" data-x="a&amp;&quot;b"/></a></svg>',
]
BITS = [
    '<g fill="a">', '<g class="k" transform="translate(1 2)">', "</g>", "</g>", '<a id="dieline">', "</a>", "<svg>", '<rect id="r" x="1" fill="b"/>', '<rect class="k" style="fill:c;opacity:2"/>', "<text>t&amp; <tspan>u</tspan>", "</text>", '<use href="#r" x="1"/>', '<use href="#h"/>',
    '<g id="h" stroke="s">', "<style>.k{stroke:d} rect{opacity:1;fill:e}</style>", "<style>#r{opacity:.5} text{fill:f}</style>", "<defs>", "</defs>", "<circle r='3'/>", "<!-- c -->", "w ", '<symbol id="r">', "</symbol>", '<use xlink:href="#h" y="2" transform="scale(2)"/>', "<script>if (1 < 2) x()</script>",
]


def as_rows(df):
    m = F.when(F.col("matrix").isNotNull(), F.array(*[F.round(f"matrix.{k}", 9) for k in "abcdef"]))
    return sorted((r.doc_id, r.shape_index, r.node, r.tag, sorted(r.attrs.items()), r.text, r.m, r.dieline) for r in df.withColumn("m", m).collect())


def test_one_pass_gives_what_the_joins_give(spark):
    rnd = random.Random(7)
    texts = ODD + ["".join(rnd.choice(BITS) for _ in range(rnd.randint(2, 12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, markup string")
    got, want = as_rows(drawn.shapes(drawn.read(docs))), as_rows(drawing.shapes(markup.nodes(docs)))
    assert len(want) > 400 and got == want


def test_cut_and_searched_marks_are_the_same():
    rnd = random.Random(8)
    bits = ["<", ">", "/", '"', "'", "=", " ", "\n", "a", "rect", "<a", "</a>", "<g>", "</g>", "<!--", "-->", "<![CDATA[", "]]>", "<?x?>", "&lt;", 'x="1"', "y='2'", 'x:y="q"', "<br>", "<br/>", "<style>", "</style>", "</ style >", "<SCRIPT>", "</script", '<rect x="1" y="2"/>', '<use xlink:href="#a" x="1"/>']
    cut = 0
    for _ in range(20_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12)))
        marks = markup._split(text)
        cut += marks is not None
        assert marks is None or [m for m in marks if m[0] != markup.TEXT or m[1].strip()] == [m for m in markup._searched(text) if m[0] != markup.TEXT or m[1].strip()], text
    assert cut > 5000


def test_wanted_attributes_and_nodes_beside_shapes(spark):
    docs = spark.createDataFrame([(1, '<svg><defs><radialGradient id="a"><stop offset="1"/></radialGradient></defs><rect x="1"/><rect fill="url(#a)" x="2"/></svg>')], "doc_id long, markup string")
    table = drawn.read(docs, also=("radialGradient", "stop"), wanted=("fill",))
    assert [(r.shape_index, r.node, r.parent, r.path, r.attrs) for r in table.orderBy("node").collect()] == [
        (None, 2, 1, "svg/defs/radialGradient", {"id": "a"}), (None, 3, 2, "svg/defs/radialGradient/stop", {"offset": "1"}), (1, 5, None, None, {"fill": "url(#a)"}),
    ]


def test_markup_of_shapes_is_exchanged_once_by_document(spark):
    """Elements were exchanged by element and by instance for styles, transforms, marks and texts: about fifteen exchanges."""
    plan = queries.svg_markup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Join" not in plan


def longest_method(df):
    """Bytes of the longest method generated for a plan; the JVM never compiles one of more than 8,000."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


def test_methods_of_drawings_and_shapes_are_short_enough_to_compile(spark):
    """Rows of drawings took a method of 10,747 bytes, so that every query over drawings ran it uncompiled."""
    assert longest_method(queries.svg_shapes(spark, "/root/testdata/sf0.001")) <= 8000


def test_paints_join_no_instances(spark):
    """Paints were read from all shapes with all their styles; only references to gradients and the gradients themselves are exchanged."""
    plan = queries.svg_paints(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2


def test_decimals_are_those_of_a_formatter(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, -0.0, 1.005, -2.675, 0.015, 0.004, -0.001, 10.0, 100.5, 9_999_999.0, 12345678.905, 1e20, float("nan"), float("inf"), None)], "v double")
    for n in (2, 6):
        short = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{n}f", "v"), r"0+$", ""), r"\.$", "")
        rows = df.select(M.decimals(F.col("v"), n).alias("got"), F.when(short.isin("", "-"), "0").otherwise(short).alias("want")).collect()
        assert [r.got for r in rows] == [r.want for r in rows]
