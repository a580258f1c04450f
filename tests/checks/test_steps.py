"""What a row costs: work that was done again and again within one row, or for one document."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from limnos.functions import matrix as M
from limnos.functions.scalars import nearest
from limnos.operators import comply, drawing, gradients, rules
from limnos.plans import catalog as K
from limnos.sources import bridge, markup


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_of_a_transform_are_read_once(spark):
    """They were read again for each use of an argument."""
    df = spark.createDataFrame([("translate(1 2) ROTATE(90)",), ("rotate(1,2)",), ("",), (None,), ("scale(2)x",)], "t string").select(M.parse(F.col("t")).alias("m"))
    assert plan(df).count("regexp_extract_all(") <= 3
    got = [r.m and tuple(round(v, 9) for v in r.m) for r in df.collect()]
    assert got == [(0, 1, -1, 0, 1, 2), None, (1, 0, 0, 1, 0, 0), (1, 0, 0, 1, 0, 0), None]


def test_small_documents_make_one_batch():
    """Each document was a batch of its own."""
    docs = pa.record_batch([pa.array(range(1000)), pa.array([f'<svg id="a"><rect x="{k}" id="b"/>t</svg>' if k % 10 else None for k in range(1000)])], names=["doc_id", "markup"])
    got = list(markup._read([docs]))
    assert len(got) == 1 and got[0].num_rows == 2700
    rows = got[0].slice(0, 3).to_pylist()
    assert [(r["doc_id"], r["tag"], r["chain"], r["named"], r["attrs"]) for r in rows] == [(1, "svg", [0], [0], [("id", "a")]), (1, "rect", [0, 1], [0, 1], [("x", "1"), ("id", "b")]), (1, "#text", [0, 2], [0], [])]


def test_warnings_exchange_no_instance(spark):
    """Unsafe attributes and unread transforms were joined to the instances, every remark read all instances anew."""
    table = markup.nodes(spark.createDataFrame([(1, '<svg><rect id="a" onclick="f()" transform="spin(1)"/><use href="#a"/><text>a<tspan>b</tspan></text></svg>')], "doc_id long, markup string"))
    out = drawing.warnings(table)
    assert {(r.kind, r.detail) for r in out.collect()} == {("unsafe attribute", "onclick"), ("transform", "rect"), ("spans", "text")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4


def test_a_step_of_a_scale_is_no_object(spark):
    """Each step and token was an object of its own, and each channel's light was computed up to 18 times for one row."""
    one = spark.createDataFrame([(1.0,), (3.0,), (40.0,), (None,), (float("nan"),)], "v double")
    df = one.select(nearest(F.col("v"), (1.0, 2.0, 4.0, 8.0)).alias("s"))
    assert plan(df).count("struct(") <= 2
    assert [r.s for r in df.collect()] == [1.0, 2.0, 8.0, 1.0, 1.0]
    stops = spark.createDataFrame([(0, 0, 26, 86, 219), (0, 1, None, None, None)], "doc_id long, k long, r int, g int, b int")
    assert plan(gradients.flattened(stops)).count("POWER(") <= 16
    assert [tuple(r) for r in gradients.flattened(stops).collect()] == [(0, "#1a56db", "primary")]


def test_checks_of_single_shapes_hold_no_lambda(spark):
    """The list of severities was filtered by a lambda, which keeps all of them out of compiled code."""
    found = rules.local_findings(bridge.shapes(spark, "/root/testdata/sf0.001"))
    assert "lambdafunction" not in plan(found)
    assert found.filter("severity IS NULL").isEmpty() and not found.isEmpty()


def test_rows_of_repairs_are_compiled(spark):
    """Both paints of a shape, their exact and their nearest tokens were one method of 16,691 bytes; the JVM never compiles one of more than 8,000."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        codegen = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        for df in (comply.repaired(bridge.shapes(spark, "/root/testdata/sf0.001")), comply.snapped_paints(bridge.shapes(spark, "/root/testdata/sf0.001"))):
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(codegen)))) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_tokens_of_odd_paints(spark):
    """Exact tokens, the nearest of a text's roles, no colour and no stroke."""
    one = [("rect", 26, 86, 219, 1.0, None, None, None), ("text", None, None, None, 1.0, 26, 86, 219), ("text", 254, 254, 254, 0.0, 0, 0, 0), ("rect", 254, 254, 254, None, 1, 2, 3)]
    df = spark.createDataFrame(one, "tag string, fill_r int, fill_g int, fill_b int, stroke_width double, stroke_r int, stroke_g int, stroke_b int").withColumn("area", F.lit(10.0))
    role = lambda i: None if i is None else K.TOKENS[i]
    got = [(role(r.f), r.f_severity, role(r.s), r.s_severity) for r in comply.snapped_paints(df).collect()]
    assert got[0][:2] == (next(t for t in K.TOKENS if t[1:4] == (26, 86, 219)), None) and got[0][2:] == (None, None)
    assert got[1][:2] == (None, None) and got[1][2][1:4] == (26, 86, 219) and got[1][3] is None
    assert got[2][0][4] in K.TEXT_ROLES + K.ACCENT_ROLES and got[2][1] == "error" and got[2][2:] == (None, None)
    assert got[3][1] == "warning" and got[3][2:] == (None, None)
