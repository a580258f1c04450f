import re

from pyspark.sql import functions as F

from limnos.operators import comply, drawing, layout
from limnos.sources import bridge, drawings
from limnos.sources.markup import nodes

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return re.findall(r"(?<!Reused)Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_shapes_are_exchanged_once_for_all_that_is_done_by_document(spark):
    """The exchange of the numbers was by another name than the document's, so that every reader exchanged anew what had been derived."""
    shapes = bridge.shapes(spark, SF)
    assert len(exchanges(shapes.groupBy("doc_id").agg(F.sum("area")))) == 1
    assert len(exchanges(layout.layout_alignment(shapes))) == 1
    assert len(exchanges(drawings.drawings(spark, SF))) == 1


def test_text_of_a_drawn_shape(spark):
    table = nodes(spark.createDataFrame([(1, '<svg><text x="1">a</text><g fill="red"><rect/></g></svg>')], "doc_id long, markup string"))
    out = drawing.shapes(table)
    assert [(r.shape_index, r.tag, r.text, r.attrs.get("fill")) for r in out.orderBy("shape_index").collect()] == [(0, "text", "a", None), (1, "rect", "", "red")]


def test_audit_exchanges_nothing_by_shape(spark):
    """Places under texts were exchanged by shape and place twice, colours by colour."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exchanges(comply.audit(bridge.shapes(spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("," in keys for keys in found) == 1  # the counts of findings, at the end
