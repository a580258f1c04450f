"""The registered queries of the artwork checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comply, desk, geometry, layout, lifecycle, measures, palette, report, rules
from ..sources import bridge
from ..sources.desk import desk as table_of
from ..sources.storage import kept
from . import catalog, gradients, markup, oracle, oracle_comply, oracle_desk, oracle_palette, paths, rounds, settings

Query = Callable[[SparkSession, str], DataFrame]


def _over(source: Callable[[SparkSession, str], DataFrame], f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(source(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def report_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scores(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id")), report.findings(bridge.shapes(spark, sf_dir)))


def comply_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comply.comply(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id")), bridge.shapes(spark, sf_dir))


def feedback_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.feedback(_orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id")), comply.audit(bridge.shapes(spark, sf_dir)))


def text_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comply.text_moves(kept(comply.repaired(bridge.shapes(spark, sf_dir)), "repaired").filter("NOT removed"))


def complied_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, _ = comply.complied(bridge.shapes(spark, sf_dir))
    return done.select("doc_id", "shape_index", "tag", "x", "y", rules._named(F.col("f2")).alias("fill"), "font_family", "font_size", "stroke_width")


def campaign_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c, m: (F.col(c) % m).cast("double") + 400.0
    masters = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("master"), size("o_orderkey", 1300).alias("master_w"), size("o_custkey", 1700).alias("master_h"))
    return lifecycle.campaign_plan(masters, catalog.formats(spark))


def formats_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every format with how many of the masters can be derived for it and how many must be made anew."""
    used = campaign_plan(spark, sf_dir).groupBy(F.col("format").alias("name")).agg(F.count_if(F.col("action") == "derive").alias("derived"), F.count_if(F.col("action") == "regenerate").alias("regenerated"))
    return catalog.formats(spark).drop("bleed").join(used, "name")


def grid_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.grid_flow(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("unit"), F.col("p_size").cast("int").alias("n")))


def _two(first: Query, second: Query, f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(first(spark, sf_dir), second(spark, sf_dir))


def default_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS profile", "c_nationkey AS owner", "CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 7 END AS chosen")
    return desk.default_system(profiles, table_of("systems")(spark, sf_dir))


QUERIES: dict[str, Query] = {
    **{n: _over(bridge.shapes, getattr(rules, n)) for n in "palette_snap palette_snap_strokes palette_snap_roles contrast_pairs cmyk_ink oklab_roundtrip color_parse stroke_snap type_scale_snap grid_snap font_whitelist min_size min_text hairline safe_margin bleed_check canvas_rescale".split()},
    **{n: _over(bridge.shapes, getattr(layout, n)) for n in "max_colors ink_once_per_color text_hierarchy layout_balance layout_whitespace layout_rhythm layout_alignment text_collisions text_buried contrast_audit".split()},
    **{n: _over(bridge.shapes, getattr(measures, n)) for n in "ring_area palette_report box_coverage".split()},
    "report_score": report_score,
    "report_rollup_by_rule": _over(bridge.shapes, report.rollup),
    **{n: _over(bridge.candidates, getattr(lifecycle, n)) for n in "best_attempt candidate_gate master_pick".split()},
    "stuck_requests": _over(bridge.lifecycle, lambda x: lifecycle.idle(x, "Processing", 120)),
    "queue_sweep": _over(bridge.lifecycle, lambda x: lifecycle.idle(x, "Queued", 15)),
    **{n: _over(bridge.lifecycle, getattr(lifecycle, n)) for n in ("status_violations",)},
    "raw_retention": _over(bridge.lifecycle, lambda x: lifecycle.raw_retention(x, days=10)),
    "background_color": _over(bridge.shapes, lambda s: layout.background_color(s, canvas=1e4)),
    "formats_catalog": formats_catalog,
    "campaign_plan": campaign_plan,
    "grid_flow": grid_flow,
    **{n: _over(bridge.shapes, getattr(geometry, n)) for n in "transform_parse transform_measures curve_bounds ring_turns ring_hits text_fit lch_values paint_operators font_names font_matches comply_shapes".split()},
    **{n: _over(table_of("requests"), getattr(desk, n)) for n in "request_validation latest_requests".split()},
    **{n: _over(table_of("documents"), getattr(desk, n)) for n in "document_validation document_outputs".split()},
    **{n: _over(table_of("briefs"), getattr(desk, n)) for n in "brief_plan brief_skips".split()},
    **{n: _two(table_of("approvals"), bridge.candidates, getattr(desk, n)) for n in "approval_lookup selected_candidate".split()},
    "candidate_revisions": _over(bridge.candidates, desk.candidate_revisions),
    "campaign_status": _two(table_of("requests"), bridge.candidates, lambda r, c: desk.campaign_status(r, c, [f.name for f in catalog.FORMATS])),
    "system_problems": _over(table_of("systems"), desk.system_problems),
    "default_system": default_system,
    **{n: _over(table_of("seeds"), getattr(palette, n)) for n in ("palette_tokens", "palette_contrasts")},
    "profile_slots": _over(table_of("profiles"), desk.profile_slots),
    "audit_documents": _over(bridge.shapes, comply.audit),
    **{f.__name__: f for f in (comply_documents, feedback_top5, text_moves, complied_shapes)},
    **markup.QUERIES, **paths.QUERIES, **rounds.QUERIES, **settings.QUERIES, **gradients.QUERIES,
}
SQL: dict[str, str] = {**oracle.SQL, **oracle_desk.SQL, **oracle_palette.SQL, **oracle_comply.SQL, **markup.SQL, **paths.SQL, **rounds.SQL, **settings.SQL, **gradients.SQL}

__all__ = ["QUERIES", "SQL"]
