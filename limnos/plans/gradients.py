"""Gradients of the orders: a stop for each shape, in its fill; every ninth has no colour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import gradients as G
from ..sources.bridge import SHAPES_SQL, shapes
from . import catalog as K
from .oracle import TOKENS, dot, lab_of


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = (F.col("doc_id") + F.col("shape_index")) % 9 != 0
    return shapes(spark, sf_dir).select("doc_id", F.col("shape_index").alias("k"), *[F.when(there, F.col(f"fill_{k}")).alias(k) for k in "rgb"])


def gradient_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gradient_stops(stops(spark, sf_dir))


def gradient_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.flattened(stops(spark, sf_dir))


QUERIES = {"gradient_stops": gradient_stops, "gradient_flatten": gradient_flatten}

_T = f"""{TOKENS}, tlab AS (SELECT *, {", ".join(f"{e} AS t{k}" for e, k in zip(lab_of("rgb"), "LAB", strict=True))} FROM tokens)"""
_DISTANCE = "sqrt((sL - tL) * (sL - tL) + (sA - tA) * (sA - tA) + (sB - tB) * (sB - tB))"
_S = f"""{SHAPES_SQL}, {_T}, st AS (SELECT doc_id, shape_index AS k, CASE WHEN (doc_id + shape_index) % 9 <> 0 THEN fill_r END AS pr, CASE WHEN (doc_id + shape_index) % 9 <> 0 THEN fill_g END AS pg,
  CASE WHEN (doc_id + shape_index) % 9 <> 0 THEN fill_b END AS pb FROM shapes),
sl AS (SELECT *, {", ".join(f"{e} AS s{k}" for e, k in zip(lab_of(("pr", "pg", "pb")), "LAB", strict=True))} FROM st)"""


def _channel(row) -> str:
    u = f"greatest(0e0, least(1e0, {dot(row, ['q0', 'q1', 'q2'])}))"
    return f"CAST(round_even(255 * (CASE WHEN {u} <= 0.0031308e0 THEN {u} * 12.92e0 ELSE 1.055e0 * pow({u}, {1 / 2.4!r}e0) - 0.055e0 END), 0) AS INTEGER)"


SQL = {
    "gradient_stops": f"""WITH {_S}, n AS (SELECT s.*, i, name, r = pr AND g = pg AND b = pb AS same, {_DISTANCE} AS d FROM sl s CROSS JOIN tlab),
g AS (SELECT doc_id, k, CASE WHEN any_value(pr) IS NOT NULL THEN coalesce(min(name) FILTER (same), arg_min(name, (d, i))) END AS token,
  CASE WHEN any_value(pr) IS NULL OR bool_or(same) THEN NULL WHEN min(d) <= {K.SNAP_WARNING} THEN 'warning' ELSE 'error' END AS severity FROM n GROUP BY doc_id, k),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS stops FROM g)
SELECT doc_id, k, token, severity, stops <= {G.MOST} OR k IN (0, stops - 1, round_even((stops - 1) / 3e0, 0), round_even(2 * (stops - 1) / 3e0, 0)) AS kept, stops FROM c""",
    "gradient_flatten": f"""WITH {_S}, m AS (SELECT doc_id, avg(sL) FILTER (pr IS NOT NULL) AS mL, avg(sA) FILTER (pr IS NOT NULL) AS mA, avg(sB) FILTER (pr IS NOT NULL) AS mB FROM sl GROUP BY doc_id),
q AS (SELECT doc_id, mL, {", ".join(f"pow({dot(row, ['mL', 'mA', 'mB'])}, 3) AS q{i}" for i, row in enumerate(C.FROM_LAB))} FROM m),
v AS (SELECT doc_id, {", ".join(f"CASE WHEN mL IS NULL THEN 128 ELSE {_channel(row)} END AS p{k}" for row, k in zip(C.FROM_LMS, "rgb", strict=True))} FROM q),
w AS (SELECT *, {", ".join(f"{e} AS s{k}" for e, k in zip(lab_of(("pr", "pg", "pb")), "LAB", strict=True))} FROM v)
SELECT doc_id, format('#{{:02x}}{{:02x}}{{:02x}}', any_value(pr), any_value(pg), any_value(pb)) AS hex, arg_min(name, ({_DISTANCE}, i)) AS token FROM w CROSS JOIN tlab GROUP BY doc_id""",
}
