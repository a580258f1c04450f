"""Requests, candidates and campaigns: gating, picks, timers, illegal steps, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import catalog as K


def best_attempt(candidates: DataFrame) -> DataFrame:
    """The attempt with the highest score of each request, the earliest of equals; unscored ones come last. An aggregate, not a window."""
    key = F.struct(F.coalesce("score_after", F.lit(float("-inf"))).alias("s"), (-F.col("attempt")).alias("a"), "candidate", "score_after", "attempt")
    return candidates.groupBy("request").agg(F.max(key).alias("m")).select("request", "m.candidate", "m.attempt", F.col("m.score_after").alias("score_after"))


def candidate_gate(candidates: DataFrame, least: float = 95.0) -> DataFrame:
    """How many candidates of a request pass, and the request's outcome."""
    passed = F.coalesce(F.col("score_after") >= least, F.lit(False))
    return candidates.groupBy("request").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(passed).alias("passed")).withColumn("outcome", F.when(F.col("passed") > 0, "Ready").otherwise("Failed"))


def master_pick(candidates: DataFrame, least: float = 95.0) -> DataFrame:
    """One candidate of each request: passing ones first, then by score, then the latest."""
    w = Window.partitionBy("request").orderBy(F.coalesce(F.col("score_after") >= least, F.lit(False)).desc(), F.col("score_after").desc(), F.col("attempt").desc())
    return candidates.withColumn("k", F.row_number().over(w)).filter("k = 1").select("request", "candidate", "score_after")


def latest(lifecycle: DataFrame) -> DataFrame:
    """The last status of each request."""
    return lifecycle.groupBy("request").agg(F.max(F.struct("ts", "event_id", "status")).alias("m")).select("request", "m.status", F.col("m.ts").alias("since"))


def idle(lifecycle: DataFrame, status: str, minutes: int) -> DataFrame:
    """Requests that have been in a status for longer, seen at the time of the last event."""
    now = lifecycle.agg(F.max("ts").alias("now"))
    return latest(lifecycle).filter(F.col("status") == status).crossJoin(F.broadcast(now)).filter(F.col("since") < F.col("now") - F.expr(f"INTERVAL {minutes} MINUTES")).select("request", "since")


def raw_retention(lifecycle: DataFrame, days: int = 30) -> DataFrame:
    """Events older than the time that raw data are kept, by request."""
    now = lifecycle.agg(F.max("ts").alias("now"))
    old = lifecycle.crossJoin(F.broadcast(now)).filter(F.col("ts") < F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    return old.groupBy("request").agg(F.count(F.lit(1)).alias("expired"))


def status_violations(lifecycle: DataFrame) -> DataFrame:
    """Steps between successive events of a request that the status machine forbids."""
    w = Window.partitionBy("request").orderBy("ts", "event_id")
    steps = lifecycle.withColumn("before", F.lag("status").over(w)).filter("before IS NOT NULL AND before <> status")
    legal = F.lit(False)
    for a, b in K.EDGES:
        legal = legal | ((F.col("before") == a) & (F.col("status") == b))
    return steps.filter(~legal).groupBy("before", F.col("status").alias("after")).agg(F.count(F.lit(1)).alias("steps"))


def campaign_plan(masters: DataFrame, formats: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Every master into every format of the (fixed) catalogue: derive where little of the canvas is lost, else regenerate."""
    s = F.least(F.col("width") / F.col("master_w"), F.col("height") / F.col("master_h"))
    waste = F.lit(1.0) - (F.col("master_w") * s * F.col("master_h") * s) / (F.col("width") * F.col("height"))
    both = masters.crossJoin(F.broadcast(formats.select(F.col("name").alias("format"), "width", "height")))
    return both.select("master", "format", (F.floor(waste * 10_000 + 0.5) / 10_000).alias("waste"), F.when(waste <= threshold, "derive").otherwise("regenerate").alias("action"))


def grid_flow(units: DataFrame, width: float = 1000.0, height: float = 700.0, least: float = 60.0, gutter: float = 12.0) -> DataFrame:
    """Columns and rows for n square cells: the largest cells, then those that fill their slots best, then the fewest columns; none for less than one cell."""
    c = F.col

    def tried(cols: int):
        rows = F.ceil(c("n") / cols).cast("int")
        cell_w, cell_h = F.lit((width + gutter) / cols - gutter), (F.lit(height + gutter) / rows) - gutter
        side = F.least(cell_w, cell_h)
        fill = F.bround(side * side / F.greatest(F.lit(1e-6), cell_w * cell_h), 3)
        return F.when(c("n") >= cols, F.struct(F.bround(side, 1).alias("side"), fill.alias("fill"), F.lit(-cols).alias("k"), rows.alias("rows")))

    # The columns that fit are few and fixed: the best is taken within the row, not by an aggregate over a row for each. Rows are dealt out first, so that
    # equal ones meet in small tasks however few row groups the file has.
    most = int((width + gutter) // (least + gutter))
    best = units.select("unit", "n").repartition("unit").select("unit", "n", F.inline(F.array_compact(F.array(F.greatest(*map(tried, range(1, most + 1)))))))
    return best.select("unit", "n", (-c("k")).alias("cols"), "rows", c("side").alias("cell"), (c("side") >= least).alias("fits")).distinct()
