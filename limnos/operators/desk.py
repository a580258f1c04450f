"""Requests, document requests, briefs, approvals and systems of the desk: defaults, constraints, look-ups, fan-out.

Row-local ones are projections; look-ups are equality joins with tables of one row a key, which Spark splits or broadcasts by size.
Nulls are as good as missing fields; repeated rows are each judged; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Caps, scopes, files and formats of the desk.
MOST_CANDIDATES, UPLOAD_CAP, LINK_DAYS, TOKEN_LEAST = 4, 20 * 1024 * 1024, 14, 16
SCOPES = ("Full Suite", "Plan Chapters", "Pitch Deck", "Financial Model", "Briefs")
SUFFIX = {"Plan Chapters": ".md", "Pitch Deck": ".pptx", "Financial Model": ".xlsx"}
KINDS = {".pptx": "deck", ".xlsx": "model"}
DECISIONS = ("Approved", "Rejected", "Changes Requested")
ASSETS = {"poster": "a1-poster", "pullup_banner": "pullup-banner", "flyer": "a4-poster", "company_profile": "a4-poster"}
MARKERS = ("Not yet provided", "Pending", "Not applicable")
HEX = "^#[0-9a-fA-F]{6}$"


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def filled(value: Column) -> Column:
    """Whether a text has more than blanks."""
    return F.coalesce(stripped(value) != "", F.lit(False))


def clamped(asked: Column, most: int = MOST_CANDIDATES) -> Column:
    """A whole number between 1 and most; 1 where it is none."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(asked.try_cast("int"), F.lit(1))))


def request_validation(requests: DataFrame) -> DataFrame:
    """Defaults of a request, and whether it may be made: it has a prompt, and its upload, if its size is known, is within the cap."""
    within = F.coalesce(F.col("upload_bytes") <= UPLOAD_CAP, F.lit(True))
    return requests.select(
        "request", clamped(F.col("n_asked")).alias("n_candidates"), F.coalesce("mode_asked", F.lit("Uploaded Artwork")).alias("source_mode"),
        within.alias("within_cap"), (filled(F.col("prompt")) & within).alias("valid"),
    )


def stems(artifacts: Column) -> Column:
    """Names in a list by commas or lines, each once, in order."""
    parts = F.transform(F.split(F.coalesce(artifacts, F.lit("")), "[,\n]"), stripped)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def outputs(scope: Column, written: Column) -> Column:
    """Which of the written files a scope delivers."""
    ending = lambda suffix: F.filter(written, lambda w: w.endswith(suffix))
    out = F.when(scope == "Full Suite", written)
    for name, suffix in SUFFIX.items():
        out = out.when(scope == name, ending(suffix))
    return out.otherwise(F.filter(written, lambda _: F.lit(False)))


FILES = ("plan.md", "deck.pptx", "model.xlsx", "notes.md")


def document_validation(documents: DataFrame) -> DataFrame:
    """First problem of a document request (none: null), its selection, and whether files are rendered."""
    scope, chosen = F.col("scope"), stems(F.col("artifacts"))
    problem = F.when(~filled(F.col("business_name")), "name").when(~scope.isin(*SCOPES), "scope").when((F.size(chosen) > 0) & (scope != "Full Suite"), "selection")
    renders = scope.isin("Pitch Deck", "Financial Model") | (F.col("render_asked") & (scope == "Full Suite"))
    return documents.select("request", problem.alias("problem"), F.array_join(chosen, "|").alias("stems"), renders.alias("renders"))


def document_outputs(documents: DataFrame) -> DataFrame:
    """A row for each file that a document request delivers, and its kind."""
    rows = documents.select("request", F.explode(outputs(F.col("scope"), F.array(*map(F.lit, FILES)))).alias("path"))
    kind = F.lit("document")
    for suffix, name in KINDS.items():
        kind = F.when(F.col("path").endswith(suffix), name).otherwise(kind)
    return rows.withColumn("kind", kind)


def _placed(briefs: DataFrame) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in ASSETS.items() for x in kv])
    return briefs.withColumn("format", F.element_at(known, stripped(F.coalesce("asset_type", F.lit("")))))


def brief_plan(briefs: DataFrame) -> DataFrame:
    """The format of every brief that has one, and its line of the campaign's text."""
    head = stripped(F.col("headline"))
    line = F.concat(F.col("brief").cast("string"), F.lit(" -> "), F.col("format"), F.when(filled(F.col("headline")), F.concat(F.lit(": "), head)).otherwise(""))
    return _placed(briefs).filter("format IS NOT NULL").select("brief", "format", line.alias("line"))


def brief_skips(briefs: DataFrame) -> DataFrame:
    """The briefs without a format, and the asset type that has none."""
    missing = F.when(filled(F.col("asset_type")), F.col("asset_type")).otherwise("(missing)")
    return _placed(briefs).filter("format IS NULL").select("brief", missing.alias("asset_type"))


def reviews(approvals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every link with its candidate's request: whether it can be used at the time of the last candidate, and whether its decision counts.

    Links expire LINK_DAYS after they were made, those without a date never.
    """
    now = candidates.agg(F.max("creation").alias("now"))  # one row
    own = approvals.join(candidates.select("candidate", "request", "creation"), "candidate").crossJoin(F.broadcast(now))
    expired = F.coalesce(F.col("now") >= F.col("linked_on") + F.expr(f"INTERVAL {LINK_DAYS} DAYS"), F.lit(False))
    usable = (F.length("token") >= TOKEN_LEAST) & ~expired
    return own.select("candidate", "request", "creation", "decision", usable.alias("usable"), (usable & F.col("decision").isin(*DECISIONS)).alias("counts"))


def approval_lookup(approvals: DataFrame, candidates: DataFrame) -> DataFrame:
    return reviews(approvals, candidates).select("candidate", "request", "usable", "counts")


def selected_candidate(approvals: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate of each request that was approved last; no other stays selected."""
    approved = reviews(approvals, candidates).filter("counts AND decision = 'Approved'")
    return approved.groupBy("request").agg(F.max(F.struct("creation", "candidate")).alias("m")).select("request", "m.candidate", F.lit("Delivered").alias("status"))


def candidate_revisions(candidates: DataFrame) -> DataFrame:
    """Attempts as revisions: when the next one replaced each, and which is current."""
    w = Window.partitionBy("request").orderBy("attempt")
    return candidates.select("request", "candidate", F.lead("creation").over(w).alias("replaced_at"), F.lead("candidate").over(w).isNull().alias("current"))


def campaign_status(requests: DataFrame, candidates: DataFrame, formats: list[str]) -> DataFrame:
    """For each customer's campaign its formats with the state of each, in order, and how many have a candidate."""
    names = F.array(*map(F.lit, formats))
    made = candidates.filter("score_after >= 40").select(F.col("candidate").alias("request"), F.lit(True).alias("made"))
    state = F.when(F.col("raw_status") == "F", "Failed").when(F.col("made"), "Ready").otherwise("Pending")
    rows = requests.select("request", F.col("customer").alias("campaign"), "raw_status", F.get(names, (F.col("request") % len(formats)).cast("int")).alias("format"))
    rows = rows.join(made, "request", "left").select("campaign", "request", "format", state.alias("state"))
    by_state = rows.groupBy("campaign", "format", "state").agg(F.count(F.lit(1)).alias("n"))
    told = F.concat_ws(":", "format", "state", F.col("n").cast("string"))
    out = by_state.groupBy("campaign").agg(F.array_join(F.array_sort(F.collect_list(told)), ",").alias("formats"), F.sum("n").alias("requests"), F.sum(F.when(F.col("state") == "Ready", F.col("n")).otherwise(0)).alias("ready"))
    return out


def system_problems(systems: DataFrame) -> DataFrame:
    """What is wrong with a system's fields, in order; systems without problems are left out."""
    c = F.col
    parts = F.filter(F.transform(F.split(F.coalesce("type_scale", F.lit("")), ","), stripped), lambda x: x != "")
    problems = F.array_compact(F.array(
        F.when(c("token_hex").isNull(), "no color token"), F.when(~c("token_hex").rlike(HEX), F.concat(F.lit("color token "), c("token_hex"))),
        F.when((c("seed") != "") & ~c("seed").rlike(HEX), F.concat(F.lit("seed color "), c("seed"))),
        F.when(F.exists(parts, lambda x: x.try_cast("double").isNull()), F.concat(F.lit("type scale "), c("type_scale"))),
    ))
    return systems.select("system", problems.alias("p")).filter(F.size("p") > 0).select("system", F.array_join("p", "; ").alias("problems"))


def default_system(profiles: DataFrame, systems: DataFrame) -> DataFrame:
    """The system of every profile: its own choice, else its owner's default, else the first default, else any."""
    own = systems.filter("is_default").groupBy("owner").agg(F.min("system").alias("by_owner"))
    general = systems.agg(F.min(F.when(F.col("is_default") & (F.col("owner") % 2 == 0), F.col("system"))).alias("by_all"), F.min("system").alias("any"))  # one row
    out = profiles.join(own, "owner", "left").crossJoin(F.broadcast(general))
    return out.select("profile", F.coalesce("chosen", "by_owner", "by_all", "any").alias("system"))


def usable_value(value: Column) -> Column:
    """First line of an answer; null where there is none or only a placeholder."""
    v = stripped(F.coalesce(value, F.lit("")))
    marked = v == ""
    for m in MARKERS:
        marked = marked | v.startswith(m)
    return F.when(~marked, stripped(F.element_at(F.split(v, "\n"), 1)))


def profile_slots(profiles: DataFrame) -> DataFrame:
    """Texts of a profile's slots: the first usable source of each, null where there is none."""
    u = {k: usable_value(F.col(k)) for k in ("trading_name", "company_name", "vision", "proposition")}
    return profiles.select("profile", F.coalesce(u["trading_name"], u["company_name"]).alias("business_name"), F.coalesce(u["vision"], u["proposition"]).alias("heading"), u["proposition"].alias("tagline"))


def latest_requests(requests: DataFrame, status: str = "F", n: int = 20) -> DataFrame:
    """The n latest requests of a status: a report."""
    return requests.filter(F.col("raw_status") == status).orderBy(F.desc("creation"), "request").limit(n).select("request", "creation")
