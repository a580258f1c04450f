"""The desk's tables (requests, document requests, briefs, approvals, systems, profiles) derived from the generic ones, in Spark's SQL expressions.

The same expressions hold in the SQL that the queries are held against; only the tables' names differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REQUESTS = """o_orderkey AS request, o_custkey AS customer, o_orderdate AS creation, o_orderstatus AS raw_status,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE concat('Poster for ', o_orderpriority) END AS prompt,
  CASE o_orderkey % 5 WHEN 0 THEN '3' WHEN 1 THEN '9' WHEN 2 THEN 'many' WHEN 3 THEN NULL ELSE '0' END AS n_asked,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Generated' END AS mode_asked,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 100) AS BIGINT) END AS upload_bytes"""
DOCUMENTS = """c_custkey AS request, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_name END AS business_name, c_custkey % 2 = 1 AS render_asked,
  CASE c_custkey % 6 WHEN 0 THEN 'Full Suite' WHEN 1 THEN 'Plan Chapters' WHEN 2 THEN 'Pitch Deck' WHEN 3 THEN 'Financial Model' WHEN 4 THEN 'Briefs' ELSE 'Poster' END AS scope,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('plan, deck', chr(10), 'plan,, model ') WHEN 2 THEN 'business_profile' ELSE '' END AS artifacts"""
BRIEFS = """c_custkey AS brief, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(' Offer ', c_name, ' ') END AS headline,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'poster' WHEN c_mktsegment = 'AUTOMOBILE' THEN ' flyer ' WHEN c_mktsegment = 'MACHINERY' THEN 'pullup_banner'
    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'company_profile' ELSE 'billboard' END AS asset_type"""
APPROVALS = """o_orderkey AS candidate, CASE WHEN o_orderkey % 8 = 0 THEN 'short' ELSE lpad(CAST(o_orderkey AS STRING), 20, 'x') END AS token,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS linked_on,
  CASE o_orderkey % 4 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Rejected' WHEN 2 THEN 'Approved' ELSE 'Maybe' END AS decision"""
SYSTEMS = """s_suppkey AS system, s_nationkey AS owner, s_suppkey % 3 = 0 AS is_default,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CASE s_suppkey % 4 WHEN 0 THEN '#1a56db' WHEN 1 THEN '1a56db' WHEN 2 THEN '#xyz123' ELSE '#ABCDEF' END END AS token_hex,
  CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '#ABCDEF' ELSE 'red' END AS seed,
  CASE s_suppkey % 5 WHEN 0 THEN '12, 14,16' WHEN 1 THEN '12,large' WHEN 2 THEN NULL ELSE '8' END AS type_scale"""
PROFILES = """c_custkey AS profile, CASE WHEN c_custkey % 5 = 0 THEN 'Pending verification' ELSE c_name END AS trading_name, concat('Company ', CAST(c_custkey AS STRING)) AS company_name,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat(' Grow', chr(10), 'more') ELSE 'Not yet provided' END AS vision, CASE WHEN c_custkey % 2 = 0 THEN 'Value first' ELSE '' END AS proposition"""
SEEDS = """c_custkey AS seed, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 256 AS INT) END AS primary_r, CAST(c_custkey * 91 % 256 AS INT) AS primary_g,
  CAST(c_nationkey * 53 % 256 AS INT) AS primary_b, CAST(c_custkey * 71 % 256 AS INT) AS accent_r, CAST(c_nationkey * 29 % 256 AS INT) AS accent_g, CAST(c_custkey * 17 % 256 AS INT) AS accent_b"""
OF = {"requests": (REQUESTS, "orders"), "documents": (DOCUMENTS, "customer"), "briefs": (BRIEFS, "customer"), "approvals": (APPROVALS, "orders"), "systems": (SYSTEMS, "supplier"), "profiles": (PROFILES, "customer"), "seeds": (SEEDS, "customer")}


def desk(name: str):
    """Reader of one of the tables."""
    columns, table = OF[name]

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(f"SELECT {columns} FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return read


def sql(name: str) -> str:
    columns, table = OF[name]
    return f"desk_{name} AS (SELECT {columns.replace('AS STRING', 'AS VARCHAR')} FROM {table})"
