import duckdb
import pytest

from limnos.plans import markup, oracle_comply, oracle_desk, oracle_palette, paths, queries, rounds

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events part customer supplier pages embeddings".split()


def rows(columns, data):
    def shown(x):
        return "-" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in data)


@pytest.mark.parametrize("name", ["oklab_roundtrip", "ring_area", "palette_report", "box_coverage", "palette_snap_roles", "color_parse", "grid_snap", "safe_margin", "max_colors", "layout_alignment", "layout_balance", "text_collisions", "contrast_audit", "report_score", "best_attempt", "status_violations", "grid_flow", "report_rollup_by_rule", *oracle_desk.SQL, *oracle_palette.SQL, *oracle_comply.SQL, *markup.SQL, *paths.SQL, *rounds.SQL])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(columns, [r.asDict() for r in df.collect()]) == rows(columns, [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
