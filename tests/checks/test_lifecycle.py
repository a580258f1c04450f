from limnos.operators import lifecycle


def test_best_grid_without_a_row_for_each_try(spark):
    units = spark.createDataFrame([(1, 1), (2, 7), (2, 7), (3, 50), (4, None), (5, 0)], "unit int, n int")
    df = lifecycle.grid_flow(units)
    assert sorted((r.unit, r.cols, r.rows, r.cell) for r in df.collect()) == [(1, 1, 1, 700.0), (2, 4, 2, 241.0), (3, 9, 6, 100.4)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "max(" not in plan
