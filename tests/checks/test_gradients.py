from limnos.operators import gradients


def table(spark, *docs):
    rows = [(d, k, *(s or (None, None, None))) for d, stops in enumerate(docs) for k, s in enumerate(stops)]
    return spark.createDataFrame(rows, "doc_id long, k long, r int, g int, b int")


BLUE, NEAR, RED = (0x1A, 0x56, 0xDB), (0x1C, 0x58, 0xD8), (255, 0, 0)


def test_stops(spark):
    df = table(spark, [BLUE, NEAR, None], [BLUE] * 6, [RED], [BLUE] * 9)
    got = {}
    for r in gradients.gradient_stops(df).orderBy("k").collect():
        got.setdefault(r.doc_id, []).append((r.token, r.severity, r.kept, r.stops))
    assert got[0] == [("primary", None, True, 3), ("primary", "warning", True, 3), (None, None, True, 3)]
    assert [k for k, s in enumerate(got[1]) if s[2]] == [0, 2, 3, 5] and [k for k, s in enumerate(got[3]) if s[2]] == [0, 3, 5, 8]
    assert got[2][0][1] == "error"
    assert gradients.gradient_stops(df.limit(0)).count() == 0


def test_flattened(spark):
    got = {r.doc_id: (r.hex, r.token) for r in gradients.flattened(table(spark, [BLUE, BLUE, None], [None], [(0, 0, 0), (255, 255, 255)])).collect()}
    assert got[0] == ("#1a56db", "primary") and got[1] == ("#808080", "muted") and got[2] == ("#636363", "muted")
