import __spark_entry__


def test_every_training_data_query_is_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert {"op2_dated_lists", "op8_revisits", "op9_quality_rules", "op10_ngram_jaccard", "op11_ball_kmeans", "op12_digest_index", "op13_merkle_manifest"} <= set(__spark_entry__.oracle_sql())
