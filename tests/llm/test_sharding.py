import zlib
from collections import Counter

from pyspark.sql import functions as F

from limnos.llm import registry, sharding


def test_laws(odd, none, make, text_of, tmp_path):
    docs = make([(k % 50, text_of(k % 7, 12)) for k in range(3_000)]).unionByName(odd)
    out = sharding.shuffle_records(docs, shards=8, bucket_rows=256)
    got = out.select("record.doc_id", "record.text", "size", "text_crc32", "shard", "slot").collect()
    assert len(got) == docs.count()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert sharding.shuffle_records(none).count() == 0
    sharding.write_shards(out, str(tmp_path / "shards"), slots_per_file=200)
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(got)


def test_fisher_yates_is_a_permutation(spark):
    rows = spark.range(1, 40).select("id", sharding.fisher_yates(F.col("id").cast("int"), F.lit(1), F.col("id")).alias("p")).collect()
    assert all(sorted(r.p) == list(range(r.id)) for r in rows)
    firsts = [r.p[0] for r in spark.range(2_000).select(sharding.fisher_yates(F.lit(5), F.lit(9), F.col("id")).alias("p")).collect()]
    assert all(300 < n < 500 for n in Counter(firsts).values())


def test_order_depends_on_the_seed_and_not_on_the_run(make, text_of):
    docs = make([(k, text_of(k, 5)) for k in range(200)]).coalesce(1)
    order = lambda seed: [r.doc_id for r in sharding.shuffle_records(docs, seed=seed).orderBy("slot", "shard").select("record.doc_id").collect()]
    assert order(1) == order(1) != order(2)


def test_native(odd):
    assert "Python" not in sharding.shuffle_records(odd)._jdf.queryExecution().optimizedPlan().toString()


def test_query_reads_whole_records_from_written_shards(spark, make, text_of, tmp_path):
    docs = make([(k, text_of(k, 12)) for k in range(3_000)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.op6_external_shuffle(spark, str(tmp_path))
    folder = {f.rpartition("/shard=")[0] for f in out.inputFiles()}
    assert len(folder) == 1
    back = spark.read.parquet(folder.pop())
    assert sorted(r.record for r in back.select("record").collect()) == sorted(docs.collect())
    assert sorted(out.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == sorted(back.select("record.doc_id", "size", "text_crc32", "shard", "slot").collect())


def test_files_of_a_shard_follow_each_other(spark, make, text_of):
    out = sharding.written_shards(sharding.shuffle_records(make([(k, text_of(k % 9, 12)) for k in range(3_000)]), shards=4, bucket_rows=128))
    for s in range(4):
        files = sorted(f for f in out.inputFiles() if f"/shard={s}/" in f)
        slots = [r.slot for f in files for r in spark.read.parquet(f).select("slot").collect()]
        assert slots == list(range(750))
