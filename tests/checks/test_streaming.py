from pyspark.sql import functions as F

from limnos.operators import lifecycle
from limnos.sources import bridge
from limnos.streaming import lifecycle as stream

SF = "/root/testdata/sf0.001"


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    batch = bridge.lifecycle(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = stream.violations(events).writeStream.format("memory").queryName("violations").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.before, r.after): r["count"] for r in spark.table("violations").groupBy("before", "after").count().collect()}
    assert got == {(r.before, r.after): r.steps for r in lifecycle.status_violations(batch).collect()}
