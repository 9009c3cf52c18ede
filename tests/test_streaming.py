from pyspark.sql import functions as F

from meshquill.operators import transfer as T
from meshquill.sources import fixtures as FX
from meshquill.streaming.deposit import deposit

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    rows = FX.particles_li(spark, SF).select("x", "y", "z", "m", F.lit("2024-01-01 00:00:30").cast("timestamp").alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = deposit(stream, FX.MESH, "node", 2, "m").writeStream.outputMode("complete").format("memory").queryName("deposited").option("checkpointLocation", str(tmp_path / "a")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.i, r.j, r.k): r.out for r in T.p2g_value(rows, FX.MESH, "node", 2, "m").collect()}
    assert {(r.i, r.j, r.k): r.out for r in spark.table("deposited").collect()} == want
    q = deposit(stream, FX.MESH, "node", 2, "m", time="ts").writeStream.outputMode("update").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "b")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("windowed").collect():
        last[r.i, r.j, r.k] = max(last.get((r.i, r.j, r.k), 0), r.out)
    assert last == want
