from pyspark.sql import functions as F

from portloom.sources import text
from portloom.streaming import sink


def test_counts_and_upsert(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i // 4} 10:00:00", "click" if i % 2 else "view") for i in range(12)], "event_id bigint, t string, event_type string").select("event_id", F.to_timestamp("t").alias("ts"), "event_type")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = sink.type_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [2] * 6
    for k in (2, 3):
        q = sink.new_keys(stream, "event_type", "ts").writeStream.foreachBatch(sink.upsert(out, "event_type")).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c{k}").start()
        q.awaitTermination()
    assert sorted(r["event_type"] for r in spark.read.parquet(out).collect()) == ["click", "view"]


def test_colored_text_files(spark, tmp_path):
    (tmp_path / "g.txt").write_text("2 1 0 1  0 1\n\n3 2 0 0 0  0 1 0 2\n")
    assert sorted(r["n"] for r in text.read_colored(spark, str(tmp_path / "g.txt")).collect()) == [2, 3]
