from pyspark.sql import functions as F
from tidemark.operators import asof
from tidemark.streaming import running


def test_career_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, f"2024-01-{1 + i // 6:02d} 0{i % 6}:00:00", float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "k long, t string, v double").withColumn("t", F.to_timestamp("t"))
    for i in range(4):
        df.where(F.dayofmonth("t") == i + 1).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = running.career_stream(stream, "k", "t", "v")
    done.writeStream.format("memory").queryName("career").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    got = sorted((r.k, str(r.t), r.n_before, r.sum_before) for r in spark.table("career").collect())
    want = asof.career_before(df, "k", "t", {"n": F.count("*"), "s": F.sum("v")})
    assert got == sorted((r.k, str(r.t), r.n, r.s) for r in want.withColumn("s", F.coalesce("s", F.lit(0.0))).collect())
