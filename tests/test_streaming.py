from pyspark.sql import functions as F

from featherloom.operators.profile import moments
from featherloom.streaming import running


def test_running_profile_equals_the_batch(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = running.read_stream(spark, f"{tmp_path}/in", df.schema, 1)
    running.start(running.running_moments(stream, ["x"]), "m", f"{tmp_path}/c1").awaitTermination()
    assert [r["n"] for r in spark.table("m").collect()] == [1000]
    assert abs(spark.table("m").first()["mean"] - moments(df, ["x"]).first()["mean"]) < 1e-9
    running.start(running.running_categories(stream, "c"), "k", f"{tmp_path}/c2").awaitTermination()
    assert {r["value"]: r["cnt"] for r in spark.table("k").collect()} == {"0": 334, "1": 333, "2": 333}
    running.start(running.windowed_counts(stream, "ts", "c", late="30 days"), "w", f"{tmp_path}/c3").awaitTermination()
    assert spark.table("w").agg(F.sum("cnt")).first()[0] == 1000
    running.start_into(running.running_categories(stream, "c"), f"{tmp_path}/table", f"{tmp_path}/c4").awaitTermination()
    assert {r["value"]: r["cnt"] for r in spark.read.parquet(f"{tmp_path}/table").collect()} == {"0": 334, "1": 333, "2": 333}
