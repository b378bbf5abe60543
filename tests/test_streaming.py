from siftwell.operators.limits import limited
from siftwell.streaming import events as E

SF = "/root/testdata/sf0.001"


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = E.limited_stream(stream, "user_id", "ts", 1, "1 hour", "60 days").writeStream.format("memory").queryName("limits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.selectExpr("user_id", "CAST(window_start AS STRING)", "n", "rejected").collect()))
    assert key(spark.table("limits")) == key(limited(rows, "user_id", "ts", 1, "1 hour"))


def test_index_stream(spark, tmp_path):
    docs = [[(1, "a b a"), (2, "b c")], [(3, "c")], [(4, None)]]
    for part in docs:
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        E.index_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert {r.term: r.df for r in E.indexed(spark, f"{tmp_path}/out").collect()} == {"a": 1, "b": 2, "c": 2}
