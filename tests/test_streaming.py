from docledger.operators.merkle import head, levels
from docledger.streaming import ledger


def test_append_log_is_stable_over_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "k bigint, entry binary"
    spark.createDataFrame([(i, bytes([i])) for i in range(5)], schema).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)
    ledger.append_log(read(), out, ck, "k").awaitTermination()
    first = head(levels(spark.read.parquet(out))).first()
    spark.createDataFrame([(i, bytes([i])) for i in range(5, 9)], schema).write.mode("append").parquet(src)
    ledger.append_log(read(), out, ck, "k").awaitTermination()
    ledger.append_log(read(), out, ck, "k").awaitTermination()
    log = spark.read.parquet(out)
    assert sorted(r.idx for r in log.collect()) == list(range(9))
    assert head(levels(log.where("idx < 5"))).first() == first


def test_repeated_content_arrives_once(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "content string, at timestamp"
    spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:10:00'), ('b', timestamp'2024-01-01 00:00:00') as t(content, at)").write.parquet(src)
    q = ledger.distinct_objects(spark.readStream.schema(schema).parquet(src), "content", "at").writeStream.format("memory").queryName("objs").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("objs").count() == 2
    n = ledger.windowed_counts(spark.readStream.schema(schema).parquet(src), "at", "content").writeStream.format("memory").queryName("wins").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    n.awaitTermination()
    assert {(r.content, r.n) for r in spark.table("wins").collect()} == {("a", 2), ("b", 1)}
