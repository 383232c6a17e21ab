from pyspark.sql import functions as F

from reviewlake.streaming import ledger


def drive(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streaming_twins(spark, tmp_path):
    rows = [("a", "r", "floor", "2026-06-01 00:00:00"), ("a", "r", "floor", "2026-06-01 00:00:01"), ("b", "r", "inspect", "2026-06-01 02:00:00")]
    df = spark.createDataFrame(rows, "id string, repo string, event string, t string").select("id", "repo", "event", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert drive(ledger.first_findings(stream), "firsts", "append").count() == 2
    counts = {(r["event"], r["n"]) for r in drive(ledger.ledger_counts(stream), "counts", "complete").collect()}
    assert counts == {("floor", 2), ("inspect", 1)}
