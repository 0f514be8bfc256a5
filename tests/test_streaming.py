import datetime as dt

from auditloom.streaming.scores import read_stream, windowed_losses


def test_stream_equals_table(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(i, 1, day(i % 20), "ft1", float(i)) for i in range(40)] + [(3, 1, day(3), "ft1", 3.0), (99, 1, day(2), "ft1", None)]
    d = spark.createDataFrame(rows, "row_no bigint, batch_no bigint, scored_at timestamp, model string, loss double")
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = windowed_losses(read_stream(spark, f"{tmp_path}/in", d.schema)).writeStream.outputMode("complete").format("memory").queryName("losses").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(r["window"]["start"], r["n"], r["mean_loss"]) for r in windowed_losses(d).collect()}
    assert {(r["window"]["start"], r["n"], r["mean_loss"]) for r in spark.table("losses").collect()} == want and want
