"""Streams give what the same rows give as a table."""

from loreweave.operators import vault
from loreweave.streaming import log as streamed

SF = "/root/testdata/sf0.001"


def run(df, name, mode, checkpoint):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_latest_row_of_a_stream(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{SF}/event*.parquet")
    got = run(streamed.latest(stream, "user_id", "ts", "event_id"), "newest", "complete", f"{tmp_path}/c")
    assert sorted(map(tuple, got.select("user_id", "event_id").collect())) == sorted(map(tuple, vault.latest(table, "user_id", "ts", "event_id").select("user_id", "event_id").collect()))


def test_days_close_with_the_watermark(spark, tmp_path):
    rows = [(1, "2024-01-01 03:59:00"), (1, "2024-01-01 04:00:00"), (2, "2024-01-02 03:00:00"), (2, "2024-01-09 12:00:00")]
    spark.createDataFrame(rows, "card_id long, at string").selectExpr("card_id", "cast(at as timestamp) at").write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("card_id long, at timestamp").parquet(f"{tmp_path}/log")
    got = run(streamed.daily_answers(stream), "days", "append", f"{tmp_path}/c")
    assert sorted((str(r.day), r.answers, r.cards) for r in got.collect()) == [("2023-12-31", 1, 1), ("2024-01-01", 2, 2)]
