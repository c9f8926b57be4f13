"""Deliveries as a stream equal the batch rule."""

from strandloom.streaming import deliveries

from .conftest import NODES


def test_repeated_deliveries_count_once(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.datetime(2031, 3, n)
    first = [("1", 0, "b", "p", "+", 0, 5, day(1)), ("2", 0, "b", "p", "+", 5, 9, day(1)), (None, 0, "b", "p", "+", 0, 5, day(1))]
    later = [("1", 0, "b", "p", "+", 0, 5, day(9)), ("3", 0, None, "p", None, 9, 12, day(20))]
    for i, part in enumerate((first, later)):
        spark.createDataFrame(part, NODES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(NODES).parquet(str(tmp_path / "in"))
    deliveries.append_table(deliveries.first_deliveries(stream, "node_id"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["node_id"] for r in got.collect()) == ["1", "2", "3"]
