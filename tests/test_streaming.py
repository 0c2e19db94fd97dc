import datetime as dt

from skyloom.streaming.arrivals import run_available, windowed_counts


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = lambda hours: spark.createDataFrame([(start + dt.timedelta(hours=h), "k") for h in hours], "ts timestamp, kind string")
    source = str(tmp_path / "in")
    rows([0, 0, 1]).write.parquet(source)
    args = (spark, source, "ts timestamp, kind string", "ts", str(tmp_path / "out"), str(tmp_path / "ckpt"))
    run_available(*args, keys=("kind",)).awaitTermination(60)
    rows([9, 9, 20]).write.mode("append").parquet(source)
    run_available(*args, keys=("kind",)).awaitTermination(60)
    got = {(r["start"].hour, r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(0, 2), (1, 1)} <= got and (20, 1) not in got
    assert windowed_counts(rows([0, 0]), "ts").first()["n"] == 2
