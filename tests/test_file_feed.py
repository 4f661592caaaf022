"""Feeds of a table that is one file or a folder of parts; late parts lose no rows."""

import datetime as dt

from pyspark.sql import functions as F

from labelflow.streaming import monitors as MO


def _rows(spark, n=40):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, day + dt.timedelta(days=n - i), float(i)) for i in range(n)], "k long, ts timestamp_ntz, value double")


def _fed(spark, stream, tmp_path):
    return MO.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt")


def test_folder_of_parts_is_a_feed(spark, tmp_path):
    rows = _rows(spark)
    rows.repartition(5, "k").write.parquet(f"{tmp_path}/data/t.parquet")
    got = _fed(spark, MO.file_stream(spark, f"{tmp_path}/data", rows, "t.parquet"), tmp_path)
    assert sorted(r.k for r in got.collect()) == list(range(40))


def test_one_file_is_a_feed(spark, tmp_path):
    rows = _rows(spark)
    rows.coalesce(1).write.parquet(f"{tmp_path}/parts")
    part = next((tmp_path / "parts").glob("part-*.parquet"))
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "t.parquet").write_bytes(part.read_bytes())
    (tmp_path / "data" / "other.parquet").write_bytes(part.read_bytes())
    got = _fed(spark, MO.file_stream(spark, f"{tmp_path}/data/", rows, "t.parquet"), tmp_path)
    assert sorted(r.k for r in got.collect()) == list(range(40))


def test_parts_out_of_time_order_are_counted_whole(spark, tmp_path):
    rows = _rows(spark)
    for k in range(4):  # the latest days come first
        rows.where((F.col("k") >= 10 * k) & (F.col("k") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/data/t.parquet")
    stream = MO.file_stream(spark, f"{tmp_path}/data", rows, "t.parquet")
    counted = MO.stream_ood_by_time_window(stream, 5.0, "ts", "value", "1 day", "1 day")
    got = MO.run_to_files(counted, f"{tmp_path}/out", f"{tmp_path}/ckpt", "update", ["window_start"]).collect()
    assert len(got) == 40 and sum(r.total_samples for r in got) == 40 and sum(r.ood_count for r in got) == 5
