"""Monitoring on time windows and streams (L1-L3).

The reference monitors batch by batch (fit once, then detect per batch). Here the batches are
event-time windows:

* L1 ``ood_by_time_window``: tumbling windows; per window: rows, flagged rows (value below the
  reference percentile), ratio, severity. Batch form for tables, streaming form with a
  watermark and update output for feeds.
* L2 ``drift_on_closed_windows``: a detector with a saved fit runs inside the stream on every window
  that the watermark closes; ``drift_by_time_window``: windowed value counts against reference
  counts (ECDF distance) after the rows available now.
* L3 ``stream_scoring``: stateless scoring and OOD flagging of an unbounded feed, the fitted
  threshold attached as a one-row broadcast.

Streaming state stays bounded: only the windowed counts are stateful, and the watermark lets
Spark drop windows once they can no longer change.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ood import severity


def windowed_ood_counts(df: DataFrame, threshold: DataFrame, ts_col: str, value_col: str,
                        window: str = "1 day") -> DataFrame:
    """Per tumbling window: total, ood_count, ood_ratio, ood_severity (threshold: one row)."""
    th = threshold.select(F.col("threshold").alias("_th"))
    j = df.crossJoin(F.broadcast(th))
    v = F.col(value_col).cast("double")
    flagged = v.isNotNull() & ~F.isnan("_th") & (v < F.col("_th"))
    g = j.groupBy(F.window(ts_col, window).alias("window")).agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(flagged).alias("ood_count"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "total_samples", "ood_count",
                    (F.col("ood_count") / F.col("total_samples")).alias("ood_ratio"),
                    severity(F.col("ood_count"), F.col("total_samples")).alias("ood_severity"))


def stream_ood_by_time_window(stream: DataFrame, threshold_value: float, ts_col: str, value_col: str,
                              window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """L1 streaming form: event time must be a TIMESTAMP (cast ntz first), watermark + window. Meant
    for update mode: every window appears, also those the watermark has not passed yet."""
    s = stream.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    v = F.col(value_col).cast("double")
    known = threshold_value is not None and not math.isnan(threshold_value)  # a NaN threshold flags nothing
    flagged = v.isNotNull() & (v < F.lit(threshold_value)) if known else F.lit(False)
    g = s.groupBy(F.window(ts_col, window).alias("window")).agg(
        F.count(F.lit(1)).alias("total_samples"), F.count_if(flagged).alias("ood_count"))
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "total_samples", "ood_count", severity(F.col("ood_count"), F.col("total_samples")).alias("ood_severity"))


def run_to_files(query_df: DataFrame, out_path: str, checkpoint: str, output_mode: str = "append",
                 keys: list[str] | None = None) -> DataFrame:
    """Drive a streaming query over the files available now. Every micro-batch overwrites its own
    folder of Parquet files below ``out_path`` (a retried batch repeats nothing; nothing passes
    through the driver). With ``keys`` the last update of each key is the result."""
    spark = query_df.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = (query_df.writeStream.outputMode(output_mode).foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    back = spark.read.schema(T.StructType([*query_df.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(out_path)
    if not keys:
        return back.drop("epoch")
    rest = [c for c in query_df.columns if c not in keys]
    last = back.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*query_df.columns)


def drift_by_time_window(stream: DataFrame, reference: DataFrame, value_col: str, ts_col: str,
                         out_path: str, checkpoint: str, window: str = "1 day") -> DataFrame:
    """L2 for one number: per micro-batch, value counts per window go to a folder of that batch
    (overwritten on a retry); windows that span micro-batches merge when the counts are summed. The
    result is each window's ECDF (Wasserstein) distance to the reference; the reference's counts
    meet all windows of a value range in one task and are not repeated per window."""
    from ..operators.drift_batches import ecdf_to_reference
    v = F.col(value_col).cast("double").alias("value")

    def counts(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.window(F.col(ts_col).cast("timestamp"), window).start.alias("window_start"), v).agg(F.count(F.lit(1)).alias("w"))

    def per_batch(batch: DataFrame, epoch: int) -> None:
        counts(batch).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    q = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    spark = reference.sparkSession
    schema = "window_start timestamp, value double, w long, epoch int"
    cur = spark.read.schema(schema).parquet(out_path).groupBy("window_start", "value").agg(F.sum("w").alias("w"))
    ref = reference.groupBy(v).agg(F.count(F.lit(1)).alias("w")).withColumn("dim", F.lit(0))
    starts = sorted(r.window_start for r in cur.select("window_start").distinct().collect())  # one time a window
    names = spark.createDataFrame(list(enumerate(starts)), "batch int, window_start timestamp")
    got = ecdf_to_reference(ref, cur.join(names, "window_start").withColumn("dim", F.lit(0)))
    return names.join(got, "batch").select("window_start", "wasserstein", "n_ref", "n_cur")


def drift_on_closed_windows(stream: DataFrame, detect: Callable[[DataFrame, str], DataFrame], ts_col: str, out_path: str, checkpoint: str,
                            window: str = "1 day", delay: str = "1 day", flush: bool = False) -> DataFrame:
    """L2: the detector runs on every window as soon as the watermark has passed its end, while the
    stream goes on; the result is the table of what is closed so far.

    ``detect(rows, batch_col)`` gives a row per ``batch_id``, e.g. ``drift_detect_batches`` with a
    saved fit; all windows that close in one micro-batch are one call. Watermark: greatest event time
    up to this micro-batch less ``delay``; rows of a window that is already closed come too late and
    change nothing. Every micro-batch overwrites its own folder of rows and its own mark, and every
    window its own result folder, so a retried micro-batch repeats nothing. ``flush``: after the rows
    available now, close the remaining windows too. ``window_start`` names a window (UTC)."""
    spark = stream.sparkSession
    span = F.window(F.col(ts_col).cast("timestamp"), window)
    key = "window_key"

    def close(epoch: int, everything: bool) -> None:
        marks = spark.read.schema("seen timestamp, epoch int").parquet(f"{out_path}/marks").where(F.col("epoch") <= epoch)
        mark = marks.agg(F.max("seen").cast("timestamp").alias("m")).select((F.col("m") - F.expr(f"INTERVAL {delay}")).alias("m")).first()["m"]
        rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_end", T.TimestampType()), T.StructField("epoch", T.IntegerType()),
                                               T.StructField(key, T.StringType())])).parquet(f"{out_path}/rows").where(F.col("epoch") <= epoch)
        if not everything:
            if mark is None:
                return
            rows = rows.where(F.col("_end") <= F.lit(mark))
        done = f"{out_path}/results"
        if _exists(spark, done):
            earlier = spark.read.parquet(done).where(F.col("closed_in") < epoch).select(F.col(key).cast("string").alias(key)).distinct()
            rows = rows.join(F.broadcast(earlier), key, "left_anti")  # one short string a window
        if rows.isEmpty():
            return
        result = detect(rows.drop("_end", "epoch"), key).withColumnRenamed("batch_id", key).withColumn("closed_in", F.lit(epoch))
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(done)

    def per_batch(batch: DataFrame, epoch: int) -> None:
        named = batch.withColumn("_w", span).where(F.col("_w").isNotNull())
        named = named.withColumn("_end", F.col("_w.end")).withColumn(key, F.date_format("_w.start", "yyyyMMdd'T'HHmmss")).drop("_w")
        named.write.mode("overwrite").partitionBy(key).parquet(f"{out_path}/rows/epoch={epoch}")
        batch.agg(F.max(F.col(ts_col).cast("timestamp")).alias("seen")).write.mode("overwrite").parquet(f"{out_path}/marks/epoch={epoch}")
        close(epoch, False)

    q = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if flush and _exists(spark, f"{out_path}/marks"):
        last = spark.read.schema("seen timestamp, epoch int").parquet(f"{out_path}/marks").agg(F.max("epoch")).first()[0]
        close(last + 1, True)
    if not _exists(spark, f"{out_path}/results"):
        return spark.createDataFrame([], "window_start timestamp")
    back = spark.read.parquet(f"{out_path}/results")
    return back.select(F.to_timestamp(F.col(key).cast("string"), "yyyyMMdd'T'HHmmss").alias("window_start"), *[c for c in back.columns if c != key])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def flag_stream(stream: DataFrame, threshold: DataFrame, conf_col: str = "confidence") -> DataFrame:
    """L3: stateless flagging of a scored feed against the fitted one-row threshold."""
    th = threshold.select(F.col("threshold").alias("_th"))
    conf: Column = F.col(conf_col).cast("double")
    return stream.crossJoin(F.broadcast(th)).withColumn(
        "is_ood", conf.isNotNull() & ~F.isnan("_th") & (conf < F.col("_th"))).drop("_th")


def file_stream(spark: SparkSession, folder: str, like: DataFrame, file_glob: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    """A file feed (new files in ``folder`` matching ``file_glob``) with the schema of ``like``
    (streams need a declared schema). Where ``file_glob`` names a folder, a table written in parts,
    its files are the feed. ``max_files``: files of a micro-batch; by default all that are there,
    since the parts of a table come in no order of time and a watermark between them loses rows."""
    stream = spark.readStream.schema(like.schema)
    if max_files is not None:
        stream = stream.option("maxFilesPerTrigger", max_files)
    table = f"{folder.rstrip('/')}/{file_glob}"
    if _is_folder(spark, table):
        return stream.parquet(table)
    return stream.option("pathGlobFilter", file_glob).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()
