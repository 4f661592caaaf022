"""Spark session and shared-storage helpers.

Everything that needs durable scratch space (checkpoints that cut lineage, written
intermediate tables, file sinks used by the registered queries) goes below the folder the
cluster names in ``spark.checkpoint.dir``. A default is set only when the session has none,
which is the local test / bench situation.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "labelflow", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings every job here assumes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # one machine and nothing configured (local tests / benches): a fresh local folder
        current = tempfile.mkdtemp(prefix="labelflow-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # some deployments reject runtime changes of core settings
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def shared_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A fresh path under the shared output folder (for sinks and written tables).

    ``spark.labelflow.outputDir`` wins when set; otherwise a sub folder of the checkpoint
    folder is used, so nothing lands on a machine-local temp folder on a cluster.
    """
    root = spark.conf.get("spark.labelflow.outputDir", None)
    if not root:
        root = ensure_checkpoint_dir(spark).rstrip("/") + "/labelflow-out"
    path = "/".join([root.rstrip("/"), *parts])
    if unique:
        path = f"{path}-{uuid.uuid4().hex[:12]}"
    if path.startswith("/") or path.startswith("file:"):
        os.makedirs(os.path.dirname(path.replace("file:", "")), exist_ok=True)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``labelflow`` importable on executors (pandas UDFs reference its functions).

    Zips the package once per SparkContext and registers it with ``addPyFile``; Spark then
    serves the file to every executor. Does nothing if the package is already importable
    there through the cluster's own deployment (``spark.labelflow.shipped=true``)."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED or spark.conf.get("spark.labelflow.shipped", "false") == "true":
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="labelflow-pkg-")
    base = os.path.join(out_dir, "labelflow")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(pkg_dir), base_dir="labelflow")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


BATCH_ROWS = 2000
BATCH_BYTES = 2 << 20


def prepare_udfs(spark: SparkSession) -> None:
    """Before a plan with Python functions on texts or vectors: ship the package, and bound the Arrow
    batches by bytes too, so a worker's memory depends neither on the length of the texts nor on the
    rows of a partition (Spark's own bound is 10,000 rows of any length)."""
    ship_package(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_MATERIALISED: dict[tuple, str] = {}


def materialise(spark: SparkSession, key: str, build) -> "DataFrame":
    """Write ``build()`` once per application as Parquet under the shared folder and return a
    reader of it. Used where one expensive result (model scores) feeds several branches of a
    plan: they read the written table (with column pruning) instead of recomputing it, and a
    lost executor never forces a rescore."""
    k = (spark.sparkContext.applicationId, key)
    path = _MATERIALISED.get(k)
    if path is None:
        path = shared_path(spark, "tables", key.replace("/", "_"))
        build().write.mode("overwrite").parquet(path)
        _MATERIALISED[k] = path
    return spark.read.parquet(path)


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: "DataFrame", name: str, compression: str | None = None) -> "DataFrame":
    """Cut lineage through a Parquet table written to a fresh path in the shared folder and
    read back (reliable storage; later readers get column pruning and pushdown). The shuffle files
    of the job go when it ends: the table takes their place."""
    spark = df.sparkSession
    path = shared_path(spark, "tables", name)
    writer = df.write.mode("overwrite")
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        (writer.option("compression", compression) if compression else writer).parquet(path)
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path  # noqa: SLF001 - remembered so that drop_table can remove the files
    return out


def drop_table(df: "DataFrame") -> None:
    """Remove the files of a written table that no later step reads."""
    path = getattr(df, "_table_path", None)
    if path:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
