"""Session helpers: runtime settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every query assumes.  All are runtime SQL confs, safe to set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def _driver_memory() -> str:
    """Local-mode heap: about 60 % of physical memory, at most 16 GB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        gb = max(1, min(16, int(total * 0.6 / 2**30)))
    except (ValueError, OSError, AttributeError):
        gb = 4
    return f"{gb}g"


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "martlens") -> SparkSession:
    """Local session for tests and the bench.  On a cluster, use the cluster's session."""
    master = master or os.environ.get("MARTLENS_MASTER", "local[8]")
    scratch = tempfile.mkdtemp(prefix="martlens-")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", _driver_memory())
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cut folder.

    Read from the session (the context's checkpoint directory, else
    ``spark.checkpoint.dir``); only when the session has none and runs in
    local mode (tests) is a private one created.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (remote sessions have no context object)
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = (sc.master if sc is not None else spark.conf.get("spark.master", "")) or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; a shared folder is required on a cluster")
        configured = tempfile.mkdtemp(prefix="martlens-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def remove_intermediates(spark: SparkSession) -> None:
    """Deletes every table this session has written under its checkpoint folder.  Frames that read
    them must not be used afterwards."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        fs.delete(status.getPath(), True)


def cut_lineage(df: DataFrame, name: str = "cut", compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used where a plan must not be recomputed differently (range-partition
    membership that later offsets refer to).  A written table survives lost
    executors, and unlike an RDD checkpoint it is computed once (no second
    pass to save it).  Never a local checkpoint, never a machine-local folder
    on a cluster.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/martlens-cut/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.parquet(path)
