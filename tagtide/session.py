"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library relies on.  AQE re-plans joins against
# small runtime aggregates (prefix tables, per-file maxima) as broadcasts once
# their real size is known, and splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tagtide", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let the launcher decide; tests use
    ``local[*]`` with a handful of shuffle partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for key in ("spark.sql.mapKeyDedupPolicy", "spark.sql.session.timeZone"):
        spark.conf.set(key, conf[key])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``.  Only a local-mode session
    without one (tests) gets a fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tagtide-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tagtide-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Used before operators that read their input twice (two-level prefixes),
    when that input is itself an expensive plan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_table(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Evaluate a bounded table (one row per language, split, ...) once and
    return it as a local single-partition DataFrame.

    Raises instead of truncating when the table is larger than ``max_rows``.
    Downstream plans then carry a literal table instead of the whole
    sub-plan, and the check runs once, before the large jobs start.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected a bounded table of at most {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, df.schema).coalesce(1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the parquet tables of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever file system its path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def input_mark(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(modification time, bytes, files) of a file or folder: another mark means changed data."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(p)
    return fs.getFileStatus(p).getModificationTime(), summary.getLength(), summary.getFileCount()
