"""Session settings and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Page texts are large: keep the batches that go to the outline UDF small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def local_session(cpus: str = "*", name: str = "storelens", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def staging_root(spark: SparkSession) -> str:
    """Shared folder the cluster names in ``spark.checkpoint.dir``; a fresh local one only where
    that is unset and the session itself is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="storelens-")
    return _LOCAL_ROOTS[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so several jobs share the work and a lost executor
    costs a re-read, not a re-parse."""
    path = f"{staging_root(df.sparkSession).rstrip('/')}/storelens/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
