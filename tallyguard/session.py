"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback_dirs: dict[str, str] = {}


def build_session(app_name: str = "tallyguard", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.python.unix.domain.socket.enabled": "true",
        **conf,
    }
    if "spark.checkpoint.dir" not in settings and (master or "").startswith("local"):
        settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="tallyguard-")
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream checkpoints.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Where that is unset, a session
    on one machine gets a temporary folder; on a cluster other machines couldn't see one, so
    the setting is required there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback_dirs:
            _fallback_dirs[app] = tempfile.mkdtemp(prefix="tallyguard-")
        shared = _fallback_dirs[app]
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows written to the work folder and read back.

    Cuts the lineage of a frame that several branches read. The table is in shared storage, so
    the loss of an executor costs at most the tasks in flight. ``compression`` names a codec of
    Parquet for tables that are large or read often.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.parquet(path)
