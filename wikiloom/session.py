"""Session settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wikiloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on, that deletes checkpoints once nothing uses them; everything else is left to
    the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    return ship_package(builder.config(map=settings).getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of all executors, wherever they run; done once per context."""
    context = spark.sparkContext
    if getattr(context, "_wikiloom_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="wikiloom-")) / "wikiloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    context._wikiloom_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, shared by all executors.

    ``spark.checkpoint.dir`` of the session wins. Only a local session that has none gets a temporary folder;
    on a cluster a missing setting is an error, since a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    if (current := context.getCheckpointDir()) is not None:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="wikiloom-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (files in the shared folder)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
