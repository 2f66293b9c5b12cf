"""Session settings shared by batch and streaming operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and tables written between passes.

    The cluster names it in ``spark.checkpoint.dir``. A local session without
    the setting gets a temporary folder; any other session must name one.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="fleetlens-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again, so that later passes neither compute it anew nor
    depend on executors that have gone."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def use_utc(spark: SparkSession) -> None:
    """All instants of the data model are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a session, once, when it was not installed there.

    A driver that found the package by a changed ``sys.path`` only would otherwise start Python tasks that can't import
    it. An installed package, and one on ``PYTHONPATH``, is left alone.
    """
    root = Path(__file__).resolve().parent
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if root.parent in paths or "site-packages" in root.parts or getattr(context, "_fleetlens_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="fleetlens-package-")) / "fleetlens.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    # files of that kind do not reach the runner that Spark starts beside the driver for streams with state
    known = context.environment.get("PYTHONPATH", "")
    context.environment["PYTHONPATH"] = os.pathsep.join([str(root.parent), *([known] if known else [])])
    context._fleetlens_shipped = True
