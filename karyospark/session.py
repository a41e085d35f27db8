"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, unless their path has it already."""
    sc = spark.sparkContext
    paths = {os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) + [os.getcwd()]}
    if str(ROOT) in paths or getattr(sc, "_karyospark_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="karyospark-"), "karyospark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "karyospark").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(target)
    sc._karyospark_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only a local session without that setting gets a temporary one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="karyospark-checkpoints-")
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises df in the checkpoint folder, which outlives any executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
