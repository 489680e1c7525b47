"""Session helpers shared by every operator: code shipping, shared storage, sizing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "quillon", cores: str = "*", **conf) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers (served by the driver, no shared folder needed)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        d = tempfile.mkdtemp(prefix="quillon")
        path = os.path.join(d, f"quillon_{uuid.uuid4().hex[:8]}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
    # Texts differ in length by four orders of magnitude, so batches are bounded by rows and by bytes; what the session
    # has been given stays.
    for key, usual, ours in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", None, str(16 << 20))):
        name = f"spark.sql.execution.arrow.{key}"
        if sc.getConf().get(name, None) is None and (usual is None or spark.conf.get(name) == usual):
            spark.conf.set(name, ours)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets one of its own; any other
    session must name it in spark.checkpoint.dir."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        d = tempfile.mkdtemp(prefix="quillon_ck")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables that an operator writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/quillon/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
