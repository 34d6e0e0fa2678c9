"""Session settings shared by the tests, the bench and ad-hoc use."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; a cluster job passes its own session to every operator instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("boreline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_attached: set[str] = set()


def attach(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once per application.

    Workers import it by name; a job submitted with the package installed or in --py-files does not need this.
    """
    application = spark.sparkContext.applicationId
    if application not in _attached:
        folder = Path(tempfile.mkdtemp(prefix="boreline-package-"))
        root = Path(__file__).resolve().parent
        archive = folder / "boreline.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, str(file.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(archive))
        _attached.add(application)
    return spark
