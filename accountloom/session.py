"""Session settings shared by tests, benchmarks and jobs."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "accountloom", cpus: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOCAL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("SHARED_FOLDER", f"{tempfile.gettempdir()}/{app}-shared"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for data that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a folder in the warehouse, which all executors share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that a job writes and reads again."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: set[str] = set()


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """A table derived from ``source``, written once per application to the shared folder, read back.

    ``by`` names partition columns. Data replaced under the same path while an application runs are
    not seen by it.
    """
    mark = hashlib.sha256(source.encode()).hexdigest()[:16]
    path = f"{shared_folder(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}/{name}-{mark}"
    if path not in _WRITTEN:
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        _WRITTEN.add(path)
    return spark.read.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
