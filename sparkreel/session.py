"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "sparkreel", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides them."""
    settings = {
        # Call-site capture costs several JVM round trips per expression while a plan is built.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where none is named, a local master (tests, laptops) gets a temporary one; on a cluster that is an error, as executors don't
    share their own disks.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkreel-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")


CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Frames made meanwhile give up their shuffles' files when they have run, not with the next collection of garbage."""
    before = spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written rows. Nothing reads the shuffles of the step again."""
    shared_dir(df.sparkSession)
    with _clean_shuffles(df.sparkSession):
        # A new frame, as a frame keeps the setting it was made under.
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` to ``folder`` and go on from its files, for steps that are repeated and tables that are removed early.

    A checkpoint keeps the size Spark estimates for its plan, where each join multiplies those of its sides: after some rounds of joins that is a number of
    millions of digits, which the driver computes and keeps for every plan. Files have their own size.
    """
    with _clean_shuffles(df.sparkSession):
        df.select("*").write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove_folder(folder: str) -> None:
    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.delete_dir(path)
