"""Session helpers shared by every query."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables, opened only through Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def work_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Only a local session that names none (tests) gets a temporary one; on a cluster its absence is an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and sc._jsc.sc().getCheckpointDir().isDefined():
        configured = sc._jsc.sc().getCheckpointDir().get()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="bracketry-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(configured)
    return configured


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Spark's switch for removing an execution's shuffle files when it has ended, and who may turn it.
CLEAN_UP, _TURN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", threading.Lock()


@contextmanager
def _cleaned(df: DataFrame) -> Iterator[None]:
    """Shuffle files of what runs here are removed. One thread at a time; the session's own setting comes back, an unset one unset."""
    conf = df.sparkSession.conf
    with _TURN:
        before = conf.get(CLEAN_UP, None)
        conf.set(CLEAN_UP, "true")
        try:
            yield
        finally:
            if before is None:
                conf.unset(CLEAN_UP)
            else:
                conf.set(CLEAN_UP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder; the shuffle files that led to it are removed."""
    work_dir(df.sparkSession)
    with _cleaned(df):
        return df.select("*").checkpoint()


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """df, written once to the shared folder in columns and removed at the end: for wide rows that are read more than once, by parts."""
    path = f"{work_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    try:
        with _cleaned(df):
            df.write.option("compression", "zstd").parquet(path)
        yield df.sparkSession.read.parquet(path)
    finally:
        discard(df.sparkSession, path)
