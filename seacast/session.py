"""Session defaults, reliable checkpoints and shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # AQE swaps a sort-merge join for a broadcast only once the shuffled side is
    # measured below this size; beyond it the sort-merge join (with skew split) stays.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "seacast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A local session (tests) may leave it unset and gets a temporary folder; on a
    cluster a missing setting is an error, because a machine-local folder is lost
    with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="run-seacast-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


_given: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written table; :func:`drop_stages` deletes it."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def drop_stages() -> int:
    """Deletes what this process wrote to scratch paths so far; returns how many paths held something.

    For the end of a job: frames that still read those tables cannot be used afterwards.
    """
    dropped = 0
    while _given:
        path = _given.pop()
        fs, where = pyarrow.fs.FileSystem.from_uri(path if ":" in path else os.path.abspath(path))
        if fs.get_file_info(where).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(where)
            dropped += 1
    return dropped


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    For frames that iterative work reads many times: each pass then reads only its columns,
    and a lost executor re-reads files instead of recomputing the lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
