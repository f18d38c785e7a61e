"""What the operators need from the session: tables, checkpoints, sizes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in spark.checkpoint.dir.

    Only a session on one machine (master local) that names none gets a folder
    of its own; on a cluster, where executors do not share it, that is an error.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if wanted is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            wanted = tempfile.mkdtemp(prefix="wordloom-checkpoint-")
        sc.setCheckpointDir(wanted)
        have = sc.getCheckpointDir()
    return have


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written as a table in the checkpoint folder, and read from there.

    Used for results that are read more than once or that end an iteration; a
    lost executor then costs a re-read, not a recomputation.  A written table
    is compressed, gives readers only the columns they ask for and tells the
    planner its size.  See forget().
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that cut_lineage() wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table that may be broadcast (words or contexts: some 100 bytes each).
BROADCAST_ROWS = 500_000


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per session.

    Python functions and broadcast objects name its modules; executors that
    have no copy on their path load it from the archive sent with the job.
    """
    sc = spark.sparkContext
    if getattr(sc, "_wordloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wordloom-package-")) / "wordloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f"{root.name}/{f.relative_to(root).as_posix()}")
    sc.addPyFile(str(archive))
    sc._wordloom_shipped = True
