"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII white space 9-13 and 32.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local session (tests); on a
    cluster executors couldn't see it, so that's an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="citeloom-"))
    return folder


#: Spark then removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs within leaves no shuffle files behind: its result is in a table or a checkpoint."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    with tidy(spark):
        out = df.checkpoint(eager=True)
    _taken[0] += 1
    if _taken[0] % RELEASE_EVERY == 0:
        release_shuffles(spark)
    return out


class Tables:
    """Compressed Parquet tables in the shared folder, removed when the block ends, however it ends.

    For what is large for a while: a checkpoint's files aren't compressed.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.count, self.paths = 0, {}

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *exc) -> None:
        remove(self.spark, self.at)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.at}/{self.count}"
        with tidy(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, kept: DataFrame) -> None:
        """Remove one of the tables before the end."""
        remove(self.spark, self.paths.pop(id(kept)))


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Iterative operators leave shuffle files of finished rounds behind until the driver collects garbage.
RELEASE_EVERY = 2
_taken = [0]


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def doc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` know ASCII only: just the A-Z and the
    white space (9-13, 32) that the word definition names.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def ensure_path(path: str) -> str:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
