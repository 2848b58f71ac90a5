"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where that is unset and all runs on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or _OWN.setdefault("root", tempfile.mkdtemp(prefix="tideglass-"))


class Scratch:
    """Tables written once and read back, which cuts lineage and survives the loss of executors.

    Each operator call has a folder of its own. Tables that a loop has used up are dropped;
    the rest must stay, as the returned DataFrame still reads them, and go with the shared folder. A caller that
    has written what an operator returned may use ``used_up``.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tideglass-{name}-{uuid.uuid4().hex[:12]}"
        self.made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def used_up() -> Iterator[None]:
    """Drops all intermediate tables of operators called within, at the end."""
    before = len(Scratch.made)
    yield
    for scratch in Scratch.made[before:]:
        scratch.drop()
    del Scratch.made[before:]
