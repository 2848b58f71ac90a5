"""An immutable store of observations: Parquet partitioned by vintage, derived indexes, an append-only pointer log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import intake_violations

OBSERVATIONS = "series_id string, date date, value double, is_proxy boolean, vintage string"


class Store:
    """Under ``root``: ``observations/vintage=...``, written once each, and the logs ``pointer``, ``qc`` and ``intake``, only ever appended to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def write(self, vintage: str, frame: DataFrame) -> None:
        """Writes a whole vintage; one that is there already is refused, and nothing of it is touched."""
        path = f"{self.root}/observations/vintage={vintage}"
        proxy = F.col("is_proxy") if "is_proxy" in frame.columns else F.lit(False)
        rows = frame.select("series_id", F.col("date").cast("date").alias("date"), F.col("value").cast("double").alias("value"), proxy.cast("boolean").alias("is_proxy"))
        rows.repartition("series_id").sortWithinPartitions("series_id", "date").write.mode("errorifexists").parquet(path)

    def read(self) -> DataFrame:
        """All vintages; filters on vintage prune folders, those on series and date reach the files."""
        if not self._exists(f"{self.root}/observations"):
            return self.spark.createDataFrame([], OBSERVATIONS)
        return self.spark.read.schema(OBSERVATIONS).parquet(f"{self.root}/observations")

    def series(self, vintage: str, series_id: str) -> DataFrame:
        """Exactly one series of one vintage; there is no falling back to another."""
        out = self.read().where((F.col("vintage") == vintage) & (F.col("series_id") == series_id))
        if out.isEmpty():
            raise KeyError(f"{series_id} is not in vintage {vintage}")
        return out

    def index(self) -> DataFrame:
        return self.read().groupBy("vintage", "series_id").agg(F.count(F.lit(1)).alias("n_obs"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))

    def log(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def take_in(self, name: str, rows: DataFrame, columns: Sequence[tuple[str, float | None, float | None]], received_at: str) -> bool:
        """Checks a delivered table of text against ``columns (name, low, high)`` and logs it as accepted or rejected, with what was wrong."""
        wrong = intake_violations(rows, columns)
        faults = wrong.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("faults"), F.array_sort(F.collect_list(F.concat_ws(" ", "kind", "column", "n"))).alias("wrong"))
        verdict = faults.select(F.lit(name).alias("file"), F.lit(received_at).alias("received_at"), (F.col("faults") == 0).alias("accepted"), "faults", "wrong")
        accepted = verdict.first()["accepted"]
        self.log("intake", verdict)
        return accepted

    def set_current(self, vintage: str, seq: int, set_at: str) -> None:
        self.log("pointer", self.spark.createDataFrame([(seq, vintage, set_at)], "seq long, vintage string, set_at string"))

    def as_of(self, moment: str | None = None) -> str | None:
        """The vintage that was current at ``moment``; times are ISO text and compare as text, ties go to the later entry."""
        if not self._exists(f"{self.root}/pointer"):
            return None
        log = self.spark.read.schema("seq long, vintage string, set_at string").parquet(f"{self.root}/pointer")
        if moment is not None:
            log = log.where(F.col("set_at") <= moment)
        return log.agg(F.max_by("vintage", F.struct("set_at", "seq"))).first()[0]
