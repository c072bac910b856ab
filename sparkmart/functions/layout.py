from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Files by a timestamp's day or month, sorted within by a column."""

    by: str
    grain: str
    sort: str

    @property
    def partition(self) -> str:
        return f"{self.by}_{self.grain}"

    def key(self):
        return F.date_trunc(self.grain, F.col(self.by)).cast("date")

    def write(self, df: DataFrame, path: str) -> None:
        """One shuffle by the partition's key, so that a task has few files open; a hot partition is dealt out by the sort column too."""
        out = df.withColumn(self.partition, self.key())
        out = out.repartition(F.col(self.partition), F.pmod(F.xxhash64(self.sort), F.lit(4)))
        out.sortWithinPartitions(self.partition, self.sort).write.mode("overwrite").partitionBy(self.partition).parquet(path)

    def between(self, df: DataFrame, low: str, high: str) -> DataFrame:
        """Rows in [low, high); names the partition column too, so that only its folders are read."""
        lo, hi = F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")
        part = F.col(self.partition)
        days = (part >= F.date_trunc(self.grain, lo).cast("date")) & (part <= F.to_date(hi))
        return df.where(days & (F.col(self.by) >= lo) & (F.col(self.by) < hi)).drop(self.partition)


def physical_layout(by: str = "created_at", grain: str = "month", sort: str = "product_id") -> Layout:
    if grain not in ("day", "month"):
        raise ValueError(f"no such partition grain: {grain!r}")
    return Layout(by, grain, sort)
