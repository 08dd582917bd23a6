"""Streaming forms of time reductions: the same expressions over a stream of cells."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.cube import REDUCTIONS


def windowed(stream: DataFrame, on: str, keys: list[str], value: str, width: str, ops: tuple[str, ...], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``(*keys, start, end, *ops)``: reductions per tumbling or sliding window; rows later than ``late`` behind the newest are dropped, and state with them."""
    span = F.window(on, width, slide) if slide else F.window(on, width)
    out = stream.withWatermark(on, late).groupBy(*keys, span.alias("_w")).agg(*[REDUCTIONS[o](F.col(value)).alias(o) for o in ops])
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *ops)


def sessions(stream: DataFrame, on: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """``(*keys, start, end, n)``: runs of rows without a pause of ``gap``."""
    out = stream.withWatermark(on, late).groupBy(*keys, F.session_window(on, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def drained(spark: SparkSession, df: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that its source has now, into Parquet in the shared ``folder``, and read the final state."""
    path = f"{folder}/{uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    query = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")
