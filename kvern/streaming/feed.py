"""A change feed as a stream: latest state per key, windows with a watermark, and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kvern.session import Stage


def read(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The feed's files as they arrive; a single file or a folder of parts."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name if _is_file(spark, path) else "*.parquet").parquet(folder if _is_file(spark, path) else path)


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def latest_state(stream: DataFrame, key: str, by: list[str], keep: list[str]) -> DataFrame:
    """The row with the greatest ``by`` of each key so far.  The same row delivered again changes nothing."""
    row = F.max(F.struct(*by, *keep)).alias("row")
    return stream.groupBy(key).agg(row).select(key, *[F.col(f"row.{c}").alias(c) for c in (*by, *keep)])


def daily(stream: DataFrame, time: str, kind: str, delay: str) -> DataFrame:
    """``(day, kind, n)`` per closed day; later rows than the delay are dropped.  The feed has no rule for late rows, the delay is ours."""
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    counted = timed.groupBy(F.window("_at", "1 day").alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("day"), kind, "n")


class _Newest(StatefulProcessor):
    """Keeps the newest (time, order, status) of a key and gives a row when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "at timestamp, n bigint, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        new = held
        for batch in rows:
            for at, n, status in batch[["at", "n", "status"]].itertuples(index=False, name=None):
                if new is None or (at, n) > (new[0], new[1]):
                    new = (at, n, status)
        if new != held:
            self.state.update(new)
            yield pd.DataFrame({"key": [key[0]], "at": [new[0]], "n": [new[1]], "status": [new[2]]})

    def close(self) -> None:
        pass


def upserts(stream: DataFrame) -> DataFrame:
    """``(key, at, n, status)``: a row whenever a key's newest state changes.  ``stream (key, at, n, status)``; needs the RocksDB state store."""
    return stream.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Newest(), outputStructType="key bigint, at timestamp, n bigint, status string", outputMode="Update", timeMode="None"
    )


def run_now(result: DataFrame, mode: str, rocksdb: bool = False) -> DataFrame:
    """All that is there now, worked off as a stream in append or update mode; what came out as a table, with ``_batch``."""
    spark = result.sparkSession
    stage = Stage(spark, "stream")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    if rocksdb:
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    target = stage.path("rows")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/{number}")  # a batch run again replaces itself

    try:
        writer = result.writeStream.outputMode(mode).option("checkpointLocation", stage.path("state")).trigger(availableNow=True)
        writer.foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    if not stage.there("rows"):
        return spark.createDataFrame([], result.schema).withColumn("_batch", F.lit(0))
    return spark.read.option("recursiveFileLookup", True).parquet(target)


def settled(rows: DataFrame, key: str) -> DataFrame:
    """Of a key's updates the last."""
    rest = [c for c in rows.columns if c not in (key, "_batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(key, "r.*")
