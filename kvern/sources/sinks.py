"""Writers.  Spark's committer makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.operators.ranking import chunked


def write_lines(df: DataFrame, path: str, compress: bool = False) -> None:
    """A JSON text per row; gzip where asked."""
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """A run beside earlier ones, none overwritten but a repeat of the same run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_chunks(df: DataFrame, order: list[Column], path: str, size: int = 25) -> None:
    """Rows in blocks of ``size``, each block its own folder."""
    chunked(df, order, size).write.mode("overwrite").partitionBy("chunk").json(path)


def content_addressed(bodies: DataFrame, body: str) -> DataFrame:
    """``(sha, body)``: every distinct body once under its hash."""
    hashed = bodies.where(F.col(body).isNotNull()).select(F.sha2(body, 256).alias("sha"), F.col(body).alias("body"))
    return hashed.groupBy("sha").agg(F.first("body").alias("body"))
