"""Saved snapshots: metadata beside content-addressed bodies, read back with their hashes checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.operators.ranking import latest

from kvern.operators.ranking import best

METADATA = (
    "id string, requested_url string, final_url string, http_status int, retrieved_at timestamp, content_sha256 string, "
    "storage_path string, content_type string, error string"
)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).json(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """``(sha, body)`` of the files of a folder, named by their hash; files whose bytes have another hash are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"))
    named = files.select(F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1).alias("sha"), "body")
    return named.where(F.sha2("body", 256) == F.col("sha"))


def replay(metadata: DataFrame, bodies: DataFrame, cutoff: str | None = None) -> DataFrame:
    """For each URL its newest admissible snapshot with its body: retrieved by the cutoff and with bytes that fit the hash."""
    known = metadata if cutoff is None else metadata.where(F.col("retrieved_at") <= F.lit(cutoff).cast("timestamp"))
    whole = known.join(bodies, known["content_sha256"] == bodies["sha"]).drop("sha")
    return best(whole, ["requested_url"], [F.col("retrieved_at").desc(), F.col("id").desc()])


def outcome(status, error, address=None):
    """State of an answer by its HTTP status: available, not_available, blocked or failed."""
    return (
        F.when(error.isNotNull() & status.isNull(), "failed")
        .when(status == 200, "available")
        .when(status.isin(404, 410), "not_available")
        .when(status.isin(401, 403, 429, 451), "blocked")
        .otherwise("failed")
    )


def extension(content_type):
    """File ending for a content type."""
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    return (
        F.when(kind.contains("json"), ".json").when(kind.isin("text/html", "application/xhtml+xml"), ".html").when(kind.contains("xml"), ".xml")
        .when(kind.startswith("text/"), ".txt").otherwise(".bin")
    )


def read_previous(spark, path: str, schema: str, key: str, order: str):
    """The last row of each key in JSON lines, plain or gzipped; blank lines and rows without a key are none."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return latest(rows.where(F.col(key).isNotNull()), [key], [order])
