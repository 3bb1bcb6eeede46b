"""Violations of the rules that a store of facts must keep, each as a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Families of facts.
FAMILIES = (
    "identity", "financials", "leadership", "locations", "group", "filing_history", "website", "description", "contact", "social_profiles", "hiring", "activity",
    "workforce",
)


def findings(facts: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """``(entity, id, code)``, sorted out of ``facts (entity, id, family, value, key, evidence_ids)``.

    ``evidence (evidence_id, source_url, content_sha256, body)``: where given, references
    must exist, have a plain http(s) URL and a hash that fits the body.
    """
    parts = [
        facts.where("value IS NULL OR size(evidence_ids) IS NULL OR size(evidence_ids) <= 0").select("entity", "id", F.lit("unsupported fact").alias("code")),
        facts.where(~F.col("family").isin(*FAMILIES) | F.col("family").isNull()).select("entity", "id", F.lit("unknown family").alias("code")),
        facts.where("family = 'financials' AND NOT coalesce(key, '') LIKE '%:%'").select("entity", "id", F.lit("financial fact missing period").alias("code")),
        facts.groupBy("entity", "id").count().where("count > 1").select("entity", "id", F.lit("duplicate fact id").alias("code")),
    ]
    if evidence is not None:
        refs = facts.select("entity", "id", F.explode("evidence_ids").alias("evidence_id"))
        joined = refs.join(evidence, "evidence_id", "left")
        url_ok = F.coalesce(F.col("source_url").rlike(r"^https?://[^/@\s]+(/|$)"), F.lit(False))
        hash_ok = F.coalesce(F.sha2("body", 256) == F.col("content_sha256"), F.lit(False))
        code = F.when(F.col("content_sha256").isNull(), "unknown evidence id").when(~url_ok, "invalid source url").when(~hash_ok, "hash mismatch")
        parts.append(joined.select("entity", "id", code.alias("code")).where("code IS NOT NULL"))
    return reduce(DataFrame.unionByName, parts).distinct()


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count("*").alias("n"))
