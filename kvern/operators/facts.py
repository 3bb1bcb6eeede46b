"""Records to facts: one row per entity, field and value, with what is needed to cite it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.functions.identifiers import content_id
from kvern.operators.ranking import best


def unpivot(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """``(key, field, value)``: a row for every field that says something; null and blank values are no facts."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), value.cast("string").alias("value")) for name, value in fields.items()])
    rows = df.select(key, F.explode(pairs).alias("fact")).select(key, "fact.*")
    return rows.where(F.trim("value") != "")


def with_ids(facts: DataFrame, family: str, key: str) -> DataFrame:
    """``id`` over what identifies a fact: not its value, so that a changed value keeps its id."""
    return facts.withColumn("id", content_id("cl_", F.lit("claim-v1"), F.col(key), F.lit(family), F.col("field")))


def first_wins(facts: DataFrame, order: list[Column]) -> DataFrame:
    """One row per ``id``: the first in the order.  ``conflicts`` counts the rows with another value that lost to it."""
    values = facts.groupBy("id").agg(F.count("value").alias("_n"), F.collect_set("value").alias("_values"))
    kept = best(facts, ["id"], order).join(values.select("id", (F.size("_values") - 1).alias("conflicts")), "id")
    return kept.withColumn("conflicts", F.greatest(F.col("conflicts"), F.lit(0)))


def union_evidence(facts: DataFrame) -> DataFrame:
    """``(id, evidence_ids)``: all evidence of repeated identical facts, sorted, each once."""
    each = facts.select("id", F.explode("evidence_ids").alias("evidence"))
    return each.groupBy("id").agg(F.array_sort(F.collect_set("evidence")).alias("evidence_ids"))


def first_citation(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each fact with its first evidence that exists: ``facts`` columns and those of ``evidence`` but its id, null where none does."""
    cited = facts.select("id", F.posexplode("evidence_ids").alias("_pos", "evidence_id"))
    found = cited.join(evidence, "evidence_id")
    rest = [c for c in evidence.columns if c != "evidence_id"]
    chosen = found.groupBy("id").agg(F.min(F.struct("_pos", "evidence_id", *rest)).alias("_first"))
    return facts.join(chosen, "id", "left").select(*facts.columns, *[F.col(f"_first.{c}").alias(c) for c in ("evidence_id", *rest)])


def known_before(facts: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Facts that are not known yet."""
    return facts.join(known.select(*on).distinct(), on, "left_anti")
