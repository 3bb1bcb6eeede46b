"""Joins on hosts and names that are no plain equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.functions import text


def under_domains(pages: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """Rows whose host is one of ``domains (domain)`` or below it, with that domain; the longest where several fit.

    A host's parent domains are spelt out, so an equi-join does what a suffix test would.
    """
    parts = pages.withColumn("_suffix", F.explode(text.host_suffixes(F.col(url))))
    found = parts.join(domains.select(F.col("domain").alias("_suffix")).distinct(), "_suffix")
    columns = pages.columns
    best = found.groupBy(*columns).agg(F.max(F.struct(F.length("_suffix").alias("n"), F.col("_suffix").alias("domain"))).alias("_d"))
    return best.select(*columns, F.col("_d.domain").alias("domain"))


def names_within(labels: DataFrame, label: str, names: DataFrame, name: str, key: str) -> DataFrame:
    """``(label, key)``: labels that hold all distinctive tokens of a name.

    Instead of testing all pairs, a name joins by its rarest token, and only such
    pairs are tested.  Rarity is counted over the labels, so that no token that is
    everywhere becomes a join key where a name has another one.
    """
    tokens = labels.select(label).distinct().withColumn("_hay", F.array_distinct(text.tokens(F.col(label))))
    each = tokens.select(label, "_hay", F.explode("_hay").alias("_token"))
    seen = each.groupBy("_token").agg(F.count("*").alias("_n"))
    wanted = names.select(key, F.array_distinct(text.name_tokens(F.col(name))).alias("_needle")).distinct().where(F.size("_needle") > 0)
    rare = wanted.select(key, "_needle", F.explode("_needle").alias("_token")).join(seen, "_token", "left")
    rare = rare.groupBy(key, "_needle").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("t"))).alias("_r"))
    rare = rare.where("_r.n > 0").select(key, "_needle", F.col("_r.t").alias("_token"))
    pairs = each.join(rare, "_token")
    return pairs.where(text.contains_all(F.col("_hay"), F.col("_needle"))).select(label, key)
