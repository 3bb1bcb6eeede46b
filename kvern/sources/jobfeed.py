"""Job ads as a feed of states: the last state of each ad, who advertises, and what is open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.operators.ranking import latest


def current_ads(entries: DataFrame) -> DataFrame:
    """The last state of every ad, by change time and then delivery.  Combines before the shuffle, so an ad delivered very often is no hot spot."""
    return latest(entries, ["uuid"], ["sistEndret", "received_at"])


def changed_since(entries: DataFrame, cursor) -> DataFrame:
    """What the feed delivered after a cursor, an instant; with none, all of it."""
    return entries if cursor is None else entries.where(F.col("received_at") > F.lit(cursor))


def nominated(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """Ads of an index that are not known to be closed: an ad the live feed does not name counts as open."""
    known = state.select("uuid", F.col("status").alias("live"))
    return wanted.join(known, "uuid", "left").where(F.coalesce("live", F.lit("ACTIVE")) == "ACTIVE").drop("live")


def by_employer(ads: DataFrame) -> DataFrame:
    """``(employer, ads, first_day, last_day)``: the inverted index as counts and days; the ads themselves are a join away."""
    return ads.groupBy("employer").agg(F.count("*").alias("ads"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
