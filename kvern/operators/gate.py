"""Whether a website belongs to an entity: signals per page, then rules, the first that fits decides.

Signals are columns and rules a chain of conditions, so a decision can be read off a
row and checked in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvern.functions import identifiers, text

#: Words of a group of companies, and phrases of parked sites.
GROUP_WORDS = ("gruppen", "group", "konsern", "konsernet", "holding", "holdings")
PARKED = "domain is for sale|buy this domain|domenet er til salgs|parkert domene|this domain may be for sale"


def signals(pairs: DataFrame) -> DataFrame:
    """Signals of ``(org, name, postcode, town, phone, mail, title, lines, url, ...)``; missing attributes give false signals.

    A site is judged by all its pages: signals are taken per page and combined by entity and host.
    """
    body = F.concat_ws("\n", "title", F.array_join("lines", "\n"))
    hay = text.tokens(body)
    owner = text.tokens(F.concat_ws(" ", F.col("title"), F.array_join(F.filter("lines", lambda x: F.contains(x, F.lit("©"))), " ")))
    name = text.name_tokens(F.col("name"))
    numbers = identifiers.org_mentions(body)
    digits = F.regexp_replace(body, r"[\s.\-()]", "")
    flag = lambda c: F.coalesce(c, F.lit(False))
    per_page = pairs.select(
        "org",
        text.host(F.col("url")).alias("host"),
        flag(F.array_contains(numbers, F.col("org"))).alias("own_number"),
        F.size(F.array_except(numbers, F.array("org"))).alias("other_numbers"),
        flag(text.contains_all(owner, name)).alias("name_owner"),
        flag(text.contains_all(hay, name)).alias("name_anywhere"),
        flag(F.size(F.array_intersect(owner, F.array(*map(F.lit, GROUP_WORDS)))) > 0).alias("groupish"),
        flag(F.array_contains(hay, F.col("postcode")) & text.contains_all(hay, text.tokens(F.col("town")))).alias("address"),
        flag(F.contains(digits, text.phone_digits(F.col("phone")))).alias("phone_hit"),
        flag(F.contains(F.lower(body), F.lower("mail"))).alias("mail_hit"),
        flag(F.lower(body).rlike(PARKED)).alias("parked"),
        F.length(body).alias("size"),
    )
    any_of = ("own_number", "name_owner", "name_anywhere", "groupish", "address", "phone_hit", "mail_hit", "parked")
    return per_page.groupBy("org", "host").agg(
        *[F.max(c).alias(c) for c in any_of], F.max("other_numbers").alias("other_numbers"), F.sum("size").alias("size"), F.count("*").alias("pages")
    )


def decide(found: DataFrame, declared: Column) -> DataFrame:
    """``decision`` (accepted, rejected, ambiguous) and ``rule`` for rows of signals; ``declared`` says that a registry names the site."""
    own, others = F.col("own_number"), F.col("other_numbers")
    contact = F.col("phone_hit") | F.col("mail_hit") | F.col("address")
    rule = (
        F.when(F.col("parked"), "parked")
        .when((others > 0) & ~own, "other number")
        .when(F.col("size") < 80, "no content")
        .when(own & (others == 0), "own number")
        .when(declared & F.col("name_owner") & ~F.col("groupish"), "declared and named")
        .when(F.col("address") & F.col("name_owner") & ~F.col("groupish"), "address and named")
        .when(declared & F.col("name_anywhere") & contact & ~F.col("groupish"), "declared with contact")
    )
    decision = F.when(rule.isin("parked", "other number", "no content"), "rejected").when(rule.isNotNull(), "accepted").otherwise("ambiguous")
    return found.withColumn("rule", rule).withColumn("decision", decision)


def candidates(sources: DataFrame) -> DataFrame:
    """One row per entity and registered domain: the source of the best priority, the first URL among equals.

    ``sources (org, url, origin, priority)``; social networks and rows without a host are no candidates.
    """
    usable = sources.withColumn("domain", text.registered_domain(F.col("url"))).where(F.col("domain").isNotNull() & text.network(F.col("url")).isNull())
    chosen = usable.groupBy("org", "domain").agg(F.min(F.struct("priority", "url", "origin")).alias("c"))
    return chosen.select("org", "domain", "c.url", "c.origin", "c.priority")
