"""Queries over names, numbers, handles and stored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.functions import identifiers, text
from kvern.operators import ranking
from kvern.plans import companies
from kvern.plans.tables import table
from kvern.session import Stage
from kvern.sources import bundle, sinks


def core_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").select("organisasjonsnummer", "navn").distinct()
    return rows.select("organisasjonsnummer", "navn", text.core_name(F.col("navn")).alias("core"))


def labelled_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers that a page's lines call its organisation number."""
    lines = table(spark, folder, "web_pages").select("page_id", F.explode("lines").alias("line"))
    return lines.select("page_id", F.explode(identifiers.labelled_numbers(F.col("line"))).alias("number")).distinct()


def handles_of_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Mail names taken as handles: whether they hold the company's name or its domain's label."""
    rows = table(spark, folder, "entities").where("epostadresse IS NOT NULL AND navn IS NOT NULL").select("organisasjonsnummer", "navn", "epostadresse", "hjemmeside").distinct()
    handle = F.regexp_extract("epostadresse", "^([^@]*)", 1)
    return rows.select("organisasjonsnummer", "epostadresse", "navn", text.handle_of_company(handle, F.col("navn"), F.lit(None).cast("string")).alias("own"))


def ads_of_employers(spark: SparkSession, folder: str) -> DataFrame:
    """Up to twelve different titles of each employer, the newest first: the limit is the feature."""
    ads = table(spark, folder, "job_entries").select(F.col("ad_content.employer.name").alias("employer"), F.col("ad_content.title").alias("title"), F.col("ad_content.published").alias("published"))
    once = ads.where("employer IS NOT NULL AND title IS NOT NULL").groupBy("employer", "title").agg(F.max("published").alias("published"))
    return ranking.top(once, ["employer"], [F.col("published").desc_nulls_last(), F.col("title").asc()], 12).select("employer", "title", "place")


def candidates_first_five(spark: SparkSession, folder: str) -> DataFrame:
    """Each company's first five website candidates by where they come from, with their rank: the limit is the feature."""
    return ranking.top(companies.website_candidates(spark, folder), ["org"], [F.col("priority").asc(), F.col("domain").asc()], 5).select("org", "domain", "priority", "place")


def previous_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes written as gzipped JSON lines and read as an earlier run: the last one of each organisation."""
    rows = table(spark, folder, "envelopes").select("organisation_number", F.col("run.run_id").alias("run_id"), F.unix_micros("received_at").alias("received"), "state")
    at = Stage(spark, "envelopes").path("lines")
    sinks.write_lines(rows, at, compress=True)
    last = bundle.read_previous(spark, at, "organisation_number string, run_id string, received bigint, state string", "organisation_number", "received")
    return last.select("organisation_number", "received")


QUERIES = {f.__name__: f for f in (core_names, labelled_numbers, handles_of_companies, ads_of_employers, candidates_first_five, previous_envelopes)}

_FORMS = "as|asa|ans|da|sa|enk|nuf|ba|ks|sf|iks"
_BARE = "regexp_replace(m, '[ .]', '', 'g')"
_SUM = f"list_sum(list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda i: CAST(substr(n, i, 1) AS INT) * [3, 2, 7, 6, 5, 4, 3, 2][i]))"
ORACLES = {
    "core_names": f"""WITH w AS (SELECT DISTINCT organisasjonsnummer, navn, string_split(lower(trim(regexp_replace(navn, '[^\\pL\\pN_]+', ' ', 'g'))), ' ') AS w FROM entities),
      k AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: NOT regexp_full_match(w[i], '{_FORMS}')) AS kept FROM w)
      SELECT organisasjonsnummer, navn, CASE WHEN navn IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(w[list_min(kept):list_max(kept)], ' ') END AS core FROM k""",
    "labelled_numbers": f"""WITH l AS (SELECT page_id, unnest(lines) AS line FROM web_pages),
      f AS (SELECT page_id, unnest(regexp_extract_all(line, '(?:Org[.] ?nr[.]?|Reg[.] no[.]?|organisasjonsnummer|foretaksnummer|MVA|VAT|organi[sz]ation (?:number|no[.]?))\\s*[:#-]?\\s*(?:NO\\s*)?([0-9]{{3}}[ .]?[0-9]{{3}}[ .]?[0-9]{{3}})', 1, 'i')) AS m FROM l),
      b AS (SELECT DISTINCT page_id, {_BARE} AS n FROM f), c AS (SELECT *, (11 - {_SUM} % 11) % 11 AS r FROM b)
      SELECT page_id, n AS number FROM c WHERE r <> 10 AND r = CAST(substr(n, 9, 1) AS INT)""",
    "ads_of_employers": """WITH o AS (SELECT ad_content.employer.name AS employer, ad_content.title AS title, max(ad_content.published) AS published FROM job_entries
      WHERE ad_content.employer.name IS NOT NULL AND ad_content.title IS NOT NULL GROUP BY 1, 2),
      p AS (SELECT employer, title, CAST(row_number() OVER (PARTITION BY employer ORDER BY published DESC NULLS LAST, title) AS INT) AS place FROM o) SELECT * FROM p WHERE place <= 12""",
    "candidates_first_five": f"""WITH c AS ({companies.ORACLES["website_candidates"]}),
      p AS (SELECT org, domain, priority, CAST(row_number() OVER (PARTITION BY org ORDER BY priority, domain) AS INT) AS place FROM c) SELECT * FROM p WHERE place <= 5""",
    "previous_envelopes": "SELECT organisation_number, CAST(max(epoch_us(received_at)) AS BIGINT) AS received FROM envelopes WHERE organisation_number IS NOT NULL GROUP BY 1",
}
