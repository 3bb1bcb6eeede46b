"""Queries over companies: screening, reports, answers, filed figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvern.functions import identifiers, money
from kvern.operators import asking, facts, gate, ranking, screen
from kvern.operators.audit import FAMILIES
from kvern.plans import tables
from kvern.plans.tables import AMOUNTS_SQL, ENTITIES_SQL, NOW_SQL, table


def _companies(spark: SparkSession, folder: str) -> DataFrame:
    """One row per company with what screening asks for; a missing value is null."""
    now = tables.current_claims(spark, folder)
    filed = tables.amounts(now)
    last = ranking.best(filed, ["entity", "field"], [F.col("last_day").desc(), F.col("pos")])
    wide = last.groupBy("entity").agg(
        F.max(F.when(F.col("field") == "financial_revenue", F.col("amount"))).alias("revenue"),
        F.max(F.when(F.col("field") == "financial_annual_result", F.col("amount"))).alias("annual_result"),
    )
    jobs = now.where("field = 'job_posting' AND NOT coalesce(stale, false)").select(F.col("entity").alias("hirer")).distinct()
    sites = now.where("field = 'official_website' AND availability = 'available' AND NOT coalesce(stale, false)").select(F.col("entity").alias("site_of")).distinct()
    known = tables.entities(spark, folder).join(sites, F.col("organisasjonsnummer") == F.col("site_of"), "left")
    base = known.join(wide, F.col("organisasjonsnummer") == F.col("entity"), "left")
    return base.join(jobs, F.col("organisasjonsnummer") == F.col("hirer"), "left").select(
        F.col("organisasjonsnummer").alias("org"),
        F.col("navn").alias("name"),
        "municipality",
        F.col("form").alias("legal_form"),
        "industry",
        F.when(F.col("harRegistrertAntallAnsatte"), F.col("antallAnsatte")).alias("employees"),
        "revenue",
        "annual_result",
        F.col("site_of").isNotNull().alias("website"),
        F.col("revenue").isNotNull().alias("financials"),
        F.col("hirer").isNotNull().alias("hiring"),
    )


_COMPANY = f"""WITH {ENTITIES_SQL}, {NOW_SQL}, {AMOUNTS_SQL},
latest AS (SELECT * FROM amount QUALIFY row_number() OVER (PARTITION BY entity, field ORDER BY last_day DESC, pos) = 1),
wide AS (SELECT entity, max(amount) FILTER (field = 'financial_revenue') AS revenue, max(amount) FILTER (field = 'financial_annual_result') AS annual_result
  FROM latest GROUP BY entity),
jobs AS (SELECT DISTINCT entity AS hirer FROM current_claim WHERE field = 'job_posting' AND NOT coalesce(stale, false)),
sites AS (SELECT DISTINCT entity AS site_of FROM current_claim WHERE field = 'official_website' AND availability = 'available' AND NOT coalesce(stale, false)),
company AS (SELECT organisasjonsnummer AS org, navn AS name, municipality, form AS legal_form, industry,
    CASE WHEN harRegistrertAntallAnsatte THEN antallAnsatte END AS employees, revenue, annual_result, site_of IS NOT NULL AS website,
    revenue IS NOT NULL AS financials, hirer IS NOT NULL AS hiring
  FROM entity LEFT JOIN wide ON organisasjonsnummer = wide.entity LEFT JOIN sites ON organisasjonsnummer = site_of LEFT JOIN jobs ON organisasjonsnummer = hirer)
"""


def _screened(question: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        met = screen.screen(_companies(spark, folder), question)
        return met.select("org", "name", "employees", F.col("revenue").cast("string").alias("revenue"))

    return query


_SHOWN = "SELECT org, name, employees, CAST(revenue AS VARCHAR) AS revenue FROM company"
SCREENS = {
    "screen_topn_revenue": ("companies with more than 2 employees top 10 by revenue", "WHERE employees > 2 ORDER BY company.revenue DESC NULLS LAST, org LIMIT 10"),
    "screen_municipality": ("companies in røyvlsundet with at least 1 employees", "WHERE lower(municipality) = 'røyvlsundet' AND employees >= 1"),
    "screen_employees_gt": ("companies with more than 20 employees", "WHERE employees > 20"),
    "screen_revenue_lt_null_safe": ("companies with revenue below 40 million", "WHERE revenue < 40000000"),
    "screen_industry_contains": ('companies with industry contains "butikk"', "WHERE contains(lower(industry), 'butikk')"),
    "screen_legal_form_website": ("legal form AS with a website", "WHERE lower(legal_form) = 'as' AND website"),
    "screen_profitable": ("profitable companies", "WHERE annual_result > 0"),
    "screen_hiring_accounts": ("companies with filed accounts that are hiring", "WHERE financials AND hiring"),
    "screen_unsupported": ("companies with good culture", "WHERE false"),
}


def facts_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    one = tables.entities(spark, folder)
    fields = {"name": F.col("navn"), "legal_form": F.col("form"), "industry": F.col("industry_code"), "website": F.col("hjemmeside"), "phone": F.col("telefon"), "mail": F.col("epostadresse"), "employees": F.when(F.col("harRegistrertAntallAnsatte"), F.col("antallAnsatte"))}
    return facts.unpivot(one, "organisasjonsnummer", fields)


def fact_ids(spark: SparkSession, folder: str) -> DataFrame:
    return facts.with_ids(facts_unpivot(spark, folder), "identity", "organisasjonsnummer").select("id", "organisasjonsnummer", "field")


def first_wins(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").select(F.col("organisasjonsnummer").alias("id"), F.col("epostadresse").alias("value"), "retrieved_at")
    return facts.first_wins(rows, [F.col("retrieved_at").asc(), F.col("value").asc_nulls_last()]).select("id", "value", F.col("conflicts").cast("bigint").alias("conflicts"))


def org_checksum(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "9").alias("number"))
    rows = table(spark, folder, "entities").select(F.col("organisasjonsnummer").alias("number")).unionByName(customers).distinct()
    return rows.select("number", identifiers.is_org_number(F.col("number")).alias("valid"))


def whole_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("b"))
    return rows.select("c_custkey", money.whole_units(F.col("b")).alias("shown"))


def plain_amounts(spark: SparkSession, folder: str) -> DataFrame:
    filed = tables.current_claims(spark, folder).where("family = 'financials'").select("entity", "field", "key", F.get_json_object("value", "$.amount").alias("written"))
    return filed.where("written IS NOT NULL").select("entity", "field", "key", "written", money.plain_amount(F.col("written")).alias("plain"))


def latest_amount(spark: SparkSession, folder: str) -> DataFrame:
    last = ranking.best(tables.amounts(tables.current_claims(spark, folder)), ["entity", "field"], [F.col("last_day").desc(), F.col("pos")])
    return last.select("entity", "field", "last_day", F.col("amount").cast("string").alias("amount"))


def latest_period(spark: SparkSession, folder: str) -> DataFrame:
    filed = tables.amounts(tables.current_claims(spark, folder))
    return ranking.best_period(filed, ["entity", "account_type"], "first_day", "last_day")


def ratio_same_period(spark: SparkSession, folder: str) -> DataFrame:
    filed = tables.amounts(tables.current_claims(spark, folder))
    key = ["entity", "first_day", "last_day", "account_type", "currency"]
    wide = filed.groupBy(*key).agg(*[F.max(F.when(F.col("field") == f"financial_{n}", F.col("amount"))).alias(n) for n in ("revenue", "annual_result", "assets")])
    out = wide.select(*key, money.ratio_percent(F.col("annual_result"), F.col("revenue")).alias("margin"), money.ratio_percent(F.col("revenue"), F.col("assets")).alias("turnover"))
    return out.where("margin IS NOT NULL OR turnover IS NOT NULL")


def report_index(spark: SparkSession, folder: str) -> DataFrame:
    now = tables.current_claims(spark, folder).groupBy("entity").agg(F.count("*").alias("claims"), F.max(F.col("field") == "official_website").alias("verified"))
    rows = tables.entities(spark, folder).join(now, F.col("organisasjonsnummer") == F.col("entity"), "left").select(
        F.col("organisasjonsnummer").alias("org"), F.col("navn").alias("name"), F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("verified", F.lit(False)).alias("verified")
    )
    return ranking.chunked(rows, [F.col("verified").desc(), F.col("claims").desc(), F.col("name").asc(), F.col("org").asc()], 25)


def report_totals(spark: SparkSession, folder: str) -> DataFrame:
    now = tables.current_claims(spark, folder)
    return now.agg(
        F.count_distinct("entity").alias("profiles"), F.count("*").alias("claims"), F.count_if(F.col("field") == "official_website").alias("websites"),
        F.unix_seconds(F.max("last_observed_at")).alias("updated"),
    )


def compare_three(spark: SparkSession, folder: str) -> DataFrame:
    one = tables.entities(spark, folder)
    chosen = one.orderBy("organisasjonsnummer").limit(3).select("organisasjonsnummer", F.lit(1).alias("k"))  # the feature: three companies side by side
    named = chosen.withColumn("side", F.concat(F.lit("c"), F.row_number().over(_by_org())))
    long = facts_unpivot(spark, folder).join(F.broadcast(named.drop("k")), "organisasjonsnummer")
    return long.groupBy("field").pivot("side", ["c1", "c2", "c3"]).agg(F.first("value"))


def _by_org():
    return Window.partitionBy("k").orderBy("organisasjonsnummer")


def _live(spark: SparkSession, folder: str) -> DataFrame:
    now = tables.current_claims(spark, folder).where("availability = 'available'")
    return now.select("entity", "id", "family", "field", "key", "value", F.coalesce("stale", F.lit(False)).alias("stale"), "effective_at")


QUESTIONS = ("Who leads the company?", "What is its revenue and how many employees does it have?", "Tell me something", "Any glassdoor reviews?")


def ask_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Every company asked every question: the facts with what they were observed in and when."""
    now = tables.current_claims(spark, folder).where("availability = 'available'")
    live = now.select(
        "entity", "family", "id", "field", "key", "value", "scope", F.coalesce("stale", F.lit(False)).alias("stale"),
        F.array_join("evidence_ids", ",").alias("evidence"), F.unix_seconds("last_observed_at").alias("observed"),
    )
    asked = live.select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, QUESTIONS))).alias("question"))
    return asking.ask(live, asked)


def ask_gaps(spark: SparkSession, folder: str) -> DataFrame:
    live = _live(spark, folder)
    entities = live.select("entity").distinct()
    every = entities.select("entity", F.explode(F.array(*map(F.lit, FAMILIES))).alias("family"))
    there = live.select("entity", "family").distinct().withColumn("there", F.lit(True))
    state = every.join(there, ["entity", "family"], "left").select("entity", "family", F.when(F.col("there"), "available").otherwise("not_available").alias("state"))
    asked = entities.withColumn("question", F.lit(QUESTIONS[1]))
    return asking.gaps(state, asked)


def answers_standard(spark: SparkSession, folder: str) -> DataFrame:
    return asking.standard_answers(_live(spark, folder))


def summary_brief(spark: SparkSession, folder: str) -> DataFrame:
    return asking.brief(answers_standard(spark, folder))


def website_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return gate.candidates(_sources(spark, folder))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    one = tables.entities(spark, folder)
    registry = one.select(F.col("organisasjonsnummer").alias("org"), F.lower("hjemmeside").alias("url"), F.lit("registry").alias("origin"), F.lit(1).alias("priority"))
    mail = one.select(F.col("organisasjonsnummer").alias("org"), F.lower(F.regexp_extract("epostadresse", "@(.+)$", 1)).alias("url"), F.lit("mail").alias("origin"), F.lit(2).alias("priority"))
    units = table(spark, folder, "subunit_pages").select(F.explode("_embedded.underenheter").alias("u"))
    site = units.select(F.col("u.overordnetEnhet").alias("org"), F.lower("u.hjemmeside").alias("url"), F.lit("workplace").alias("origin"), F.lit(3).alias("priority"))
    return registry.unionByName(mail).unionByName(site).where("url IS NOT NULL AND url <> ''")


def gate_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Websites of entities judged by the pages of their site."""
    pages = table(spark, folder, "web_pages").select("url", "site", "title", "lines")
    wanted = website_candidates(spark, folder).where("origin <> 'mail'").select("org", F.col("domain").alias("site"))
    one = tables.entities(spark, folder).select(F.col("organisasjonsnummer").alias("org"), F.col("navn").alias("name"), "postcode", "town", F.coalesce("telefon", "mobil").alias("phone"), F.col("epostadresse").alias("mail"))
    found = gate.signals(wanted.join(one, "org").join(pages, "site"))
    return gate.decide(found, F.lit(True)).select("org", "host", "own_number", "other_numbers", "name_owner", "address", "phone_hit", "mail_hit", "rule", "decision")


QUERIES = {name: _screened(question) for name, (question, _) in SCREENS.items()} | {
    f.__name__: f
    for f in (
        facts_unpivot, fact_ids, first_wins, org_checksum, whole_units, plain_amounts, latest_amount, latest_period, ratio_same_period, report_index,
        report_totals, compare_three, ask_topics, ask_gaps, answers_standard, summary_brief, website_candidates, gate_rules,
    )
}

_FACTS = """fact AS (
  SELECT organisasjonsnummer, field, value FROM (
    SELECT organisasjonsnummer, unnest(['name', 'legal_form', 'industry', 'website', 'phone', 'mail', 'employees']) AS field,
      unnest([navn, form, industry_code, hjemmeside, telefon, epostadresse,
        CASE WHEN harRegistrertAntallAnsatte THEN CAST(antallAnsatte AS VARCHAR) END]) AS value FROM entity)
  WHERE trim(value) <> '')"""
_HOST = "regexp_replace(regexp_extract(lower({0}), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([a-z0-9.-]+)', 1), '^www[.]', '')"
_DOMAIN = "regexp_extract(h, '([^.]+[.])?[^.]+$')"
_PERIOD = "entity, first_day, last_day, account_type, currency"
_ANSWERS = f"""WITH {NOW_SQL},
live AS (SELECT * FROM current_claim WHERE availability = 'available' AND NOT coalesce(stale, false)),
wide AS (SELECT entity, json_extract_string(min(value) FILTER (field = 'business_description'), '$') AS what,
  count(*) FILTER (field = 'registered_role') AS roles, json_extract_string(min(value) FILTER (field = 'registered_address'), '$.poststed') AS place,
  count(*) FILTER (field = 'registered_workplace') AS workplaces, count(*) FILTER (field = 'job_posting') AS jobs,
  max({{'u': nullif(split_part(key, ':', 2), ''), 'a': json_extract_string(value, '$.amount')}}) FILTER (field = 'financial_revenue') AS sales,
  json_extract_string(min(value) FILTER (field = 'official_website'), '$') AS site, json_extract_string(min(value) FILTER (field = 'employees'), '$') AS staff
  FROM live GROUP BY entity),
said AS (SELECT entity, unnest([1, 2, 3, 4, 5, 6, 7]) AS ordinal,
  unnest(['What does the company do?', 'Who leads the company?', 'Where does it operate?', 'What are its latest filed numbers?', 'Is it hiring?',
    'Does it have a verified website?', 'How many people does it employ?']) AS question,
  unnest([what, CASE WHEN roles > 0 THEN roles || ' registered roles' END, place || ', ' || workplaces || ' workplaces',
    'revenue ' || replace(format('{{:,}}', CAST(round(TRY_CAST(sales.a AS DECIMAL(38,6)), 0) AS BIGINT)), ',', ' '),
    CASE WHEN jobs > 0 THEN jobs || ' open ads' END, site, staff]) AS answer FROM wide)
"""

ORACLES = {name: f"{_COMPANY} {_SHOWN} {where}" for name, (_, where) in SCREENS.items()} | {
    "facts_unpivot": f"WITH {ENTITIES_SQL}, {_FACTS} SELECT * FROM fact",
    "fact_ids": f"""WITH {ENTITIES_SQL}, {_FACTS} SELECT 'cl_' || substr(sha256('["claim-v1","' || organisasjonsnummer || '","identity","' || field || '"]'), 1, 24) AS id,
      organisasjonsnummer, field FROM fact""",
    "first_wins": """SELECT id, value, conflicts FROM (SELECT organisasjonsnummer AS id, epostadresse AS value,
      row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY retrieved_at, epostadresse NULLS LAST) AS r FROM entities) JOIN (
      SELECT organisasjonsnummer AS id, greatest(count(DISTINCT epostadresse) - 1, 0) AS conflicts FROM entities GROUP BY 1) USING (id) WHERE r = 1""",
    "org_checksum": """WITH n AS (SELECT organisasjonsnummer AS number FROM entities UNION SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '9') FROM customer),
      s AS (SELECT number, (11 - list_sum(list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda i: CAST(substr(number, i, 1) AS INT) * [3, 2, 7, 6, 5, 4, 3, 2][i])) % 11) % 11 AS r FROM n)
      SELECT number, r <> 10 AND r = CAST(substr(number, 9, 1) AS INT) AS valid FROM s""",
    "whole_units": """SELECT c_custkey, replace(format('{:,}', CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 0) AS BIGINT)), ',', ' ') AS shown FROM customer""",
    "plain_amounts": f"""WITH {NOW_SQL}, w AS (SELECT entity, field, key, json_extract_string(value, '$.amount') AS written FROM current_claim WHERE family = 'financials')
      SELECT entity, field, key, written, CASE WHEN TRY_CAST(written AS DECIMAL(38,6)) = 0 THEN '0' WHEN TRY_CAST(written AS DECIMAL(38,6)) IS NULL THEN written
        WHEN contains(written, '.') THEN regexp_replace(regexp_replace(written, '0+$', ''), '[.]$', '') ELSE written END AS plain FROM w WHERE written IS NOT NULL""",
    "latest_amount": f"""WITH {NOW_SQL}, {AMOUNTS_SQL} SELECT entity, field, last_day, CAST(amount AS VARCHAR) AS amount FROM amount
      QUALIFY row_number() OVER (PARTITION BY entity, field ORDER BY last_day DESC, pos) = 1""",
    "latest_period": f"""WITH {NOW_SQL}, {AMOUNTS_SQL} SELECT entity, account_type, first_day, last_day, count(*) AS figures FROM amount GROUP BY entity, account_type, first_day, last_day
      QUALIFY row_number() OVER (PARTITION BY entity, account_type ORDER BY last_day DESC, count(*) DESC, first_day) = 1""",
    "ratio_same_period": f"""WITH {NOW_SQL}, {AMOUNTS_SQL}, w AS (SELECT {_PERIOD}, max(amount) FILTER (field = 'financial_revenue') AS r,
      max(amount) FILTER (field = 'financial_annual_result') AS n, max(amount) FILTER (field = 'financial_assets') AS a FROM amount GROUP BY ALL),
      x AS (SELECT {_PERIOD}, CASE WHEN r > 0 THEN round_even(100 * CAST(n AS DOUBLE) / CAST(r AS DOUBLE), 1) END AS margin,
        CASE WHEN a > 0 THEN round_even(100 * CAST(r AS DOUBLE) / CAST(a AS DOUBLE), 1) END AS turnover FROM w)
      SELECT * FROM x WHERE margin IS NOT NULL OR turnover IS NOT NULL""",
    "report_index": f"""WITH {ENTITIES_SQL}, {NOW_SQL}, n AS (SELECT entity, count(*) AS claims, bool_or(field = 'official_website') AS verified FROM current_claim GROUP BY 1),
      r AS (SELECT organisasjonsnummer AS org, navn AS name, coalesce(claims, 0) AS claims, coalesce(verified, false) AS verified FROM entity LEFT JOIN n ON organisasjonsnummer = n.entity)
      SELECT *, CAST((row_number() OVER (ORDER BY verified DESC, claims DESC, name, org) - 1) // 25 AS BIGINT) AS chunk FROM r""",
    "report_totals": f"""WITH {NOW_SQL} SELECT count(DISTINCT entity) AS profiles, count(*) AS claims, count(*) FILTER (field = 'official_website') AS websites,
      CAST(floor(epoch(max(last_observed_at))) AS BIGINT) AS updated FROM current_claim""",
    "compare_three": f"""WITH {ENTITIES_SQL}, {_FACTS}, s AS (SELECT organisasjonsnummer, row_number() OVER (ORDER BY organisasjonsnummer) AS k FROM entity ORDER BY organisasjonsnummer LIMIT 3)
      SELECT field, max(value) FILTER (k = 1) AS c1, max(value) FILTER (k = 2) AS c2, max(value) FILTER (k = 3) AS c3 FROM fact JOIN s USING (organisasjonsnummer) GROUP BY field""",
    "ask_topics": f"""WITH {NOW_SQL}, live AS (SELECT * FROM current_claim WHERE availability = 'available'),
      w AS (SELECT unnest([{{'q': '{QUESTIONS[0]}', 'f': ['leadership']}}, {{'q': '{QUESTIONS[1]}', 'f': ['financials', 'filing_history', 'identity', 'description', 'workforce']}},
        {{'q': '{QUESTIONS[2]}', 'f': ['identity', 'financials', 'leadership', 'locations', 'filing_history', 'website', 'description', 'contact', 'social_profiles', 'hiring', 'activity', 'workforce']}}]) AS x)
      SELECT x.q AS question, entity, family, id, field, key, value, scope, coalesce(stale, false) AS stale, array_to_string(evidence_ids, ',') AS evidence,
        CAST(floor(epoch(last_observed_at)) AS BIGINT) AS observed FROM w JOIN live ON list_contains(x.f, family)""",
    "ask_gaps": f"""WITH {NOW_SQL}, live AS (SELECT DISTINCT entity, family FROM current_claim WHERE availability = 'available'),
      w AS (SELECT entity, unnest(['financials', 'filing_history', 'identity', 'description', 'workforce']) AS family FROM (SELECT DISTINCT entity FROM live))
      SELECT '{QUESTIONS[1]}' AS question, entity, family, 'not_available' AS state FROM w WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.entity = w.entity AND l.family = w.family)""",
    "answers_standard": _ANSWERS + "SELECT entity, ordinal, question, answer IS NOT NULL AS answerable, coalesce(answer, 'unknown') AS answer FROM said",
    "summary_brief": _ANSWERS + "SELECT entity, string_agg(answer, '. ' ORDER BY ordinal) AS brief FROM said WHERE answer IS NOT NULL GROUP BY entity",
    "website_candidates": f"""WITH {ENTITIES_SQL}, u AS (SELECT unnest(_embedded.underenheter) AS u FROM subunit_pages),
      s AS (SELECT organisasjonsnummer AS org, lower(hjemmeside) AS url, 'registry' AS origin, 1 AS priority FROM entity
        UNION ALL SELECT organisasjonsnummer, lower(regexp_extract(epostadresse, '@(.+)$', 1)), 'mail', 2 FROM entity
        UNION ALL SELECT u.overordnetEnhet, lower(u.hjemmeside), 'workplace', 3 FROM u),
      d AS (SELECT *, {_HOST.format("url")} AS h FROM s WHERE url <> '')
      SELECT org, {_DOMAIN} AS domain, url, origin, priority FROM d WHERE h <> '' QUALIFY row_number() OVER (PARTITION BY org, {_DOMAIN} ORDER BY priority, url, origin) = 1""",
}
