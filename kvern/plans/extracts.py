"""Queries over what is taken out of records and pages: roles, workplaces, accounts, links, quotes, and counts of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvern.functions import dates, identifiers, spans, text
from kvern.functions.canonical import value_digests
from kvern.operators import gate, ranking, shredding
from kvern.plans import companies, tables
from kvern.plans import tables
from kvern.plans.tables import CLAIMS_SQL, ENTITIES_SQL, NOW_SQL, table


def active_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Roles that are neither deregistered nor held by a deceased person, with the holder's name."""
    leaves = {"code": "type.kode", "gone": "avregistrert", "dead": "person.erDoed", "given": "person.navn.fornavn", "middle": "person.navn.mellomnavn", "last": "person.navn.etternavn", "unit": "enhet.organisasjonsnummer"}
    rows = shredding.shred_table(table(spark, folder, "role_records"), "record_id", "body", "rollegrupper*.roller*", leaves, ["group_pos", "item_pos"], as_json=True)
    live = rows.where("coalesce(gone, 'false') <> 'true' AND coalesce(dead, 'false') <> 'true'")
    name = F.nullif(F.concat_ws(" ", "given", "middle", "last"), F.lit(""))
    return live.select("record_id", "group_pos", "item_pos", "code", F.coalesce(name, "unit").alias("holder"))


def workplace_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the last answer for an entity holds all its workplaces."""
    rows = table(spark, folder, "subunit_pages").select("requested_org", "retrieved_at", "record_id", F.greatest(F.size("_embedded.underenheter"), F.lit(0)).alias("n"), F.col("page.totalElements").alias("total"), F.col("page.totalPages").alias("pages"))
    last = ranking.latest(rows, ["requested_org"], ["retrieved_at", "record_id"])
    return last.select("requested_org", "n", F.coalesce((F.col("pages") <= 1) & (F.col("n") == F.col("total")), F.lit(False)).alias("complete"))


def wrong_parent(spark: SparkSession, folder: str) -> DataFrame:
    """Workplaces in an answer for another entity than their parent."""
    rows = table(spark, folder, "subunit_pages").select("record_id", "requested_org", F.explode("_embedded.underenheter").alias("u"))
    return rows.select("record_id", F.col("u.organisasjonsnummer").alias("org"), F.coalesce(F.col("u.overordnetEnhet") != F.col("requested_org"), F.lit(True)).alias("wrong")).groupBy("wrong").agg(F.count("*").alias("n"))


def workforce_state(spark: SparkSession, folder: str) -> DataFrame:
    """The number of employees where it is registered; that none is registered is a state and no zero."""
    has = F.col("harRegistrertAntallAnsatte")
    state = F.when(has & F.col("antallAnsatte").isNotNull(), "available").when(has == F.lit(False), "not_available").otherwise("unknown")
    return tables.entities(spark, folder).select("organisasjonsnummer", F.when(has, F.col("antallAnsatte")).alias("employees"), state.alias("state"))


def accounts_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Why filed figures can't be used, counted."""
    parts = F.split("key", ":")
    first, last = F.try_to_date(parts[0], "yyyy-MM-dd"), F.try_to_date(F.get(parts, F.lit(1)), "yyyy-MM-dd")
    amount = F.get_json_object("value", "$.amount").try_cast("decimal(38,6)")
    why = (
        F.when(first.isNull() | last.isNull() | (first > last), "period").when(amount.isNull(), "amount")
        .when(~F.coalesce(F.get_json_object("value", "$.currency").rlike("^[A-Z]{3}$"), F.lit(False)), "currency").otherwise("valid")
    )
    return tables.current_claims(spark, folder).where("family = 'financials'").groupBy("field", why.alias("verdict")).agg(F.count("*").alias("n"))


def envelope_states(spark: SparkSession, folder: str) -> DataFrame:
    """A run's state for an entity by what it holds."""
    rows = table(spark, folder, "envelopes").where("run.run_id IS NOT NULL")
    live = F.exists("claims", lambda c: (c["availability"] == "available") & ~F.coalesce(c["stale"], F.lit(False)))
    state = F.when(F.col("state") == "failed", "failed").when(F.coalesce(live, F.lit(False)), "available").otherwise("not_available")
    return rows.groupBy(F.col("run.run_id").alias("run_id"), state.alias("held")).agg(F.count("*").alias("n"))


def viewer_list(spark: SparkSession, folder: str) -> DataFrame:
    one = tables.entities(spark, folder)
    hay = F.lower(F.concat_ws(" ", "navn", "organisasjonsnummer", "town", "industry"))
    return one.where(F.contains(hay, F.lit("bygg"))).select("organisasjonsnummer", "navn")


def safe_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Sites as registered, by whether they may be fetched: http(s), a usual port, no credentials, no local host."""
    sites = tables.entities(spark, folder).select(F.lower("hjemmeside").alias("site")).where("site IS NOT NULL")
    odd = spark.createDataFrame([(u,) for u in ("ftp://a.example", "http://u:p@a.example", "http://localhost/x", "http://10.0.0.1/", "http://a.example:8080/", "https://a.example:443/x")], "site string")
    every = sites.unionByName(odd).distinct()
    url = F.when(F.col("site").rlike("^[a-z]+://"), F.col("site")).otherwise(F.concat(F.lit("https://"), "site"))
    ok = url.rlike(r"^https?://[a-z0-9æøå.\-]+\.[a-zæøå]{2,}(:(80|443))?(/|$|\?)") & ~url.rlike(r"^https?://(localhost|127\.|10\.|192\.168\.|[^/]*\.local(/|$))")
    return every.select("site", ok.alias("safe"))


def other_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Organisation numbers that a page names beside the first one."""
    rows = table(spark, folder, "web_pages").select("site", F.explode(identifiers.org_mentions(F.array_join("lines", "\n"))).alias("org")).distinct()
    return rows.groupBy("site").agg(F.count("*").alias("numbers"), F.min("org").alias("first"))


def homepages_by_firm(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "subunit_pages").select(F.explode("_embedded.underenheter").alias("u"))
    rows = units.select(F.col("u.overordnetEnhet").alias("org"), text.host(F.col("u.hjemmeside")).alias("host")).where("host IS NOT NULL")
    return rows.groupBy("org").agg(F.array_join(F.array_sort(F.collect_set("host")), ",").alias("hosts"))


def required_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """How many pieces of evidence the claims of each run need, and how many the run before needed too."""
    rows = tables.claims(spark, folder).select("run_no", F.explode("evidence_ids").alias("e")).distinct()
    before = rows.select((F.col("run_no") + 1).alias("run_no"), "e", F.lit(1).alias("again"))
    return rows.join(before, ["run_no", "e"], "left").groupBy("run_no").agg(F.count("*").alias("needed"), F.count("again").alias("kept"))


def known_filing_years(spark: SparkSession, folder: str) -> DataFrame:
    years = tables.claims(spark, folder).where("field = 'filing_years'").select("entity", F.explode(F.regexp_extract_all("value", F.lit('"([0-9]{4})"'), F.lit(1))).alias("y"))
    return years.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("y")), ",").alias("years"))


def places_staff_board(spark: SparkSession, folder: str) -> DataFrame:
    now = tables.current_claims(spark, folder)
    staff = F.get_json_object("value", "$.employees").try_cast("bigint")
    return now.groupBy("entity").agg(
        F.count_distinct(F.when(F.col("field") == "registered_workplace", F.get_json_object("value", "$.name"))).alias("names"),
        F.sum(F.when(F.col("field") == "registered_workplace", F.coalesce(staff, F.lit(0)))).alias("staff"),
        F.count_if(F.col("field") == "registered_role").alias("board"),
        F.max(F.when(F.col("field") == "registered_role", F.col("effective_at"))).alias("since"),
    )


def user_cost(spark: SparkSession, folder: str) -> DataFrame:
    value = F.col("value").cast("decimal(18,6)")
    return table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("requests"), F.round(F.sum(value), 6).cast("string").alias("cost"))


def value_before(spark: SparkSession, folder: str) -> DataFrame:
    """How often a claim's value, however spelled, differs from its last one, by field; a missing value is JSON null."""
    rows = tables.claims(spark, folder).select("entity", "id", "run_no", "field", value_digests(F.array("value"))[0].alias("digest"))
    lag = F.lag("digest").over(Window.partitionBy("entity", "id").orderBy("run_no"))
    return rows.withColumn("before", lag).groupBy("field").agg(F.count_if(F.col("before") != F.col("digest")).alias("changed"), F.count("before").alias("seen_before"))


def guessed_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domains a firm of a name may have: its words together, with hyphens, and the first alone."""
    rows = table(spark, folder, "entities").select("organisasjonsnummer", "navn").distinct()
    words = text.name_tokens(F.col("navn"))
    made = F.array_distinct(F.array(F.array_join(words, ""), F.array_join(words, "-"), words[0]))
    return rows.select("organisasjonsnummer", F.explode(F.transform(made, lambda d: F.concat(d, F.lit(".no")))).alias("domain")).distinct()


def json_quotes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "role_records").select("record_id", spans.quoted("/rollegrupper/0/type/kode")("body").alias("quote"))
    return rows.where("quote IS NOT NULL")


def decoded_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written in Latin-1 and read by their declared charset; texts it can't hold are left out."""
    rows = table(spark, folder, "entities").select("organisasjonsnummer", "navn").distinct()
    whole = rows.where(F.col("navn").rlike(r"^[\x00-\xFF]*$"))
    return whole.select("organisasjonsnummer", F.decode(F.encode("navn", "ISO-8859-1"), "ISO-8859-1").alias("name"))


OBSERVED = {"official_website": ("company_site", "company_profile"), "business_description": ("company_site", "company_profile"), "job_posting": ("job_board", "job_posting"), "employees": ("registry", "workforce_snapshot")}


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Claims as observations of platforms; claims of other fields are none."""
    lookup = F.create_map(*[x for f, (p, s) in OBSERVED.items() for x in (F.lit(f), F.struct(F.lit(p).alias("platform"), F.lit(s).alias("signal")))])
    now = tables.current_claims(spark, folder).where(F.col("field").isin(*OBSERVED))
    return now.withColumn("o", F.try_element_at(lookup, F.col("field"))).select("entity", "id", "o.platform", "o.signal")


def regated(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions with and without the register's word, counted side by side."""
    found = companies.gate_rules(spark, folder).drop("rule", "decision")
    full = found.withColumn("groupish", F.lit(False)).withColumn("name_anywhere", F.col("name_owner")).withColumn("mail_hit", F.lit(False)).withColumn("parked", F.lit(False)).withColumn("size", F.lit(1000))
    with_, without = (gate.decide(full, F.lit(d)).select("org", "host", F.col("decision").alias(n)) for d, n in ((True, "declared"), (False, "undeclared")))
    return with_.join(without, ["org", "host"]).groupBy("declared", "undeclared").agg(F.count("*").alias("n"))


def run_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row on the last run."""
    now = tables.current_claims(spark, folder)
    return now.agg(F.count_distinct("entity").alias("companies"), F.count("*").alias("claims"), F.count_if(F.coalesce("stale", F.lit(False))).alias("stale"), F.count_distinct("family").alias("families"))


def dated_links(spark: SparkSession, folder: str) -> DataFrame:
    """Teasers with a date: their titles and days, the ten newest of each site."""
    lines = table(spark, folder, "web_pages").select("site", F.explode("lines").alias("line"))
    dated = lines.select("site", F.regexp_extract("line", r"^(.+) \([0-9.]+\)\s*$", 1).alias("title"), dates.first_date(F.regexp_extract("line", r"\(([0-9.]+)\)\s*$", 1)).cast("string").alias("day"))
    unique = dated.where("title <> '' AND day IS NOT NULL").distinct()
    return ranking.top(unique, ["site"], [F.col("day").desc(), F.col("title")], 10).select("site", "title", "day", "place")


def site_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """A page's description: the declared one of 35 characters or more, else its first paragraph of a fitting length."""
    rows = table(spark, folder, "web_pages").select("page_id", "description", "lines")
    fit = F.filter("lines", lambda x: F.length(x).between(80, 900) & ~F.lower(x).rlike("cookie|informasjonskaps|samtykke|©") & (F.size(F.split(F.trim(x), r"\s+")) >= 12))
    declared = F.when(F.length("description") >= 35, F.col("description"))
    return rows.select("page_id", F.coalesce(declared, F.get(fit, F.lit(0))).alias("about")).where("about IS NOT NULL")


QUERIES = {
    f.__name__: f
    for f in (
        active_roles, workplace_completeness, wrong_parent, workforce_state, accounts_valid, envelope_states, viewer_list, safe_urls, other_numbers,
        homepages_by_firm, required_evidence, known_filing_years, places_staff_board, user_cost, value_before, guessed_domains, json_quotes,
        decoded_bodies, observations, regated, run_report, dated_links, site_descriptions,
    )
}

_WORDS = "regexp_extract_all(replace(strip_accents(translate(lower(navn), 'øå', 'oa')), 'æ', 'ae'), '[a-z0-9]+')"
_KEPT = f"list_filter({_WORDS}, lambda t: NOT list_contains({tables.KINDS_SQL}, t))"
_U = "SELECT record_id, requested_org, unnest(_embedded.underenheter) AS u FROM subunit_pages"
ORACLES = {
    "active_roles": """WITH bodies AS (SELECT record_id, CAST(body AS JSON) AS doc FROM role_records WHERE json_valid(body)),
      ol AS (SELECT record_id, CASE json_type(doc, '$.rollegrupper') WHEN 'ARRAY' THEN CAST(doc->'$.rollegrupper' AS JSON[]) WHEN 'OBJECT' THEN [doc->'$.rollegrupper'] END AS gs FROM bodies),
      g AS (SELECT record_id, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS group_pos FROM ol),
      il AS (SELECT record_id, group_pos, CASE json_type(g, '$.roller') WHEN 'ARRAY' THEN CAST(g->'$.roller' AS JSON[]) WHEN 'OBJECT' THEN [g->'$.roller'] END AS rs FROM g),
      r AS (SELECT record_id, group_pos, unnest(rs) AS r, generate_subscripts(rs, 1) - 1 AS item_pos FROM il)
      SELECT record_id, CAST(group_pos AS BIGINT) AS group_pos, CAST(item_pos AS BIGINT) AS item_pos, r->>'$.type.kode' AS code,
        coalesce(nullif(concat_ws(' ', r->>'$.person.navn.fornavn', r->>'$.person.navn.mellomnavn', r->>'$.person.navn.etternavn'), ''), r->>'$.enhet.organisasjonsnummer') AS holder
      FROM r WHERE coalesce(r->>'$.avregistrert', 'false') <> 'true' AND coalesce(r->>'$.person.erDoed', 'false') <> 'true'""",
    "workplace_completeness": """SELECT requested_org, CAST(coalesce(len(_embedded.underenheter), 0) AS INT) AS n,
      coalesce(page.totalPages <= 1 AND coalesce(len(_embedded.underenheter), 0) = page.totalElements, false) AS complete
      FROM subunit_pages QUALIFY row_number() OVER (PARTITION BY requested_org ORDER BY retrieved_at DESC, record_id DESC) = 1""",
    "wrong_parent": f"WITH x AS ({_U}) SELECT coalesce(u.overordnetEnhet <> requested_org, true) AS wrong, count(*) AS n FROM x GROUP BY 1",
    "workforce_state": f"""WITH {ENTITIES_SQL} SELECT organisasjonsnummer, CASE WHEN harRegistrertAntallAnsatte THEN antallAnsatte END AS employees,
      CASE WHEN harRegistrertAntallAnsatte AND antallAnsatte IS NOT NULL THEN 'available' WHEN harRegistrertAntallAnsatte = false THEN 'not_available' ELSE 'unknown' END AS state FROM entity""",
    "accounts_valid": f"""WITH {NOW_SQL}, f AS (SELECT field, try_strptime(split_part(key, ':', 1), '%Y-%m-%d') AS a, try_strptime(split_part(key, ':', 2), '%Y-%m-%d') AS b,
        TRY_CAST(json_extract_string(value, '$.amount') AS DECIMAL(38,6)) AS m, json_extract_string(value, '$.currency') AS c FROM current_claim WHERE family = 'financials')
      SELECT field, CASE WHEN a IS NULL OR b IS NULL OR a > b THEN 'period' WHEN m IS NULL THEN 'amount' WHEN NOT coalesce(regexp_matches(c, '^[A-Z]{{3}}$'), false) THEN 'currency' ELSE 'valid' END AS verdict, count(*) AS n
      FROM f GROUP BY ALL""",
    "envelope_states": """SELECT run.run_id AS run_id, CASE WHEN state = 'failed' THEN 'failed' WHEN len(list_filter(claims, lambda c: c.availability = 'available' AND NOT coalesce(c.stale, false))) > 0 THEN 'available'
      ELSE 'not_available' END AS held, count(*) AS n FROM envelopes WHERE run.run_id IS NOT NULL GROUP BY ALL""",
    "viewer_list": f"WITH {ENTITIES_SQL} SELECT organisasjonsnummer, navn FROM entity WHERE contains(lower(concat_ws(' ', navn, organisasjonsnummer, town, industry)), 'bygg')",
    "safe_urls": f"""WITH {ENTITIES_SQL}, s AS (SELECT lower(hjemmeside) AS site FROM entity WHERE hjemmeside IS NOT NULL
        UNION SELECT unnest(['ftp://a.example', 'http://u:p@a.example', 'http://localhost/x', 'http://10.0.0.1/', 'http://a.example:8080/', 'https://a.example:443/x'])),
      f AS (SELECT site, CASE WHEN regexp_matches(site, '^[a-z]+://') THEN site ELSE 'https://' || site END AS url FROM s)
      SELECT site, regexp_matches(url, '^https?://[a-z0-9æøå.-]+[.][a-zæøå]{{2,}}(:(80|443))?(/|$|[?])') AND NOT regexp_matches(url, '^https?://(localhost|127[.]|10[.]|192[.]168[.]|[^/]*[.]local(/|$))') AS safe FROM f""",
    "other_numbers": """WITH l AS (SELECT site, unnest(regexp_extract_all(array_to_string(lines, chr(10)), '(?:^|[^0-9])([0-9]{3}[ .]?[0-9]{3}[ .]?[0-9]{3})(?:$|[^0-9])', 1)) AS m FROM web_pages),
      n AS (SELECT DISTINCT site, regexp_replace(m, '[ .]', '', 'g') AS org FROM l),
      s AS (SELECT *, (11 - list_sum(list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda i: CAST(substr(org, i, 1) AS INT) * [3, 2, 7, 6, 5, 4, 3, 2][i])) % 11) % 11 AS r FROM n)
      SELECT site, count(*) AS numbers, min(org) AS first FROM s WHERE r <> 10 AND r = CAST(substr(org, 9, 1) AS INT) GROUP BY site""",
    "homepages_by_firm": f"""WITH x AS ({_U}), h AS (SELECT DISTINCT u.overordnetEnhet AS org,
        regexp_replace(regexp_extract(lower(u.hjemmeside), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([a-z0-9.-]+)', 1), '^www[.]', '') AS host FROM x WHERE u.hjemmeside IS NOT NULL)
      SELECT org, string_agg(host, ',' ORDER BY host) AS hosts FROM h WHERE host <> '' GROUP BY org""",
    "required_evidence": f"""WITH {CLAIMS_SQL}, e AS (SELECT DISTINCT run_no, unnest(evidence_ids) AS e FROM claim)
      SELECT CAST(a.run_no AS INT) AS run_no, count(*) AS needed, count(b.e) AS kept FROM e a LEFT JOIN e b ON b.run_no = a.run_no - 1 AND b.e = a.e GROUP BY 1""",
    "known_filing_years": f"""WITH {CLAIMS_SQL}, y AS (SELECT DISTINCT entity, unnest(regexp_extract_all(value, '"([0-9]{{4}})"', 1)) AS y FROM claim WHERE field = 'filing_years')
      SELECT entity, string_agg(y, ',' ORDER BY y) AS years FROM y GROUP BY entity""",
    "places_staff_board": f"""WITH {NOW_SQL} SELECT entity, count(DISTINCT json_extract_string(value, '$.name')) FILTER (field = 'registered_workplace') AS names,
      CAST(sum(coalesce(TRY_CAST(json_extract_string(value, '$.employees') AS BIGINT), 0)) FILTER (field = 'registered_workplace') AS BIGINT) AS staff,
      count(*) FILTER (field = 'registered_role') AS board, max(effective_at) FILTER (field = 'registered_role') AS since FROM current_claim GROUP BY entity""",
    "user_cost": "SELECT user_id, count(*) AS requests, CAST(round(sum(CAST(value AS DECIMAL(18,6))), 6) AS VARCHAR) AS cost FROM events GROUP BY user_id",
    "value_before": f"""WITH {CLAIMS_SQL}, d AS (SELECT *, {tables.value_sql("value")} AS same_as FROM claim),
      l AS (SELECT field, same_as, lag(same_as) OVER (PARTITION BY entity, id ORDER BY run_no) AS before FROM d)
      SELECT field, count(*) FILTER (before <> same_as) AS changed, count(before) AS seen_before FROM l GROUP BY field""",
    "guessed_domains": f"""WITH n AS (SELECT DISTINCT organisasjonsnummer, CASE WHEN len({_KEPT}) > 0 THEN {_KEPT} ELSE {_WORDS} END AS w FROM entities)
      SELECT DISTINCT organisasjonsnummer, unnest([array_to_string(w, ''), array_to_string(w, '-'), w[1]]) || '.no' AS domain FROM n""",
    "json_quotes": """SELECT record_id, '"kode": ' || CAST(json_extract(body, '$.rollegrupper[0].type.kode') AS VARCHAR) AS quote FROM role_records
      WHERE json_valid(body) AND json_type(body, '$.rollegrupper') = 'ARRAY' AND json_exists(body, '$.rollegrupper[0].type.kode')""",
    "decoded_bodies": "SELECT DISTINCT organisasjonsnummer, navn AS name FROM entities",
    "observations": f"""WITH {NOW_SQL} SELECT entity, id, CASE field WHEN 'job_posting' THEN 'job_board' WHEN 'employees' THEN 'registry' ELSE 'company_site' END AS platform,
      CASE field WHEN 'job_posting' THEN 'job_posting' WHEN 'employees' THEN 'workforce_snapshot' ELSE 'company_profile' END AS signal FROM current_claim WHERE field IN {tuple(OBSERVED)}""",
    "run_report": f"WITH {NOW_SQL} SELECT count(DISTINCT entity) AS companies, count(*) AS claims, count(*) FILTER (coalesce(stale, false)) AS stale, count(DISTINCT family) AS families FROM current_claim",
    "dated_links": """WITH l AS (SELECT site, unnest(lines) AS line FROM web_pages), d AS (SELECT DISTINCT site, regexp_extract(line, '^(.+) \\([0-9.]+\\)\\s*$', 1) AS title,
        strftime(try_strptime(regexp_extract(line, '\\(([0-9.]+)\\)\\s*$', 1), '%d.%m.%Y'), '%Y-%m-%d') AS day FROM l)
      SELECT site, title, day, CAST(row_number() OVER (PARTITION BY site ORDER BY day DESC, title) AS INT) AS place FROM d WHERE title <> '' AND day >= '1990' QUALIFY row_number() OVER (PARTITION BY site ORDER BY day DESC, title) <= 10""",
    "site_descriptions": """WITH p AS (SELECT page_id, CASE WHEN length(description) >= 35 THEN description END AS d, list_filter(lines, lambda x: length(x) BETWEEN 80 AND 900
        AND NOT regexp_matches(lower(x), 'cookie|informasjonskaps|samtykke|©') AND len(regexp_split_to_array(trim(x), '\\s+')) >= 12) AS fit FROM web_pages)
      SELECT page_id, coalesce(d, fit[1]) AS about FROM p WHERE coalesce(d, fit[1]) IS NOT NULL""",
}
