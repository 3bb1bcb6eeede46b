"""Queries over pages, documents and short texts, and over the warehouse's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.functions import dates, identifiers, pointers, text
from kvern.operators import hierarchy, hosts, ranking, robots
from kvern.plans import tables
from kvern.plans.tables import table
from kvern.sources import bundle, pages

DOMAINS = ("example", "tannklinikk.example", "test")


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "web_pages").select("page_id", "url")
    return rows.select("page_id", text.host(F.col("url")).alias("host"), text.registered_domain(F.col("url")).alias("domain"), text.network(F.col("url")).alias("network"))


def host_suffix_join(spark: SparkSession, folder: str) -> DataFrame:
    wanted = spark.createDataFrame([(d,) for d in DOMAINS], "domain string")
    return hosts.under_domains(table(spark, folder, "web_pages").select("page_id", "url"), "url", wanted).select("page_id", "domain")


def dedup_by_domain(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "web_pages").select("page_id", "url").withColumn("domain", text.registered_domain(F.col("url"))).withColumn("priority", text.page_priority(F.col("url")))
    return ranking.best(rows, ["domain"], [F.col("priority"), F.length("url"), F.col("url"), F.col("page_id")]).select("domain", "page_id", "priority")


def crawl_queue(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "web_pages").select("site", "page_id", "url").withColumn("priority", text.page_priority(F.col("url")))
    return ranking.top(rows, ["site"], [F.col("priority"), F.length("url"), F.col("url"), F.col("page_id")], 7).select("site", "page_id", "place")


def _html(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as markup, made from the parsed lines: a round trip for the parser."""
    rows = table(spark, folder, "web_pages").select("page_id", "url", "title", "lang", "lines")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<p>"), safe(x), F.lit("</p>"))), "")
    return rows.select(
        "page_id", "url", "lines",
        F.concat(F.lit('<html lang="'), F.coalesce("lang", F.lit("")), F.lit('"><head><title>'), safe(F.coalesce("title", F.lit(""))), F.lit('</title></head><body><a href="/om">Om</a>'), body, F.lit("</body></html>")).alias("html"),
    )


def html_parse(spark: SparkSession, folder: str) -> DataFrame:
    parsed = _html(spark, folder).select("page_id", "url", pages.pages_of("html", "url").alias("p"))
    return parsed.select("page_id", F.coalesce("p.title", F.lit("")).alias("title"), F.col("p.lang").alias("lang"), (F.size("p.lines") - 1).alias("n_lines"), F.get("p.links", F.lit(0))["url"].alias("link"))


def text_org_mentions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "web_pages").select("page_id", F.array_join("lines", "\n").alias("body"))
    return rows.select("page_id", F.explode(identifiers.org_mentions(F.col("body"))).alias("org"))


def phone_mail_extract(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "web_pages").select("page_id", F.explode("lines").alias("line"))
    phone = F.nullif(F.regexp_extract("line", r"^(?:Telefon|Phone): (\+?[0-9 ]+)$", 1), F.lit(""))
    mail = F.nullif(F.regexp_extract("line", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1), F.lit(""))
    found = lines.select("page_id", text.phone_digits(phone).alias("phone"), F.lower(mail).alias("mail"))
    return found.where("phone IS NOT NULL OR mail IS NOT NULL").distinct()


ROBOTS = "User-agent: *\nDisallow: /arsrapport\nAllow: /arsrapport-2*\nDisallow: /*?side=\nAllow: /ny-avtale*?side=2$\n\nUser-agent: otherbot\nDisallow: /\n"


def robots_allow(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "web_pages").select("site", F.regexp_extract("url", r"^[a-z]+://[^/]+(/.*)?$", 1).alias("path")).distinct()
    sites = rows.select("site").distinct().withColumn("body", F.lit(ROBOTS))
    rules = sites.select("site", F.explode(robots.parse_robots("body")).alias("r")).select("site", "r.*")
    return robots.decide(rows, rules, "kvern")


def json_pointer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", pointers.at(F.col("props"), "/k", "bigint").alias("k"), pointers.at(F.col("props"), "/no/such").alias("missing"))


def role_pointers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "role_records").select("record_id", "body")
    return rows.select("record_id", pointers.at(F.col("body"), "/rollegrupper/0/type/kode").alias("first_group"))


def date_forms(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    months = F.element_at(F.array(*[F.lit(m[0]) for m in dates.MONTHS]), F.month("d"))
    form = F.col("o_orderkey") % 4
    written = (
        F.when(form == 0, F.date_format("d", "yyyy-MM-dd")).when(form == 1, F.date_format("d", "d.M.yyyy")).when(form == 2, F.concat(F.dayofmonth("d"), F.lit(". "), months, F.lit(" "), F.year("d")))
        .otherwise(F.concat(F.lit("31.02."), F.year("d")))
    )
    return orders.select("o_orderkey", F.date_format(dates.first_date(F.concat(F.lit("Publisert "), written, F.lit(" av oss"))), "yyyy-MM-dd").alias("found"))


def ages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").select("organisasjonsnummer", "stiftelsesdato").distinct()
    return rows.select("organisasjonsnummer", dates.age_in_years(F.col("stiftelsesdato").cast("date"), F.lit("2026-06-30").cast("date")).alias("age"))


def group_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Region, nation and customer as one tree."""
    at = F.lit(1).alias("at")
    region = table(spark, folder, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit(None).cast("string").alias("parent"), at)
    nation = table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), at)
    customer = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), at)
    nodes = hierarchy.build_hierarchy(region.unionByName(nation).unionByName(customer), "child", "parent", "at")
    return nodes.select("node", "root", "depth", F.array_join("path", "/").alias("path"), "subtree_size")


def http_states(spark: SparkSession, folder: str) -> DataFrame:
    """Answers by status; parts stand in for requests."""
    codes = F.array(*[F.lit(c).cast("int") for c in (200, 404, 410, 401, 403, 429, 451, 500, None)])
    rows = table(spark, folder, "part").select("p_partkey", F.get(codes, (F.col("p_partkey") % 9).cast("int")).alias("status"))
    return rows.groupBy(bundle.outcome(F.col("status"), F.when(F.col("status").isNull(), "timeout")).alias("state")).agg(F.count("*").alias("n"))


def name_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").select("organisasjonsnummer", "navn").distinct()
    return rows.select("organisasjonsnummer", "navn", F.array_join(text.name_tokens(F.col("navn")), " ").alias("words"), text.normal_name(F.col("navn")).alias("normal"))


def streets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").select("organisasjonsnummer", F.get("forretningsadresse.adresse", F.lit(0)).alias("line")).where("line IS NOT NULL").distinct()
    return rows.select("organisasjonsnummer", "line", text.street(F.col("line")).alias("street"))


QUERIES = {
    f.__name__: f
    for f in (
        url_parts, host_suffix_join, dedup_by_domain, crawl_queue, html_parse, text_org_mentions, phone_mail_extract, robots_allow, json_pointer, role_pointers,
        date_forms, ages, group_tree, http_states, name_words, streets,
    )
}

_H = "regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]+)', 1), '^www[.]', '')"
_D = f"regexp_extract({_H}, '([^.]+[.])?[^.]+$')"
_PATH = "lower(regexp_extract(url, '^[a-zA-Z]+://[^/]*([^?#]*)', 1))"
_PRIORITY = f"""CASE WHEN {_PATH} IN ('', '/') THEN 0 WHEN regexp_matches({_PATH}, 'kontakt|contact') THEN 1 WHEN regexp_matches({_PATH}, '(^|[/-])om([/-]|$)|about') THEN 2
  WHEN regexp_matches({_PATH}, 'ledige|stilling|soker|jobb|career|wanted') THEN 3 WHEN regexp_matches({_PATH}, 'nytt|nyhet|aktuelt|news') THEN 4 ELSE 5 END"""
_ORDER = f"{_PRIORITY}, length(url), url, page_id"
_FOLD = "replace(strip_accents(translate(lower({0}), 'øå', 'oa')), 'æ', 'ae')"
_WORDS = "regexp_extract_all(" + _FOLD + ", '[a-z0-9]+')"
_KEPT = "list_filter(" + _WORDS.format("navn") + f", lambda t: NOT list_contains({tables.KINDS_SQL}, t))"
_MONTH = "[" + ", ".join(f"'{m[0]}'" for m in dates.MONTHS) + "]"
ORACLES = {
    "url_parts": f"SELECT page_id, {_H} AS host, {_D} AS domain, CAST(NULL AS VARCHAR) AS network FROM web_pages",
    "host_suffix_join": f"""SELECT page_id, d AS domain FROM web_pages, (SELECT unnest({list(DOMAINS)}) AS d) WHERE {_H} = d OR ends_with({_H}, '.' || d)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(d) DESC) = 1""",
    "dedup_by_domain": f"SELECT {_D} AS domain, page_id, CAST({_PRIORITY} AS INT) AS priority FROM web_pages QUALIFY row_number() OVER (PARTITION BY {_D} ORDER BY {_ORDER}) = 1",
    "crawl_queue": f"""SELECT site, page_id, CAST(row_number() OVER (PARTITION BY site ORDER BY {_ORDER}) AS INT) AS place FROM web_pages
      QUALIFY row_number() OVER (PARTITION BY site ORDER BY {_ORDER}) <= 7""",
    "html_parse": f"""SELECT page_id, coalesce(trim(title), '') AS title, coalesce(lang, '') AS lang,
      CAST(len(list_filter(lines, lambda x: trim(regexp_replace(x, '[\\s\\x{{A0}}]+', ' ', 'g')) <> '')) AS INT) AS n_lines, regexp_extract(url, '^[a-z]+://[^/]+') || '/om' AS link FROM web_pages""",
    "text_org_mentions": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(array_to_string(lines, chr(10)), '(?:^|[^0-9])([0-9]{3}[ .]?[0-9]{3}[ .]?[0-9]{3})(?:$|[^0-9])', 1)) AS m FROM web_pages),
      n AS (SELECT DISTINCT page_id, regexp_replace(m, '[ .]', '', 'g') AS org FROM l),
      s AS (SELECT *, (11 - list_sum(list_transform([1, 2, 3, 4, 5, 6, 7, 8], lambda i: CAST(substr(org, i, 1) AS INT) * [3, 2, 7, 6, 5, 4, 3, 2][i])) % 11) % 11 AS r FROM n)
      SELECT page_id, org FROM s WHERE r <> 10 AND r = CAST(substr(org, 9, 1) AS INT)""",
    "phone_mail_extract": """WITH l AS (SELECT page_id, unnest(lines) AS line FROM web_pages),
      p AS (SELECT page_id, regexp_replace(regexp_extract(line, '^(?:Telefon|Phone): (\\+?[0-9 ]+)$', 1), '[^0-9]', '', 'g') AS d, nullif(lower(regexp_extract(line, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)', 1)), '') AS mail FROM l)
      SELECT DISTINCT page_id, CASE WHEN length(d) >= 8 THEN right(d, 8) END AS phone, mail FROM p WHERE length(d) >= 8 OR mail IS NOT NULL""",
    "robots_allow": """WITH p AS (SELECT DISTINCT site, regexp_extract(url, '^[a-z]+://[^/]+(/.*)?$', 1) AS path FROM web_pages),
      r AS (SELECT unnest([{'a': false, 'x': '^/arsrapport', 'n': 11}, {'a': true, 'x': '^/arsrapport-2.*', 'n': 14}, {'a': false, 'x': '^/.*[?]side=', 'n': 8}, {'a': true, 'x': '^/ny-avtale.*[?]side=2$', 'n': 19}]) AS r)
      SELECT site, path, coalesce(max({'n': r.n, 'a': r.a}).a, true) AS allowed FROM p LEFT JOIN r ON regexp_matches(path, r.x) GROUP BY site, path""",
    "json_pointer": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events",
    "role_pointers": """SELECT record_id, CASE WHEN json_valid(body) AND json_type(body, '$.rollegrupper') = 'ARRAY' THEN json_extract_string(body, '$.rollegrupper[0].type.kode') END AS first_group FROM role_records""",
    "date_forms": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS found FROM orders WHERE {_MONTH} IS NOT NULL""",
    "ages": """SELECT DISTINCT organisasjonsnummer, stiftelsesdato, CAST(floor(date_sub('month', CAST(stiftelsesdato AS DATE), DATE '2026-06-30') / 12.0) AS INT) AS age FROM entities""",
    "group_tree": """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS c, NULL AS p FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
      t AS (SELECT c AS node, c AS root, CAST(0 AS BIGINT) AS depth, c AS path FROM e WHERE p IS NULL UNION ALL SELECT e.c, t.root, t.depth + 1, t.path || '/' || e.c FROM t JOIN e ON e.p = t.node)
      SELECT *, (SELECT count(*) FROM t u WHERE u.path = t.path OR starts_with(u.path, t.path || '/')) AS subtree_size FROM t""",
    "http_states": """SELECT CASE WHEN s IS NULL THEN 'failed' WHEN s = 200 THEN 'available' WHEN s IN (404, 410) THEN 'not_available' WHEN s IN (401, 403, 429, 451) THEN 'blocked' ELSE 'failed' END AS state,
      count(*) AS n FROM (SELECT [200, 404, 410, 401, 403, 429, 451, 500, NULL][p_partkey % 9 + 1] AS s FROM part) GROUP BY 1""",
    "name_words": f"""SELECT DISTINCT organisasjonsnummer, navn, array_to_string(CASE WHEN len({_KEPT}) > 0 THEN {_KEPT} ELSE {_WORDS.format("navn")} END, ' ') AS words,
      trim(regexp_replace(lower(navn), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g')) AS normal FROM entities""",
    "streets": f"""SELECT DISTINCT organisasjonsnummer, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string({_WORDS.format("line")}, ' '), '\\bgt\\b', 'gate', 'g'), '\\bvn\\b', 'veien', 'g'), '\\bv\\b', 'vei', 'g'), '\\bpl\\b', 'plass', 'g') AS street
      FROM (SELECT organisasjonsnummer, forretningsadresse.adresse[1] AS line FROM entities) WHERE line IS NOT NULL""",
}
ORACLES["ages"] = "SELECT organisasjonsnummer, age FROM (" + ORACLES["ages"] + ")"
