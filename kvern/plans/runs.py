"""Queries over runs of snapshots: typed differences, citations, audit, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvern.functions.canonical import value_digests
from kvern.operators import audit, facts, ranking, refresh
from kvern.plans import tables
from kvern.plans.tables import CLAIMS_SQL, NOW_SQL, table
from kvern.sources import jobfeed, sinks

STATES = ("available", "blocked", "failed", "not_available", "ambiguous", "not_applicable")


def _facts(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """The facts of the last two runs with ``is_last``, and the day of the run before the last.

    A family counts as completely checked where the entity's facts of it are none of
    them stale.  A value's digest is that of its canonical form: another spelling is the same value.
    """
    rows = tables.claims(spark, folder).withColumn("stale", F.coalesce("stale", F.lit(False)))
    done = table(spark, folder, "envelopes").groupBy(F.col("run.run_id").alias("run_id")).agg(F.max("run.completed_at").alias("at"))
    days = tables.runs(spark, folder).join(done, "run_id").orderBy(F.col("run_no").desc()).select("run_no", F.date_format("at", "yyyy-MM-dd").alias("day")).head(2)  # two runs
    last = days[0].run_no if days else -1
    both = rows.where(F.col("run_no") >= last - 1)
    shaped = both.withColumn("digest", value_digests(F.array("value"))[0]).withColumn("is_last", F.col("run_no") == last)
    families = Window.partitionBy("run_no", "entity", "family")  # a company's facts of one family
    return shaped.withColumn("complete", ~F.max("stale").over(families)), days[1].day if len(days) > 1 else ""


_NEEDED = ("id", "entity", "field", "family", "key", "value", "digest", "effective_at", "complete")
_TIMES = ("id", "digest", "first_observed_at", "last_changed_at", "last_observed_at")


def _two_runs(spark: SparkSession, folder: str, columns: tuple[str, ...] = _NEEDED) -> tuple[DataFrame, DataFrame]:
    rows, _ = _facts(spark, folder)
    return rows.where("NOT is_last").select(*columns), rows.where("is_last").select(*columns)


def _inactive(spark: SparkSession, folder: str) -> DataFrame:
    """Ads that the feed shows as closed, by their number."""
    return jobfeed.current_ads(table(spark, folder, "job_entries").select("uuid", "status", "sistEndret", "received_at")).where("status <> 'ACTIVE'").select(F.col("uuid").alias("key"))


def _none_registered(spark: SparkSession, folder: str) -> DataFrame:
    return tables.entities(spark, folder).where("harRegistrertAntallAnsatte = false").select(F.col("organisasjonsnummer").alias("entity"))


_PAIR = f"""WITH {CLAIMS_SQL},
ended AS (SELECT run.run_id AS run_id, strftime(max(run.completed_at), '%Y-%m-%d') AS day FROM envelopes GROUP BY 1),
shaped AS (SELECT *, coalesce(stale, false) AS old, {tables.value_sql("value")} AS same_as FROM claim WHERE run_no >= (SELECT max(run_no) - 1 FROM runs)),
done AS (SELECT run_no, entity, family, NOT bool_or(old) AS complete FROM shaped GROUP BY ALL),
whole AS (SELECT * FROM shaped JOIN done USING (run_no, entity, family)),
b AS (SELECT * FROM whole WHERE run_no = (SELECT max(run_no) - 1 FROM runs)),
a AS (SELECT * FROM whole WHERE run_no = (SELECT max(run_no) FROM runs)),
shut AS (SELECT uuid FROM (SELECT uuid, status FROM job_entries QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY sistEndret DESC, received_at DESC) = 1) WHERE status <> 'ACTIVE'),
bare AS (SELECT organisasjonsnummer FROM (SELECT organisasjonsnummer, harRegistrertAntallAnsatte AS h FROM entities
  QUALIFY row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY retrieved_at DESC) = 1) WHERE NOT h)"""


def refresh_full_diff(spark: SparkSession, folder: str) -> DataFrame:
    pairs = refresh.compare(*_two_runs(spark, folder))
    same = F.coalesce(F.col("old.digest") == F.col("new.digest"), F.lit(False))
    return pairs.select("id", F.when((F.col("status") == "matched") & same, "same").otherwise(F.col("status")).alias("status"))


def refresh_stale_carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    rows = refresh.carried_forward(*_two_runs(spark, folder), _inactive(spark, folder))
    return rows.select("id", "entity", "field", "stale", "stale_reason")


def refresh_times(spark: SparkSession, folder: str) -> DataFrame:
    """When the last run's facts were first observed and last changed, carried on from the run before."""
    rows = refresh.carried_times(*_two_runs(spark, folder, _TIMES))
    return rows.select("id", F.unix_seconds("first_observed_at").alias("first_observed"), F.unix_seconds("last_changed_at").alias("last_changed"))


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    rows, day = _facts(spark, folder)
    before, after = (rows.where(which).select(*_NEEDED) for which in ("NOT is_last", "is_last"))
    return refresh.typed_changes(before, after, day, _inactive(spark, folder), _none_registered(spark, folder))


def refresh_typed_changes(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, folder).select("id", "entity", "field", "type", "material")


def refresh_removed_when_complete(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, folder).where(F.col("type").startswith("removed_")).select("id", "entity", "type")


def refresh_new_filing_once(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, folder).where("type IN ('new_filing', 'filing_value')").groupBy("entity", "type").agg(F.count("*").alias("n"))


def changes_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, folder).groupBy("type").agg(F.count("*").alias("n"), F.count_if("material").alias("material"))


def value_equality(spark: SparkSession, folder: str) -> DataFrame:
    """How many spellings of values there are, and how many values."""
    filed = tables.claims(spark, folder).where("family = 'financials'")
    amount = F.get_json_object("value", "$.amount").try_cast("decimal(38,6)")
    return filed.groupBy("field").agg(F.count_distinct("value").alias("spellings"), F.count_distinct(F.struct("id", amount.alias("a"))).alias("amounts"))


def family_coverage(spark: SparkSession, folder: str) -> DataFrame:
    now = tables.current_claims(spark, folder).where("availability = 'available'")
    return now.groupBy("family").agg(F.count_distinct("entity").alias("companies"))


def state_histogram(spark: SparkSession, folder: str) -> DataFrame:
    last = ranking.latest(
        table(spark, folder, "envelopes").select("organisation_number", F.col("run.run_id").alias("run_id"), "received_at", "state"),
        ["organisation_number", "run_id"], ["received_at"],
    )
    return ranking.fixed_histogram(last, "state", list(STATES))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Orders stand in for evidence records: an id, a source, a body and its hash."""
    orders = table(spark, folder, "orders")
    url = F.when(F.col("o_orderkey") % 97 == 0, "ftp://x").otherwise(F.concat(F.lit("https://register.example/"), F.col("o_orderkey")))
    body = F.concat_ws("|", F.col("o_orderkey"), "o_orderstatus", "o_orderpriority")
    sha = F.when(F.col("o_orderkey") % 89 == 0, F.lit("0" * 64)).otherwise(F.sha2(body, 256))
    return orders.select(F.col("o_orderkey").cast("string").alias("evidence_id"), url.alias("source_url"), body.alias("body"), sha.alias("content_sha256"))


def _cited(spark: SparkSession, folder: str) -> DataFrame:
    """Customers stand in for facts that cite evidence: some of it missing, one family unknown."""
    customers = table(spark, folder, "customer")
    refs = F.array(*[((F.col("c_custkey") * k) % 21000).cast("string") for k in (7, 11, 13)])
    family = F.when(F.col("c_custkey") % 101 == 0, "gossip").otherwise("identity")
    return customers.select(
        F.col("c_nationkey").cast("string").alias("entity"), F.concat(F.lit("cl_"), F.col("c_custkey") % 1400).alias("id"), family.alias("family"),
        F.when(F.col("c_custkey") % 103 != 0, F.col("c_name")).alias("value"), F.lit("").alias("key"), refs.alias("evidence_ids"),
    )


_CITED = """WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS evidence_id, CASE WHEN o_orderkey % 97 = 0 THEN 'ftp://x' ELSE 'https://register.example/' || o_orderkey END AS source_url,
  concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority) AS body, CASE WHEN o_orderkey % 89 = 0 THEN repeat('0', 64) ELSE sha256(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)) END AS sha FROM orders),
f AS (SELECT CAST(c_nationkey AS VARCHAR) AS entity, 'cl_' || (c_custkey % 1400) AS id, CASE WHEN c_custkey % 101 = 0 THEN 'gossip' ELSE 'identity' END AS family,
  CASE WHEN c_custkey % 103 <> 0 THEN c_name END AS value, [CAST((c_custkey * k) % 21000 AS VARCHAR) FOR k IN [7, 11, 13]] AS evidence_ids, c_custkey FROM customer)
"""


def citation_first_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = _cited(spark, folder).where(F.length("id") > 0)
    one = ranking.best(rows, ["id"], [F.col("value").asc_nulls_last(), F.col("entity")])
    cited = facts.first_citation(one.select("id", "evidence_ids"), _evidence(spark, folder))
    return cited.select("id", "evidence_id", "source_url")


def provenance_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """The source of an order's first line, else of the order itself."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("f"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce(F.concat(F.lit("part "), F.col("f.l_partkey")), F.concat(F.lit("order "), "o_orderpriority")).alias("source"))


def integrity_violations(spark: SparkSession, folder: str) -> DataFrame:
    return audit.findings(_cited(spark, folder), _evidence(spark, folder))


def audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return audit.counts(integrity_violations(spark, folder))


def evidence_union(spark: SparkSession, folder: str) -> DataFrame:
    return facts.union_evidence(_cited(spark, folder)).select("id", F.array_join("evidence_ids", ",").alias("evidence"))


def claims_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The rules over the claims of the last run."""
    now = tables.current_claims(spark, folder).select("entity", "id", "family", "value", "key", "evidence_ids")
    return audit.counts(audit.findings(now))


def bodies_once(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.content_addressed(table(spark, folder, "role_records"), "body").select("sha", F.length("body").alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        refresh_full_diff, refresh_stale_carry_forward, refresh_typed_changes, refresh_removed_when_complete, refresh_new_filing_once, changes_by_type,
        value_equality, family_coverage, state_histogram, citation_first_match, provenance_fallback, integrity_violations, audit_counts, evidence_union,
        claims_audit, bodies_once, refresh_times,
    )
}

_GONE = """NOT (field = 'job_posting' AND coalesce(json_extract_string(value, '$.status') = 'active' AND key IN (SELECT uuid FROM shut), false)) AND NOT (field IN ('registered_role', 'registered_workplace') AND coalesce((SELECT bool_or(a.complete) FROM a WHERE a.entity = b.entity AND a.family = b.family), false))"""
_YEARS = "list_sort(list_distinct(regexp_extract_all({0}, '(?:^|[^0-9])([0-9]{{4}})(?:$|[^0-9])', 1)))"
_CHANGED = """WHEN 'legal_name' THEN 'changed_name' WHEN 'legal_form' THEN 'changed_legal_form' WHEN 'registered_address' THEN 'changed_address'
  WHEN 'postal_address' THEN 'changed_address' WHEN 'bankrupt' THEN 'changed_status' WHEN 'liquidating' THEN 'changed_status'
  WHEN 'registry_website_candidate' THEN 'changed_registry_website' WHEN 'employees' THEN 'changed_employee_count' WHEN 'workplace_employees' THEN 'changed_employee_count'
  WHEN 'industry' THEN 'changed_industry' WHEN 'secondary_industry' THEN 'changed_industry' WHEN 'tertiary_industry' THEN 'changed_industry'
  WHEN 'official_website' THEN 'changed_website' WHEN 'registered_role' THEN 'changed_role' WHEN 'registered_workplace' THEN 'changed_location'"""
_TYPED = f"""{_PAIR},
p AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.entity, b.entity) AS entity, coalesce(a.field, b.field) AS field, coalesce(a.family, b.family) AS family,
    coalesce(a.key, b.key) AS key, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'gone' ELSE 'matched' END AS status,
    coalesce(a.same_as = b.same_as AND a.id IS NOT NULL AND b.id IS NOT NULL, false) AS same, b.value AS v0, a.value AS v1, a.effective_at AS eff
  FROM b FULL JOIN a ON a.id = b.id),
wc AS (SELECT entity, family, bool_or(complete) AS was FROM b GROUP BY ALL), ic AS (SELECT entity, family, bool_or(complete) AS now FROM a GROUP BY ALL),
filing AS (SELECT id, entity, list_filter({_YEARS.format("v1")}, lambda y: NOT list_contains({_YEARS.format("v0")}, y)) AS added FROM p
  WHERE status = 'matched' AND NOT same AND field IN ('latest_filing_year', 'available_filing_years', 'filing_years')),
announced AS (SELECT DISTINCT entity, unnest(added) AS year FROM filing),
knew AS (SELECT DISTINCT entity, unnest({_YEARS.format("value")}) AS year FROM b WHERE field IN ('latest_filing_year', 'available_filing_years', 'filing_years')),
ends AS (SELECT entity, max(nullif(split_part(key, ':', 2), '')) AS last_end FROM b WHERE family = 'financials' GROUP BY 1),
y AS (SELECT p.id, p.entity, substr(split_part(key, ':', 2), 1, 4) AS year FROM p JOIN ends USING (entity)
  WHERE status = 'new' AND family = 'financials' AND split_part(key, ':', 2) > last_end),
yt AS (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY id) AS turn FROM y),
t AS (SELECT p.id, p.entity, p.field, p.family, CASE
    WHEN status = 'new' THEN CASE
      WHEN yt.year IS NOT NULL THEN CASE WHEN n.year IS NOT NULL THEN 'filing_value' WHEN k.year IS NOT NULL THEN 'first_observed' WHEN turn = 1 THEN 'new_filing' ELSE 'filing_value' END
      WHEN field = 'registered_role' AND coalesce(was, false) AND coalesce(now, false) THEN 'new_role'
      WHEN field = 'registered_workplace' AND coalesce(was, false) AND coalesce(now, false) THEN 'new_location'
      WHEN p.family = 'hiring' AND substr(eff, 1, 10) > (SELECT max(day) FROM ended JOIN runs USING (run_id) WHERE run_no = (SELECT max(run_no) - 1 FROM runs)) THEN 'new_job'
      WHEN p.family = 'activity' AND substr(eff, 1, 10) > (SELECT max(day) FROM ended JOIN runs USING (run_id) WHERE run_no = (SELECT max(run_no) - 1 FROM runs)) THEN 'new_publication'
      WHEN field = 'employees' AND p.entity IN (SELECT organisasjonsnummer FROM bare) THEN 'changed_employee_count' ELSE 'first_observed' END
    WHEN status = 'matched' AND NOT same THEN CASE
      WHEN field IN ('latest_filing_year', 'available_filing_years', 'filing_years') THEN CASE WHEN len(f.added) > 0 THEN 'new_filing' ELSE 'changed' END
      ELSE CASE field {_CHANGED} ELSE CASE WHEN p.family = 'financials' THEN 'changed_financials' ELSE 'changed' END END END
    WHEN status = 'gone' THEN CASE WHEN field = 'registered_role' AND coalesce(now, false) THEN 'removed_role' WHEN field = 'registered_workplace' AND coalesce(now, false) THEN 'removed_location'
      WHEN field = 'job_posting' AND json_extract_string(v0, '$.status') = 'active' AND p.key IN (SELECT uuid FROM shut) THEN 'closed_job' END END AS type
  FROM p LEFT JOIN wc ON wc.entity = p.entity AND wc.family = p.family LEFT JOIN ic ON ic.entity = p.entity AND ic.family = p.family
  LEFT JOIN filing f ON f.id = p.id LEFT JOIN yt ON yt.id = p.id LEFT JOIN announced n ON n.entity = p.entity AND n.year = yt.year
  LEFT JOIN knew k ON k.entity = p.entity AND k.year = yt.year),
typed AS (SELECT *, type NOT IN ('first_observed', 'filing_value') AS material FROM t WHERE type IS NOT NULL)
"""
_FOUND = f"""{_CITED}, r AS (SELECT entity, id, unnest(evidence_ids) AS evidence_id FROM f),
found AS (SELECT DISTINCT * FROM (
  SELECT entity, id, 'unsupported fact' AS code FROM f WHERE value IS NULL
  UNION ALL SELECT entity, id, 'unknown family' FROM f WHERE family = 'gossip'
  UNION ALL SELECT entity, id, 'duplicate fact id' FROM f GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT entity, id, CASE WHEN sha IS NULL THEN 'unknown evidence id' WHEN source_url NOT LIKE 'http%' THEN 'invalid source url' WHEN sha256(body) <> sha THEN 'hash mismatch' END
    FROM r LEFT JOIN e USING (evidence_id)) WHERE code IS NOT NULL)"""

ORACLES = {
    "refresh_full_diff": f"""{_PAIR} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'gone' WHEN a.same_as = b.same_as THEN 'same' ELSE 'matched' END AS status
      FROM b FULL JOIN a ON a.id = b.id""",
    "refresh_stale_carry_forward": f"""{_PAIR} SELECT id, entity, field, false AS stale, NULL AS stale_reason FROM a UNION ALL
      SELECT id, entity, field, true, CASE (SELECT bool_or(a.complete) FROM a WHERE a.entity = b.entity AND a.family = b.family) WHEN true THEN 'missing from the new run'
        WHEN false THEN 'family not checked completely' ELSE 'family absent from the new run' END FROM b WHERE id NOT IN (SELECT id FROM a) AND {_GONE}""",
    "refresh_times": f"""{_PAIR} SELECT a.id, CAST(floor(epoch(CASE WHEN b.id IS NULL THEN a.first_observed_at ELSE b.first_observed_at END)) AS BIGINT) AS first_observed,
      CAST(floor(epoch(CASE WHEN b.id IS NULL THEN a.first_observed_at WHEN a.same_as = b.same_as THEN coalesce(b.last_changed_at, b.first_observed_at) ELSE a.last_observed_at END)) AS BIGINT) AS last_changed
      FROM a LEFT JOIN b ON a.id = b.id""",
    "refresh_typed_changes": f"{_TYPED} SELECT id, entity, field, type, material FROM typed",
    "refresh_removed_when_complete": f"{_TYPED} SELECT id, entity, type FROM typed WHERE type LIKE 'removed_%'",
    "refresh_new_filing_once": f"{_TYPED} SELECT entity, type, count(*) AS n FROM typed WHERE type IN ('new_filing', 'filing_value') GROUP BY ALL",
    "changes_by_type": f"{_TYPED} SELECT type, count(*) AS n, count(*) FILTER (material) AS material FROM typed GROUP BY ALL",
    "value_equality": f"""WITH {CLAIMS_SQL} SELECT field, count(DISTINCT value) AS spellings,
      count(DISTINCT (id, TRY_CAST(json_extract_string(value, '$.amount') AS DECIMAL(38,6)))) AS amounts FROM claim WHERE family = 'financials' GROUP BY field""",
    "family_coverage": f"WITH {NOW_SQL} SELECT family, count(DISTINCT entity) AS companies FROM current_claim WHERE availability = 'available' GROUP BY family",
    "state_histogram": f"""WITH l AS (SELECT state FROM envelopes QUALIFY row_number() OVER (PARTITION BY organisation_number, run.run_id ORDER BY received_at DESC) = 1),
      d AS (SELECT unnest({list(STATES)}) AS state) SELECT d.state, count(l.state) AS n FROM d LEFT JOIN l ON l.state = d.state GROUP BY d.state""",
    "citation_first_match": f"""{_CITED}, o AS (SELECT id, evidence_ids FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY value NULLS LAST, entity) = 1),
      x AS (SELECT id, unnest(evidence_ids) AS evidence_id, generate_subscripts(evidence_ids, 1) AS pos FROM o),
      h AS (SELECT id, evidence_id, source_url FROM x JOIN e USING (evidence_id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1)
      SELECT o.id, h.evidence_id, h.source_url FROM o LEFT JOIN h USING (id)""",
    "provenance_fallback": """WITH l AS (SELECT l_orderkey, min({'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}) AS f FROM lineitem GROUP BY 1)
      SELECT o_orderkey, coalesce('part ' || l.f.p, 'order ' || o_orderpriority) AS source FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
    "integrity_violations": f"{_FOUND} SELECT entity, id, code FROM found",
    "audit_counts": f"{_FOUND} SELECT code, count(*) AS n FROM found GROUP BY code",
    "evidence_union": f"{_CITED} SELECT id, string_agg(DISTINCT x, ',' ORDER BY x) AS evidence FROM (SELECT id, unnest(evidence_ids) AS x FROM f) GROUP BY id",
    "claims_audit": f"""WITH {NOW_SQL}, found AS (SELECT DISTINCT * FROM (SELECT entity, id, 'unsupported fact' AS code FROM current_claim WHERE value IS NULL OR coalesce(len(evidence_ids), 0) = 0
      UNION ALL SELECT entity, id, 'unknown family' FROM current_claim WHERE family NOT IN ('identity', 'financials', 'leadership', 'locations', 'group',
        'filing_history', 'website', 'description', 'contact', 'social_profiles', 'hiring', 'activity', 'workforce')
      UNION ALL SELECT entity, id, 'financial fact missing period' FROM current_claim WHERE family = 'financials' AND NOT contains(coalesce(key, ''), ':')
      UNION ALL SELECT entity, id, 'duplicate fact id' FROM current_claim GROUP BY entity, id HAVING count(*) > 1)) SELECT code, count(*) AS n FROM found GROUP BY code""",
    "bodies_once": "SELECT sha256(body) AS sha, CAST(length(any_value(body)) AS INT) AS size FROM role_records WHERE body IS NOT NULL GROUP BY 1",
}
