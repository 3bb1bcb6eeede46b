"""Views of the tables that several queries start from, in Spark and as SQL fragments with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.functions import money
from kvern.operators import ranking, snapshots


#: Company kinds, for SQL; written out so that no list of the engine stands behind it.
KINDS_SQL = "['as', 'asa', 'ans', 'da', 'sa', 'ba', 'nuf', 'ks', 'enk', 'iks', 'bbl', 'brl', 'sti', 'kf', 'fli', 'ab', 'ltd', 'inc', 'gmbh']"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entity, as fetched last."""
    rows = table(spark, folder, "entities").select(
        "organisasjonsnummer",
        "navn",
        F.col("organisasjonsform.kode").alias("form"),
        F.col("forretningsadresse.kommune").alias("municipality"),
        F.col("forretningsadresse.postnummer").alias("postcode"),
        F.col("forretningsadresse.poststed").alias("town"),
        F.col("naeringskode1.kode").alias("industry_code"),
        F.col("naeringskode1.beskrivelse").alias("industry"),
        "antallAnsatte",
        "harRegistrertAntallAnsatte",
        "hjemmeside",
        "telefon",
        "mobil",
        "epostadresse",
        "stiftelsesdato",
        "retrieved_at",
    )
    return ranking.latest(rows, ["organisasjonsnummer"], ["retrieved_at"])


#: Ties of ``retrieved_at`` are repeats of one record.
ENTITIES_SQL = """entity AS (
  SELECT organisasjonsnummer, navn, organisasjonsform.kode AS form, forretningsadresse.kommune AS municipality,
    forretningsadresse.postnummer AS postcode, forretningsadresse.poststed AS town, naeringskode1.kode AS industry_code,
    naeringskode1.beskrivelse AS industry, antallAnsatte, harRegistrertAntallAnsatte, hjemmeside, telefon, mobil, epostadresse, stiftelsesdato
  FROM entities QUALIFY row_number() OVER (PARTITION BY organisasjonsnummer ORDER BY retrieved_at DESC) = 1)"""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.run_order(table(spark, folder, "envelopes"))


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """A row per run, entity and claim of the deliveries that hold."""
    envelopes = table(spark, folder, "envelopes").where("run.run_id IS NOT NULL AND organisation_number IS NOT NULL")
    rows = envelopes.select(F.col("run.run_id").alias("run_id"), F.col("organisation_number").alias("entity"), "received_at", "claims")
    last = ranking.latest(rows, ["run_id", "entity"], ["received_at"])
    one = last.select("run_id", "entity", F.posexplode("claims").alias("pos", "c")).where("c.id IS NOT NULL")
    numbered = one.join(runs(spark, folder), "run_id")
    names = ["id", "field", "family", "key", "value", "availability", "scope", "confidence", "evidence_ids", "effective_at", "first_observed_at", "last_changed_at", "last_observed_at", "stale"]
    there = set(one.schema["c"].dataType.names)
    return numbered.select("run_no", "run_id", "entity", "pos", *[F.col(f"c.{n}").alias(n) for n in names if n in there])


CLAIMS_SQL = """runs AS (
  SELECT run_id, row_number() OVER (ORDER BY done, run_id) - 1 AS run_no FROM (
    SELECT run.run_id AS run_id, max(run.completed_at) AS done FROM envelopes WHERE run.run_id IS NOT NULL GROUP BY 1)),
held AS (
  SELECT run.run_id AS run_id, organisation_number AS entity, claims FROM envelopes WHERE run.run_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run.run_id, organisation_number ORDER BY received_at DESC) = 1),
one AS (SELECT run_id, entity, unnest(claims) AS c, generate_subscripts(claims, 1) - 1 AS pos FROM held),
claim AS (
  SELECT run_no, run_id, entity, pos, c.id AS id, c.field AS field, c.family AS family, c.key AS key, c.value AS value,
    c.availability AS availability, c.scope AS scope, c.confidence AS confidence, c.evidence_ids AS evidence_ids, c.effective_at AS effective_at,
    c.first_observed_at AS first_observed_at, c.last_changed_at AS last_changed_at, c.last_observed_at AS last_observed_at,
    c.stale AS stale FROM one JOIN runs USING (run_id))"""

#: Claims of the last run.
NOW_SQL = CLAIMS_SQL + """,
current_claim AS (SELECT * FROM claim WHERE run_no = (SELECT max(run_no) FROM runs))"""


def current_claims(spark: SparkSession, folder: str) -> DataFrame:
    last = runs(spark, folder).agg(F.max("run_no").alias("run_no"))  # one row
    return claims(spark, folder).join(F.broadcast(last), "run_no")


def amounts(claims_: DataFrame) -> DataFrame:
    """Filed figures: ``(entity, field, first_day, last_day, amount, currency)``; values that are no filed figure are left out."""
    parts = F.split("key", ":")
    rows = claims_.where("family = 'financials'").select(
        "run_no",
        "entity",
        "field",
        "pos",
        parts[0].alias("first_day"),
        F.get(parts, F.lit(1)).alias("last_day"),
        F.get(parts, F.lit(2)).alias("account_type"),
        money.amount(F.get_json_object("value", "$.amount")).alias("amount"),
        F.get_json_object("value", "$.currency").alias("currency"),
    )
    return rows.where("amount IS NOT NULL")


AMOUNTS_SQL = """amount AS (
  SELECT run_no, entity, field, pos, split_part(key, ':', 1) AS first_day, split_part(key, ':', 2) AS last_day, split_part(key, ':', 3) AS account_type,
    TRY_CAST(json_extract_string(value, '$.amount') AS DECIMAL(38,6)) AS amount, json_extract_string(value, '$.currency') AS currency
  FROM current_claim WHERE family = 'financials' AND TRY_CAST(json_extract_string(value, '$.amount') AS DECIMAL(38,6)) IS NOT NULL)"""


def _scalar_sql(v: str) -> str:
    text = f"json_extract_string({v}, '$')"
    return f"""CASE WHEN {v} IS NULL OR json_type({v}) = 'NULL' THEN 'null' WHEN json_type({v}) = 'BOOLEAN' THEN 'is ' || {text}
      WHEN regexp_full_match({text}, '-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN '#' || CAST(CAST({text} AS DECIMAL(38,10)) AS VARCHAR) ELSE 'text ' || {text} END"""


def _json_sql(v: str, depth: int) -> str:
    if not depth:
        return _scalar_sql(v)
    w, k = f"w{depth}", f"k{depth}"
    return f"""CASE WHEN json_type({v}) = 'ARRAY' THEN '[' || array_to_string(list_sort(list_transform(CAST({v} AS JSON[]), lambda {w}: {_json_sql(w, depth - 1)})), ', ') || ']'
      WHEN json_type({v}) = 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(json_keys({v})), lambda {k}: {k} || ': ' ||
        list_transform([json_extract({v}, '$."' || {k} || '"')], lambda {w}: {_json_sql(w, depth - 1)})[1]), ', ') || '}}'
      ELSE {_scalar_sql(v)} END"""


def value_sql(column: str, depth: int = 2) -> str:
    """SQL for a JSON text by its value: numbers, in strings too, by amount, lists and members without order.  Values nested deeper than ``depth`` don't occur."""
    return f"""CASE WHEN {column} IS NULL THEN 'null' WHEN NOT json_valid({column}) THEN 'raw ' || {column}
      ELSE list_transform([CAST({column} AS JSON)], lambda v: {_json_sql("v", depth)})[1] END"""
