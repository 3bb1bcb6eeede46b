"""Queries of the general problems over registry tables, with the SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.operators import hierarchy, history, shredding, snapshot_diff
from kvern.plans.tables import value_sql


_CHILD, _PARENT, _AT = "organisasjonsnummer", "parentOrganisasjonsnummer", "received_at"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = hierarchy.build_hierarchy(spark.read.parquet(f"{folder}/group_links.parquet"), _CHILD, _PARENT, _AT, paths=False)
    return nodes.select(F.col("node").alias("organisasjonsnummer"), "root", "depth", "status")


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each organisation's path from the root and the size of what is below it, itself included; null on a circle."""
    nodes = hierarchy.build_hierarchy(spark.read.parquet(f"{folder}/group_links.parquet"), _CHILD, _PARENT, _AT)
    return nodes.select(F.col("node").alias("organisasjonsnummer"), F.array_join("path", "/").alias("path"), "subtree_size")


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(spark.read.parquet(f"{folder}/group_links.parquet"), _CHILD, _PARENT, _AT)


def workplace_rows(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/subunit_pages.parquet")
    only = pages.select("record_id", F.struct(F.transform("_embedded.underenheter", _number_only).alias("underenheter")).alias("page"))
    return shredding.shred_table(
        only, "record_id", "page", "underenheter*", {"code": "organisasjonsnummer"}, ["item_pos"], as_json=False
    )


def _number_only(unit):
    return F.when(unit.isNotNull(), F.struct(unit["organisasjonsnummer"].alias("organisasjonsnummer")))


def role_rows(spark: SparkSession, folder: str) -> DataFrame:
    records = spark.read.parquet(f"{folder}/role_records.parquet")
    leaves = {"code": "type.kode", "fodselsdato": "person.fodselsdato"}
    return shredding.shred_table(
        records, "record_id", "body", "rollegrupper*.roller*", leaves, ["group_pos", "item_pos"], as_json=True
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    order = ["record_table", "record_id", "group_pos", "item_pos", "code", "fodselsdato"]
    units = workplace_rows(spark, folder).select(
        F.lit("subunit_pages").alias("record_table"),
        "record_id",
        F.lit(0).cast("bigint").alias("group_pos"),
        "item_pos",
        F.coalesce("code", F.lit("")).alias("code"),
        F.lit("").alias("fodselsdato"),
    )
    roles = role_rows(spark, folder).select(
        F.lit("role_records").alias("record_table"),
        "record_id",
        "group_pos",
        "item_pos",
        F.coalesce("code", F.lit("")).alias("code"),
        F.coalesce("fodselsdato", F.lit("")).alias("fodselsdato"),
    )
    return units.select(order).unionByName(roles.select(order))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    changes = snapshot_diff.snapshot_changes(spark.read.parquet(f"{folder}/envelopes.parquet"))
    return changes.select("run_id", F.col("entity").alias("organisation_number"), F.col("id").alias("claim_id"), "change_kind")


def _versions(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("entity").alias("organisation_number"),
        F.col("id").alias("claim_id"),
        F.unix_seconds("valid_from").alias("valid_from"),
        F.unix_seconds("valid_to").alias("valid_to"),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _versions(history.current_versions(spark.read.parquet(f"{folder}/envelopes.parquet")))


#: The instant whose state of the record ``p6_as_recorded`` gives: after four runs, before late corrections.
AS_RECORDED = "2026-04-06 00:00:00"


def p6_as_recorded(spark: SparkSession, folder: str) -> DataFrame:
    """The versions as they were on record at an instant."""
    return _versions(history.versions_as_recorded(spark.read.parquet(f"{folder}/envelopes.parquet"), AS_RECORDED))


def p6_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger itself: which delivery held for which runs, and when that was on record."""
    rows = history.ledger(history.updates(spark.read.parquet(f"{folder}/envelopes.parquet")))
    return rows.select(
        F.col("key").alias("organisation_number"), F.col("value.run_no").alias("run_no"), F.col("value.told").alias("told"), "valid_from", "valid_to",
        F.unix_seconds("recorded_from").alias("recorded_from"), F.unix_seconds("recorded_to").alias("recorded_to"),
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_descendants": p2_descendants,
    "p2_paths": p2_paths,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_as_recorded": p6_as_recorded,
    "p6_ledger": p6_ledger,
}

_LINKS = r"""
WITH RECURSIVE clean AS (
  SELECT nullif(regexp_replace(organisasjonsnummer, '\s+', '', 'g'), '') AS node,
         nullif(regexp_replace(parentOrganisasjonsnummer, '\s+', '', 'g'), '') AS parent, received_at
  FROM group_links),
links AS (
  SELECT node, arg_max(parent, received_at) FILTER (parent IS NOT NULL) AS parent FROM (
    SELECT node, parent, received_at FROM clean WHERE node IS NOT NULL
    UNION ALL SELECT parent, NULL, NULL FROM clean WHERE parent IS NOT NULL) GROUP BY node),
walk AS (
  SELECT node, parent AS ancestor, 1 AS distance FROM links WHERE parent IS NOT NULL
  UNION ALL
  SELECT w.node, l.parent, w.distance + 1 FROM walk w JOIN links l ON l.node = w.ancestor
  WHERE l.parent IS NOT NULL AND w.distance <= 200),
looped AS (SELECT DISTINCT node FROM walk WHERE distance > 200),
circle AS (SELECT DISTINCT node FROM walk WHERE node = ancestor),
top AS (SELECT node, max(distance) AS depth, arg_max(ancestor, distance) AS root FROM walk
        WHERE node NOT IN (SELECT node FROM looped) GROUP BY node)
"""

_HELD = f"""runs AS (
  SELECT run_id, CAST(row_number() OVER (ORDER BY done, run_id) - 1 AS INT) AS run_no, done FROM (
    SELECT run.run_id AS run_id, max(run.completed_at) AS done FROM envelopes WHERE run.run_id IS NOT NULL AND organisation_number IS NOT NULL GROUP BY 1)),
given AS (
  SELECT organisation_number AS entity, run_no, received_at, claims FROM envelopes JOIN runs ON run.run_id = run_id WHERE organisation_number IS NOT NULL)"""
_OBSERVED = f"""each AS (SELECT entity, run_no, unnest(claims) AS c FROM held),
fact AS (SELECT entity, run_no, c.id AS id, {value_sql("c.value")} AS same_as, c.last_observed_at AS observed FROM each WHERE c.id IS NOT NULL)"""
_STRETCHES = """marked AS (SELECT *, CASE WHEN lag(run_no) OVER w = run_no - 1 AND lag(same_as) OVER w = same_as THEN 0 ELSE 1 END AS begins FROM fact WINDOW w AS (PARTITION BY entity, id ORDER BY run_no)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY entity, id ORDER BY run_no) AS version FROM marked)
SELECT entity AS organisation_number, id AS claim_id, CAST(floor(epoch(arg_min(observed, run_no))) AS BIGINT) AS valid_from,
  CAST(floor(epoch(arg_max(observed, run_no))) AS BIGINT) AS valid_to FROM numbered GROUP BY entity, id, version"""
_LAST = "held AS (SELECT entity, run_no, claims FROM given QUALIFY row_number() OVER (PARTITION BY entity, run_no ORDER BY received_at DESC NULLS LAST) = 1)"
#: Statements with what each covers: its run, and the next one where nothing later was on record for the entity.
_STATED = """said AS (SELECT DISTINCT entity, run_no, received_at AS at, true AS told FROM given
  UNION ALL SELECT e.entity, r.run_no, done, false FROM (SELECT DISTINCT entity FROM given) e, runs r WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.entity = e.entity AND g.run_no = r.run_no)),
covers AS (SELECT *, run_no + CASE WHEN told AND NOT EXISTS (SELECT 1 FROM said t WHERE t.entity = s.entity AND t.run_no > s.run_no AND t.at <= s.at) THEN 2 ELSE 1 END AS upto FROM said s)"""

ORACLES = {
    "p5_found": f"""WITH {_HELD}, {_LAST}, {_OBSERVED},
pairs AS (SELECT coalesce(a.run_no, b.run_no + 1) AS run_no, coalesce(a.entity, b.entity) AS entity, coalesce(a.id, b.id) AS id,
  CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.same_as <> b.same_as THEN 'changed' END AS change_kind
  FROM fact a FULL JOIN fact b ON b.run_no = a.run_no - 1 AND b.entity = a.entity AND b.id = a.id)
SELECT run_id, entity AS organisation_number, id AS claim_id, change_kind FROM pairs JOIN runs USING (run_no) WHERE change_kind IS NOT NULL AND run_no > 0""",
    "p6_found": f"WITH {_HELD}, {_LAST}, {_OBSERVED}, {_STRETCHES}",
    "p6_as_recorded": f"""WITH {_HELD}, {_STATED},
best AS (SELECT c.entity, r.run_no, c.run_no AS source, c.at, c.told FROM covers c JOIN runs r ON r.run_no >= c.run_no AND r.run_no < c.upto
  WHERE c.at <= TIMESTAMP '{AS_RECORDED}' AND r.done <= TIMESTAMP '{AS_RECORDED}' QUALIFY row_number() OVER (PARTITION BY c.entity, r.run_no ORDER BY c.at DESC, c.run_no DESC) = 1),
held AS (SELECT b.entity, b.run_no, any_value(g.claims) AS claims FROM best b JOIN given g ON g.entity = b.entity AND g.run_no = b.source AND g.received_at = b.at WHERE b.told GROUP BY 1, 2),
{_OBSERVED}, {_STRETCHES}""",
    "p2_found": _LINKS
    + """SELECT l.node AS organisasjonsnummer,
  CASE WHEN p.node IS NOT NULL THEN '' ELSE coalesce(t.root, l.node) END AS root,
  CAST(CASE WHEN p.node IS NOT NULL THEN -1 ELSE coalesce(t.depth, 0) END AS BIGINT) AS depth,
  CASE WHEN c.node IS NOT NULL THEN 'cycle' WHEN p.node IS NOT NULL THEN 'below_cycle' ELSE 'tree' END AS status
FROM links l LEFT JOIN looped p ON p.node = l.node LEFT JOIN circle c ON c.node = l.node LEFT JOIN top t ON t.node = l.node""",
    "p2_descendants": _LINKS
    + """SELECT ancestor, node AS descendant, CAST(min(distance) AS BIGINT) AS distance FROM walk WHERE node <> ancestor GROUP BY ALL""",
    "p2_paths": _LINKS
    + """SELECT l.node AS organisasjonsnummer, CASE WHEN p.node IS NOT NULL THEN '' ELSE coalesce((SELECT string_agg(w.ancestor, '/' ORDER BY w.distance DESC) FROM walk w WHERE w.node = l.node) || '/', '') || l.node END AS path,
  CASE WHEN c.node IS NULL THEN CAST(1 + (SELECT count(DISTINCT w.node) FROM walk w WHERE w.ancestor = l.node) AS BIGINT) END AS subtree_size
FROM links l LEFT JOIN looped p ON p.node = l.node LEFT JOIN circle c ON c.node = l.node""",
    "p3_found": r"""
WITH units AS (
  SELECT record_id, unnest(_embedded.underenheter) AS u, generate_subscripts(_embedded.underenheter, 1) - 1 AS item_pos
  FROM subunit_pages),
bodies AS (SELECT record_id, TRY_CAST(body AS JSON) AS doc FROM role_records WHERE json_valid(body)),
outer_lists AS (
  SELECT record_id, CASE json_type(doc, '$.rollegrupper') WHEN 'ARRAY' THEN CAST(doc->'$.rollegrupper' AS JSON[])
    WHEN 'OBJECT' THEN [doc->'$.rollegrupper'] END AS gs FROM bodies),
groups AS (SELECT record_id, unnest(gs) AS g, generate_subscripts(gs, 1) - 1 AS group_pos FROM outer_lists),
inner_lists AS (
  SELECT record_id, group_pos, CASE json_type(g, '$.roller') WHEN 'ARRAY' THEN CAST(g->'$.roller' AS JSON[])
    WHEN 'OBJECT' THEN [g->'$.roller'] END AS rs FROM groups),
roles AS (SELECT record_id, group_pos, unnest(rs) AS r, generate_subscripts(rs, 1) - 1 AS item_pos FROM inner_lists)
SELECT 'subunit_pages' AS record_table, record_id, CAST(0 AS BIGINT) AS group_pos, CAST(item_pos AS BIGINT) AS item_pos,
  coalesce(u.organisasjonsnummer, '') AS code, '' AS fodselsdato FROM units WHERE u IS NOT NULL
UNION ALL
SELECT 'role_records', record_id, CAST(group_pos AS BIGINT), CAST(item_pos AS BIGINT),
  coalesce(r->>'$.type.kode', ''), coalesce(r->>'$.person.fodselsdato', '') FROM roles""",
}
