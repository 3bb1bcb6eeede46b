"""Typed differences of two runs' facts.

One full outer join by fact id gives matched, new and gone facts; the type of a
change follows from field, family and what was checked completely.  A gone fact is
a removal only where a complete check proves it, else it is carried on as stale.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types of changed values by field.
CHANGED = {
    "legal_name": "changed_name", "legal_form": "changed_legal_form", "registered_address": "changed_address", "postal_address": "changed_address",
    "bankrupt": "changed_status", "liquidating": "changed_status", "registry_website_candidate": "changed_registry_website",
    "employees": "changed_employee_count", "workplace_employees": "changed_employee_count", "industry": "changed_industry",
    "secondary_industry": "changed_industry", "tertiary_industry": "changed_industry",
    "official_website": "changed_website", "registered_role": "changed_role", "registered_workplace": "changed_location",
}
SETS = {"registered_role": ("new_role", "removed_role"), "registered_workplace": ("new_location", "removed_location")}
FILINGS = ("latest_filing_year", "available_filing_years", "filing_years")  # the last is the name in the given tables
QUIET = ("first_observed", "filing_value")


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def years_in(value: Column) -> Column:
    """Four-digit years that a filing-year value names, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(value, F.lit(r"(?<![0-9])([0-9]{4})(?![0-9])"), F.lit(1))))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(id, status, old, new)`` with ``status`` matched, new or gone.

    Both sides have ``id`` once, ``entity``, ``field``, ``family``, ``key``, ``value``,
    ``digest``, ``effective_at`` and ``complete``, which says whether the family was
    checked completely.
    """
    sides = [d.select("id", F.struct(*[c for c in d.columns if c != "id"]).alias(n)) for d, n in ((before, "old"), (after, "new"))]
    both = sides[0].join(sides[1], "id", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").otherwise("matched")
    return both.withColumn("status", status)


def typed_changes(
    before: DataFrame | None, after: DataFrame, previous_day: str | None = None, inactive: DataFrame | None = None, none_registered: DataFrame | None = None
) -> DataFrame:
    """``(id, entity, field, family, type, material, previous_value, current_value)``, a row per change; stale facts give none.

    Without an earlier run (``before`` is None) nothing has changed: no rows.
    ``inactive (key)`` are job ads that their feed shows as closed: an active ad that
    is gone and among these is a ``closed_job``.  ``none_registered (entity)`` are
    entities whose earlier run said that no employees are registered: a first number
    there is a ``changed_employee_count``.

    A filing year is announced once per entity: years that filing-year facts add come
    first, a new financial figure for an announced year is a ``filing_value``, for a
    year known before ``first_observed``, else the first figure announces it.
    """
    if before is None:
        return typed_changes(after.limit(0), after.limit(0), previous_day)
    pairs = compare(before, after)
    one = F.coalesce(F.col("new"), F.col("old"))
    rows = pairs.select(
        "id",
        "status",
        *[one[c].alias(c) for c in ("entity", "field", "family", "key")],
        F.col("old.value").alias("previous_value"),
        F.col("new.value").alias("current_value"),
        F.coalesce(F.col("old.digest") == F.col("new.digest"), F.lit(False)).alias("same"),
        F.col("new.effective_at").alias("effective_at"),
        (F.coalesce("old.complete", F.lit(False)) & F.coalesce("new.complete", F.lit(False))).alias("pair_complete"),
    )
    # completeness belongs to the family of an entity, on either side
    known = before.groupBy("entity", "family").agg(F.max("complete").alias("was_complete"))
    checked = after.groupBy("entity", "family").agg(F.max("complete").alias("is_complete"))
    rows = rows.join(known, ["entity", "family"], "left").join(checked, ["entity", "family"], "left")
    both_complete = F.coalesce("was_complete", F.lit(False)) & F.coalesce("is_complete", F.lit(False))

    added = F.array_except(years_in(F.col("current_value")), years_in(F.col("previous_value")))
    rows = rows.withColumn("added", F.when((F.col("status") == "matched") & F.col("field").isin(*FILINGS) & ~F.col("same"), added))
    announced = rows.where(F.size("added") > 0).select("entity", F.explode("added").alias("year")).distinct()
    old_years = before.where(F.col("field").isin(*FILINGS)).select("entity", F.explode(years_in(F.col("value"))).alias("year")).distinct()
    ends = before.where("family = 'financials'").groupBy("entity").agg(F.max(F.split("key", ":")[1]).alias("last_end"))
    end = F.split("key", ":")[1]
    rows = rows.join(ends, "entity", "left").withColumn("year", F.when((F.col("status") == "new") & (F.col("family") == "financials") & (end > F.col("last_end")), F.substring(end, 1, 4)))
    rows = rows.join(announced.withColumn("is_announced", F.lit(True)), ["entity", "year"], "left").join(old_years.withColumn("is_known", F.lit(True)), ["entity", "year"], "left")
    turn = F.row_number().over(Window.partitionBy("entity", "year").orderBy("id"))
    rows = rows.withColumn("turn", F.when(F.col("year").isNotNull(), turn))

    rows = _marked(rows, inactive, "key", "is_inactive")
    rows = _marked(rows, none_registered, "entity", "had_none")
    filing = F.when(F.col("is_announced"), "filing_value").when(F.col("is_known"), "first_observed").when(F.col("turn") == 1, "new_filing").otherwise("filing_value")
    later = F.substring("effective_at", 1, 10) > previous_day
    new_type = (
        F.when(F.col("year").isNotNull(), filing)
        .when(F.col("field").isin(*SETS) & both_complete, _lookup({f: n for f, (n, _) in SETS.items()}, F.col("field")))
        .when((F.col("family") == "hiring") & later, "new_job")
        .when((F.col("family") == "activity") & later, "new_publication")
        .when((F.col("field") == "employees") & F.col("had_none"), "changed_employee_count")
        .otherwise("first_observed")
    )
    changed = F.coalesce(_lookup(CHANGED, F.col("field")), F.when(F.col("family") == "financials", "changed_financials").otherwise("changed"))
    matched_type = F.when(F.col("field").isin(*FILINGS), F.when(F.size("added") > 0, "new_filing").otherwise("changed")).otherwise(changed)
    gone_type = F.when(F.col("field").isin(*SETS) & F.coalesce("is_complete", F.lit(False)), _lookup({f: r for f, (_, r) in SETS.items()}, F.col("field")))
    gone_type = F.coalesce(gone_type, F.when(_closed(F.col("previous_value")), "closed_job"))
    kind = F.when(F.col("status") == "new", new_type).when((F.col("status") == "matched") & ~F.col("same"), matched_type).when(F.col("status") == "gone", gone_type)
    typed = rows.withColumn("type", kind).where("type IS NOT NULL")
    return typed.select("id", "entity", "field", "family", "type", (~F.col("type").isin(*QUIET)).alias("material"), "previous_value", "current_value")


def _marked(rows: DataFrame, names: DataFrame | None, key: str, mark: str) -> DataFrame:
    """Rows with a flag that says whether their key is among the names."""
    if names is None:
        return rows.withColumn(mark, F.lit(False))
    named = names.select(key).distinct().withColumn(mark, F.lit(True))
    return rows.join(named, key, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def _closed(value: Column) -> Column:
    return F.coalesce((F.col("field") == "job_posting") & F.col("is_inactive") & (F.get_json_object(value, "$.status") == "active"), F.lit(False))


def carried_forward(before: DataFrame, after: DataFrame, inactive: DataFrame | None = None) -> DataFrame:
    """Facts of the new run and, marked stale with a reason, those of the old one that are gone without proof of removal.

    Proof is a complete check of a set, or a feed that shows a job ad as closed.
    """
    kept = _marked(before.join(after.select("id"), "id", "left_anti"), inactive, "key", "is_inactive")
    checked = after.groupBy("entity", "family").agg(F.max("complete").alias("is_complete"))
    with_check = kept.join(checked, ["entity", "family"], "left")
    unproven = with_check.where(~(F.col("field").isin(*SETS) & F.coalesce("is_complete", F.lit(False))) & ~_closed(F.col("value")))
    reason = F.when(F.col("is_complete"), "missing from the new run").when(F.col("is_complete").isNull(), "family absent from the new run").otherwise("family not checked completely")
    columns = after.columns
    fresh = after.withColumn("stale", F.lit(False)).withColumn("stale_reason", F.lit(None).cast("string"))
    return fresh.unionByName(unproven.select(*columns, F.lit(True).alias("stale"), reason.alias("stale_reason")))


def carried_times(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """``(id, first_observed_at, last_changed_at)`` of the new run's facts.

    A fact that was there before keeps when it was first observed; it changed when it
    was last observed if its value is another one now, else when it did before.  A
    new fact, and every fact of a first run, changed when it was first observed.
    Facts have ``id, digest, first_observed_at, last_changed_at, last_observed_at``.
    """
    old = (after.limit(0) if before is None else before).select("id", *[F.col(c).alias(f"old_{c}") for c in ("digest", "first_observed_at", "last_changed_at")], F.lit(True).alias("there"))
    both = after.join(old, "id", "left")
    same = F.coalesce(F.col("digest") == F.col("old_digest"), F.lit(False))
    changed = F.when(F.col("there").isNull(), F.col("first_observed_at")).when(same, F.coalesce("old_last_changed_at", "old_first_observed_at")).otherwise(F.col("last_observed_at"))
    first = F.when(F.col("there"), F.col("old_first_observed_at")).otherwise(F.col("first_observed_at"))
    return both.select("id", first.alias("first_observed_at"), changed.alias("last_changed_at"))


def check_previous(before: DataFrame, cutoff: str | None = None) -> None:
    """Refuses an earlier run that can't be compared: facts of no run, or, given a cutoff, observed after it.  Runs a job.

    ``before`` has ``id``, ``run_id`` and ``last_observed_at``.  The cutoff is an ISO instant with a zone.
    """
    late = F.lit(False)
    if cutoff is not None:
        at = datetime.fromisoformat(cutoff)
        if at.tzinfo is None:
            raise ValueError("a cutoff needs a time zone")
        late = F.col("last_observed_at") > F.lit(at)
    bad, after = before.agg(F.count_if(F.col("run_id").isNull() | F.col("id").isNull()), F.count_if(F.coalesce(late, F.lit(False)))).first()
    if bad:
        raise ValueError(f"{bad} facts of the earlier run name no run or have no id: it is no first run either")
    if after:
        raise ValueError(f"{after} facts of the earlier run were observed after the cutoff")
