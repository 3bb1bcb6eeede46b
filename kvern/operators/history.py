"""Bitemporal history of facts: what held in which runs, and when that was on record.

Every delivery states an entity's facts for one run.  It is an update of the ledger:
valid for its run and, while nothing later is on record for the entity, taken to go on
for the run after that too.  The next run's delivery, or the run's end without one,
splits that period; a delivery that comes late splits what was recorded before it.
Nothing is overwritten: what is superseded keeps the period in which it was on
record.  A second sweep over each fact's runs joins consecutive runs with the same
value to versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvern.operators import snapshots
from kvern.session import Stage


def ledger(updates: DataFrame) -> DataFrame:
    """``(key, value, valid_from, valid_to, recorded_from, recorded_to)`` of updates ``(key, value, valid_from, valid_to, recorded_at)``.

    Periods are half open.  An update recorded later holds for its whole period from
    then on; what was recorded before for a part of it is split there and ends being
    current, but stays.  ``recorded_to`` is null for what is current.  Updates with a
    null or empty period or key are none; of updates recorded at one time for one
    part the one with the greater value holds.  The same update twice counts once.

    The sweep line: a key's period bounds cut time into elementary parts, numbered in
    order; an update is laid over its parts by number, each part's updates follow
    each other by recording time, and parts of one update that ended being current at
    the same time are joined again.  All joins are on equal keys.
    """
    sound = updates.where("key IS NOT NULL AND valid_from < valid_to AND recorded_at IS NOT NULL").distinct()
    bounds = sound.select("key", F.explode(F.array("valid_from", "valid_to")).alias("bound")).distinct()
    numbered = bounds.withColumn("part", F.row_number().over(Window.partitionBy("key").orderBy("bound")))
    first = numbered.select("key", F.col("bound").alias("valid_from"), F.col("part").alias("begins"))
    last = numbered.select("key", F.col("bound").alias("valid_to"), F.col("part").alias("ends"))
    placed = sound.join(first, ["key", "valid_from"]).join(last, ["key", "valid_to"])
    update = F.struct("recorded_at", "value", "begins", "ends")
    parts = placed.select("key", update.alias("u"), F.explode(F.sequence(F.col("begins"), F.col("ends") - 1)).alias("part"))
    following = Window.partitionBy("key", "part").orderBy("u")
    spans = parts.withColumn("until", F.lead("u.recorded_at").over(following)).where("until IS NULL OR until > u.recorded_at")
    run = Window.partitionBy("key", "u", "until").orderBy("part")
    islands = spans.withColumn("island", F.col("part") - F.row_number().over(run))
    joined = islands.groupBy("key", "u", "until", "island").agg(F.min("part").alias("a"), (F.max("part") + 1).alias("b"))
    from_ = numbered.select("key", F.col("part").alias("a"), F.col("bound").alias("valid_from"))
    to = numbered.select("key", F.col("part").alias("b"), F.col("bound").alias("valid_to"))
    return joined.join(from_, ["key", "a"]).join(to, ["key", "b"]).select(
        "key", F.col("u.value").alias("value"), "valid_from", "valid_to", F.col("u.recorded_at").alias("recorded_from"), F.col("until").alias("recorded_to")
    )


EARLIEST = "0001-01-01 00:00:00"  # when a delivery without a time counts as recorded


def updates(envelopes: DataFrame) -> DataFrame:
    """``(key, value, valid_from, valid_to, recorded_at)`` of deliveries: what ``ledger`` takes, a key per entity.

    ``value`` names the delivery: ``(run_no, told)``, with ``told`` false for a run that
    ended without a delivery for an entity of other runs.  Times are run numbers; a
    run's end is its ``completed_at``.  Only three columns are read, facts are not.
    """
    order = snapshots.run_order(envelopes)
    named = envelopes.where("organisation_number IS NOT NULL AND run.run_id IS NOT NULL")
    at = F.coalesce("received_at", F.lit(EARLIEST).cast("timestamp"))
    told = named.select(F.col("organisation_number").alias("key"), F.col("run.run_id").alias("run_id"), at.alias("recorded_at")).distinct().join(F.broadcast(order), "run_id")
    told = told.select("key", "run_no", "recorded_at", F.lit(True).alias("told"))
    ends = named.groupBy(F.col("run.run_id").alias("run_id")).agg(F.coalesce(F.max("run.completed_at"), F.lit(EARLIEST).cast("timestamp")).alias("recorded_at")).join(F.broadcast(order), "run_id").select("run_no", "recorded_at")
    runs = ends.agg(F.collect_set("run_no").alias("every"))  # one row, as many numbers as there are runs
    had = told.groupBy("key").agg(F.collect_set("run_no").alias("had"))
    silent = had.join(F.broadcast(runs)).select("key", F.explode(F.array_except("every", "had")).alias("run_no"))
    silent = silent.join(F.broadcast(ends), "run_no").select("key", "run_no", "recorded_at", F.lit(False).alias("told"))
    stated = told.unionByName(silent)
    so_far = Window.partitionBy("key").orderBy("recorded_at").rangeBetween(Window.unboundedPreceding, 0)
    in_time = F.col("told") & (F.max("run_no").over(so_far) == F.col("run_no"))
    to = F.col("run_no") + F.when(in_time, 2).otherwise(1)
    return stated.select("key", F.struct("run_no", "told").alias("value"), F.col("run_no").alias("valid_from"), to.alias("valid_to"), "recorded_at")


def _facts(envelopes: DataFrame, rows: DataFrame) -> DataFrame:
    """``(entity, id, run_no, digest, observed)`` of ledger rows, a row per fact and run they are valid for.

    Of deliveries with the same run, entity and time the one with the greatest ids and values holds.
    """
    heavy = snapshots.deliveries(envelopes, {"observed": "claims.last_observed_at"})
    heavy = heavy.withColumn("received_at", F.coalesce("received_at", F.lit(EARLIEST).cast("timestamp")))
    one = heavy.groupBy("entity", F.col("run_no").alias("source"), "received_at").agg(F.max(F.struct("ids", "digests", "observed")).alias("d"))
    valid = rows.where("value.told").select(
        F.col("key").alias("entity"), F.col("value.run_no").alias("source"), F.col("recorded_from").alias("received_at"),
        F.explode(F.sequence("valid_from", F.col("valid_to") - 1)).alias("run_no"),
    )
    there = one.join(valid, ["entity", "source", "received_at"]).select("entity", "run_no", "d.*")
    return snapshots.facts(there, {"digest": "digests", "observed": "observed"})


def versions(facts: DataFrame) -> DataFrame:
    """``(entity, id, digest, first_run, last_run, valid_from, valid_to)`` of facts per run.

    ``facts`` has one row per ``(entity, id, run_no)``.  The sweep takes a fact's
    runs in order: a version goes on where the run before is the one just before and
    had the same value.  ``valid_from`` and ``valid_to`` are the observation times in
    the first and the last run of a stretch, null where that run has none.
    """
    sweep = Window.partitionBy("entity", "id").orderBy("run_no")
    before = F.lag(F.struct("run_no", "digest")).over(sweep)
    goes_on = F.coalesce((before["run_no"] == F.col("run_no") - 1) & before["digest"].eqNullSafe(F.col("digest")), F.lit(False))
    marked = facts.withColumn("begins", F.when(goes_on, 0).otherwise(1))
    numbered = marked.withColumn("version", F.sum("begins").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("entity", "id", "version")
        .agg(
            F.first("digest").alias("digest"),
            F.min(F.struct("run_no", "observed")).alias("head"),
            F.max(F.struct("run_no", "observed")).alias("tail"),
        )
        .select(
            "entity",
            "id",
            "digest",
            F.col("head.run_no").alias("first_run"),
            F.col("tail.run_no").alias("last_run"),
            F.col("head.observed").alias("valid_from"),
            F.col("tail.observed").alias("valid_to"),
        )
    )


def _ended(envelopes: DataFrame, rows: DataFrame, at=None) -> DataFrame:
    """Ledger rows cut off after the last run, or the last one that had ended at an instant."""
    ends = envelopes.where("run.run_id IS NOT NULL").groupBy(F.col("run.run_id").alias("run_id")).agg(F.max("run.completed_at").alias("done"))
    ended = ends.join(F.broadcast(snapshots.run_order(envelopes)), "run_id")
    ended = ended if at is None else ended.where(F.coalesce(F.col("done") <= at, F.lit(True)))
    last = ended.agg(F.max("run_no").alias("last"))  # one row
    cut = rows.join(F.broadcast(last)).withColumn("valid_to", F.least("valid_to", F.col("last") + 1))
    return cut.where("valid_from < valid_to").drop("last")


def _ledger_of(envelopes: DataFrame) -> DataFrame:
    """The ledger of deliveries.  Runs a job: the updates are written, as the sweep reads them several times."""
    return ledger(Stage(envelopes.sparkSession, "history").write(updates(envelopes), "updates"))


def current_versions(envelopes: DataFrame) -> DataFrame:
    """The versions as now on record: by the ledger's rows that nothing superseded.  Runs a job."""
    now = _ledger_of(envelopes).where("recorded_to IS NULL")
    return versions(_facts(envelopes, _ended(envelopes, now)))


def versions_as_recorded(envelopes: DataFrame, at: str) -> DataFrame:
    """The versions as they were on record at an instant: by the ledger's rows recorded by then and not superseded by then.

    Of runs that had ended by then, one whose delivery was not yet recorded goes on as the run before it.
    """
    when = F.lit(at).cast("timestamp")
    then = _ledger_of(envelopes).where((F.col("recorded_from") <= when) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > when)))
    return versions(_facts(envelopes, _ended(envelopes, then, when)))
