"""Full snapshots of facts: the deliveries that hold, and each fact's digest.

Both the difference between snapshots and the history of facts start from the same
table: a row per run and entity, with the ids and value digests of its facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.functions.canonical import value_digests


def run_order(envelopes: DataFrame) -> DataFrame:
    """``(run_id, run_no)``: runs numbered from 0 by completion, then by id; a run without an id is none.

    There is a row per run, so the window without partitions sorts as many rows as
    there are runs, after an aggregation of the whole table.
    """
    runs = envelopes.where("run.run_id IS NOT NULL").groupBy(F.col("run.run_id").alias("run_id"))
    done = runs.agg(F.max("run.completed_at").alias("done"))
    numbered = F.expr("row_number() OVER (ORDER BY done, run_id) - 1").cast("int")
    return done.select("run_id", numbered.alias("run_no"))


def deliveries(envelopes: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """``(run_no, entity, received_at, ids, digests, ...)``, a row per delivery.

    ``extra`` adds arrays in step with ``ids``: names by fields of a claim.  Rows
    without an organisation number or a run are none.  Null claims are an empty
    set, and so is one without ids.  No other column is read.
    """
    arrays = {"ids": "claims.id", **(extra or {})}
    picked = envelopes.where("organisation_number IS NOT NULL AND run.run_id IS NOT NULL").select(
        F.col("run.run_id").alias("run_id"),
        F.col("organisation_number").alias("entity"),
        "received_at",
        *[F.col(path).alias(name) for name, path in arrays.items()],
        value_digests(F.col("claims.value")).alias("digests"),
    )
    return picked.join(run_order(envelopes), "run_id").drop("run_id")


def holding(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of several deliveries for one run and entity, the one received last.

    A delivery without a time counts as earliest; among equal times the one with
    the greatest ids and digests holds, so that repeated rows can't give two results.
    """
    fact = F.struct("received_at", *columns)
    return rows.groupBy("run_no", "entity").agg(F.max(fact).alias("d")).select("run_no", "entity", "d.*")


def facts(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A row per fact.  Of one id that a delivery repeats, the first holds; a null id is none.

    Only deliveries that do repeat an id look its first place up.
    """
    parts = F.arrays_zip("ids", *fields.values())
    repeats = F.size(F.array_distinct("ids")) < F.size("ids")
    keep = [c for c in rows.columns if c not in ("ids", *fields.values())]
    # before the arrays are taken apart: beside the generator it would be worked out for every element again
    whole = rows.select(*keep, F.when(repeats, F.col("ids")).alias("ids"), parts.alias("parts"))
    out = whole.select(*keep, "ids", F.posexplode("parts").alias("pos", "f"))
    out = out.where("f.ids IS NOT NULL AND (ids IS NULL OR array_position(ids, f.ids) = pos + 1)")
    return out.select(*keep, F.col("f.ids").alias("id"), *[F.col(f"f.{v}").alias(k) for k, v in fields.items()])
