"""What changed between full snapshots, from subtracted invertible Bloom lookup tables.

Each run's facts are spread over hash buckets and each bucket becomes a lookup
table, whose size follows the differences and not the facts: their share is estimated
first by the facts whose key hash falls into one of ``ESTIMATE`` classes, compared
row by row.  The tables of consecutive runs are subtracted and peeled; what comes out
are the pairs of key hash and digest that differ.  A bucket that can't be peeled whole
is built again with four times the cells; one that still fails after ``ATTEMPTS`` is
compared row by row.  The pairs found are joined back to the runs' facts, which verifies
them and names the facts; one side alone means added or removed, both sides changed.
A digest holds a second hash of the fact's name, so that two facts of one key hash stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.operators import iblt, snapshots
from kvern.session import Stage

BUCKET_ROWS = 16384  # facts of one run in a bucket
CELLS = 1.6  # cells of a first table per element that is expected to differ; peeling needs about 1.3
ESTIMATE = 64  # classes of key hashes of which one is compared to size the tables; results come from all facts
ATTEMPTS = 3

_TABLE = "bucket int, run_no int, rows bigint, cells binary"
_FOUND = "bucket int, run_no int, key bigint, digest bigint, side int, whole boolean"


def _cells(differing: float, attempt: int) -> int:
    """A multiple of the number of hashes, and of 4 ** attempt."""
    return iblt.HASHES * max(64, int(differing * CELLS / iblt.HASHES)) * 4**attempt


def _share(facts: DataFrame, runs: int) -> float:
    """About how many elements differ between two runs, per fact of a run: the most of all pairs, with a margin for the estimate's error."""
    some = facts.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(ESTIMATE)) == 0)
    differ = _row_by_row(some.withColumn("bucket", F.lit(0)), runs).groupBy("run_no").agg(F.count("*").alias("n"))
    most, seen = differ.agg(F.max("n")).first()[0] or 0, some.count()
    return min(2.0, (most + 3 * most**0.5 + 3) * runs / max(seen, 1))


def _build(attempt: int, differing: float):
    size = _cells(differing, attempt)

    def build(group: pa.Table) -> pa.Table:
        keys, digests = (group[c].to_numpy().view(np.uint64) for c in ("key", "digest"))
        cells = iblt.table(keys, digests, size)
        at = [pa.array([group[c][0].as_py()], t) for c, t in (("bucket", pa.int32()), ("run_no", pa.int32()))]
        return pa.table([*at, pa.array([len(keys)], pa.int64()), pa.array([cells.tobytes()], pa.binary())], names=["bucket", "run_no", "rows", "cells"])

    return build


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, run_no, later, earlier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sides = [np.frombuffer(x, dtype=np.uint64).reshape(4, -1) if x else None for x in (later, earlier)]
            like = next(s for s in sides if s is not None)
            a, b = (np.zeros_like(like) if s is None else s for s in sides)
            keys, digests, side, whole = iblt.peel(iblt.subtract(a, b))
            if not whole:  # one row tells that the bucket failed; what was found is dropped
                keys, digests, side = keys[:1] * 0, digests[:1] * 0, side[:1] * 0
                if not len(keys):
                    keys = digests = np.zeros(1, np.uint64)
                    side = np.zeros(1, np.int64)
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, bucket, np.int32)),
                    pa.array(np.full(n, run_no, np.int32)),
                    pa.array(keys.view(np.int64)),
                    pa.array(digests.view(np.int64)),
                    pa.array(side.astype(np.int32)),
                    pa.array(np.full(n, whole, bool)),
                ],
                names=["bucket", "run_no", "key", "digest", "side", "whole"],
            )


def _differences(facts: DataFrame, attempt: int, differing: float, runs: int) -> DataFrame:
    """What differs, by bucket and later run; a row with ``whole`` false for a bucket that failed."""
    tables = facts.select("bucket", "run_no", "key", "digest").groupBy("bucket", "run_no").applyInArrow(_build(attempt, differing), _TABLE)
    # a table is the later side of its own run and the earlier side of the next
    sides = tables.select(
        "bucket",
        F.explode(F.array(F.struct("run_no", F.lit(True).alias("later")), F.struct((F.col("run_no") + 1).alias("run_no"), F.lit(False).alias("later")))).alias("s"),
        "cells",
    ).where(F.col("s.run_no").between(1, runs - 1))
    pairs = sides.groupBy("bucket", "s.run_no").agg(
        F.max(F.when(F.col("s.later"), F.col("cells"))).alias("a"), F.max(F.when(~F.col("s.later"), F.col("cells"))).alias("b")
    )
    return pairs.mapInArrow(_peel, _FOUND)


def _row_by_row(facts: DataFrame, runs: int) -> DataFrame:
    """The exact way for buckets whose tables never came out whole."""
    sides = facts.select(
        "bucket",
        "key",
        "digest",
        F.explode(F.array(F.struct("run_no", F.lit(1).alias("side")), F.struct((F.col("run_no") + 1).alias("run_no"), F.lit(-1).alias("side")))).alias("s"),
    ).where(F.col("s.run_no").between(1, runs - 1))
    netted = sides.groupBy("bucket", "s.run_no", "key", "digest").agg(F.sum("s.side").cast("int").alias("side"))
    return netted.where("side <> 0").select("bucket", "run_no", "key", "digest", "side", F.lit(True).alias("whole"))


def snapshot_changes(envelopes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(run_id, entity, id, change_kind)``: a row per fact that differs between consecutive runs.

    ``run_id`` is the later run.  An entity without a delivery in a run has no facts
    there.  Which delivery holds, repeated ids and nulls: see ``snapshots``.  Values
    are compared by ``canonical``.  No runs or one run give no rows.  Runs jobs: the
    facts are counted to size the buckets, and buckets are built again until whole.
    """
    spark = envelopes.sparkSession
    stage = Stage(spark, "diff")
    held = snapshots.holding(snapshots.deliveries(envelopes), ["ids", "digests"])
    rows = snapshots.facts(held.drop("received_at"), {"digest": "digests"})
    named = F.xxhash64(F.lit("name"), "id", "entity")
    keyed = rows.select("run_no", "entity", "id", F.xxhash64("digest", named).alias("digest"), F.xxhash64("entity", "id").alias("key"))
    facts = stage.write(keyed, "facts")
    count, runs = facts.agg(F.count("*"), F.max("run_no") + 1).first()
    runs = max(runs or 0, _last_run(envelopes) + 1)
    # the fullest run isn't known; as many buckets as would hold the mean run, at most twice as full
    buckets = max(1, round(count / max(runs, 1) / bucket_rows))
    facts = facts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    fullest = count // max(runs, 1) // buckets + 1
    differing = fullest * _share(facts, runs)

    found: list[str] = []
    pending = facts
    for attempt in range(ATTEMPTS + 1):
        exact = attempt == ATTEMPTS
        step = _row_by_row(pending, runs) if exact else _differences(pending, attempt, differing, runs)
        found.append(f"found{attempt}")
        out = stage.write(step, found[-1])
        if exact or out.where("NOT whole").isEmpty():
            break
        failed = out.where("NOT whole").select("bucket").distinct()
        pending = facts.join(failed, "bucket", "left_semi")
    # a failed bucket is built again for all its runs, so what its other pairs gave is given again
    elements = stage.read(found, out).where("whole").select("bucket", "run_no", "key", "digest", "side").distinct()
    sides = elements.select(
        "key", "digest", F.col("run_no").alias("later"), (F.col("side") > 0).alias("now"), F.when(F.col("side") > 0, F.col("run_no")).otherwise(F.col("run_no") - 1).alias("run_no")
    )
    named = sides.join(facts.select("run_no", "key", "digest", "entity", "id"), ["run_no", "key", "digest"])
    by_fact = named.groupBy("later", "entity", "id").agg(F.bool_or("now").alias("now"), F.bool_or(~F.col("now")).alias("before"))
    kind = F.when(~F.col("before"), "added").when(~F.col("now"), "removed").otherwise("changed")
    return by_fact.select(F.col("later").alias("run_no"), "entity", "id", kind.alias("change_kind")).join(F.broadcast(snapshots.run_order(envelopes)), "run_no").select("run_id", "entity", "id", "change_kind")


def _last_run(envelopes: DataFrame) -> int:
    """The number of the last run: a run of empty deliveries removes everything."""
    return (envelopes.agg(F.count_distinct("run.run_id")).first()[0] or 0) - 1
