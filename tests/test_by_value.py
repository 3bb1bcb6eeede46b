"""Runs compared by value, where SQL compares texts: brute force over values whose equality is known as they are made."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F


from kvern.operators import refresh
from kvern.plans import extracts, runs

SCHEMA = (
    "organisation_number string, run struct<run_id:string,completed_at:timestamp>, received_at timestamp, "
    "claims array<struct<id:string,field:string,family:string,key:string,value:string,availability:string,evidence_ids:array<string>,"
    "effective_at:string,first_observed_at:timestamp,last_changed_at:timestamp,last_observed_at:timestamp,stale:boolean,scope:string>>"
)
DAY = dt.datetime(2026, 1, 1)
#: Spellings of one value are in one row.
VALUES = [
    ["7", "7.0", '"7.00"', "70e-1"], ['{"amount":"10.50","currency":"NOK"}', '{ "currency": "NOK", "amount": 10.5 }'],
    ['["2024", "2023"]', '["2023","2024"]'], ['"f\\u00f8r"', '"før"'], ['["2024", "2023", "2025"]', '["2025","2024","2023"]'], [None, "null"],
]


def save(spark, folder, runs_of_claims, orgs=("1",)):
    """A folder of envelopes, one per run and organisation, with claims (id, field, family, key, value)."""
    rows = [
        (org, (f"r{n}", DAY + dt.timedelta(days=n)), DAY + dt.timedelta(days=n), [(*c, "available", ["e"], None, DAY, None, DAY + dt.timedelta(days=n), False, "legal_entity") for c in claims])
        for n, claims in enumerate(runs_of_claims) for org in orgs
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/envelopes.parquet")
    ads = "uuid string, status string, sistEndret timestamp, received_at timestamp"
    spark.createDataFrame([("ad1", "INACTIVE", DAY, DAY), ("ad2", "ACTIVE", DAY, DAY)], ads).write.parquet(f"{folder}/job_entries.parquet")
    place = "struct<kommune:string,postnummer:string,poststed:string>"
    firms = f"""organisasjonsnummer string, navn string, organisasjonsform struct<kode:string>, forretningsadresse {place}, naeringskode1 struct<kode:string,beskrivelse:string>,
      antallAnsatte int, harRegistrertAntallAnsatte boolean, hjemmeside string, telefon string, mobil string, epostadresse string, stiftelsesdato date, retrieved_at timestamp"""
    spark.createDataFrame([("9", *[None] * 5, False, *[None] * 5, DAY)], firms).write.parquet(f"{folder}/entities.parquet")
    return str(folder)


def spelled(rnd, held):
    return [(i, "filing_years" if v in (2, 4) else "industry", "identity", "", rnd.choice(VALUES[v])) for i, v in held.items()]


@pytest.mark.parametrize("seed", range(2))
def test_other_spellings_are_no_changes(spark, tmp_path, seed):
    rnd = random.Random(seed)
    old = {f"c{k}": rnd.randrange(len(VALUES)) for k in range(60)}
    new = {i: (v if rnd.random() < 0.7 else {2: 4, 4: 2}.get(v, (v + 1) % 2)) for i, v in old.items() if rnd.random() < 0.9} | {"n1": 0, "n2": 2}
    folder = save(spark, tmp_path, [spelled(rnd, old), spelled(rnd, new)])
    status = {i: "gone" if i not in new else "new" if i not in old else "same" if old[i] == new[i] else "matched" for i in old | new}
    assert {r.id: r.status for r in runs.refresh_full_diff(spark, folder).collect()} == status
    changed = {i for i, s in status.items() if s == "matched"}
    typed = runs.refresh_typed_changes(spark, folder).collect()
    assert {r.id for r in typed if r.type != "first_observed"} == changed
    assert {r.id for r in typed if r.type == "new_filing"} == {i for i in changed if (old[i], new[i]) == (2, 4)}
    assert sum(r.n for r in runs.changes_by_type(spark, folder).collect()) == len(typed)
    filings = {r.type: r.n for r in runs.refresh_new_filing_once(spark, folder).collect()}
    assert filings.get("new_filing", 0) == sum(r.type == "new_filing" for r in typed)
    seen = extracts.value_before(spark, folder).collect()
    # a field belongs to an id's value, and ids keep to theirs
    assert sum(r.changed for r in seen) == len(changed) and sum(r.seen_before for r in seen) == len(old.keys() & new.keys())


def test_closed_ads_first_employees_and_carried_times(spark, tmp_path):
    job = '{"title":"kokk","status":"active"}'
    old = [("j1", "job_posting", "hiring", "ad1", job), ("j2", "job_posting", "hiring", "ad2", job), ("n", "legal_name", "identity", "", '"A"'), ("k", "industry", "identity", "", "1")]
    new = [("n", "legal_name", "identity", "", '"B"'), ("k", "industry", "identity", "", "1.0"), ("e", "employees", "workforce", "", "3")]
    folder = save(spark, tmp_path, [old, new], orgs=("9",))
    typed = {r.id: r.type for r in runs.refresh_typed_changes(spark, folder).collect()}
    assert typed == {"j1": "closed_job", "n": "changed_name", "e": "changed_employee_count"}
    carried = {r.id: (r.stale, r.stale_reason) for r in runs.refresh_stale_carry_forward(spark, folder).collect()}
    assert carried == {"j2": (True, "family absent from the new run"), "n": (False, None), "k": (False, None), "e": (False, None)}
    day = int(DAY.replace(tzinfo=dt.timezone.utc).timestamp())
    times = {r.id: (r.first_observed - day, r.last_changed - day) for r in runs.refresh_times(spark, folder).collect()}
    assert times == {"n": (0, 86400), "k": (0, 0), "e": (0, 0)}


def test_first_runs_and_runs_that_cannot_be_compared(spark):
    schema = "id string, entity string, field string, family string, key string, value string, digest bigint, effective_at string, complete boolean, run_id string, last_observed_at timestamp, first_observed_at timestamp, last_changed_at timestamp"
    rows = [("a", "1", "legal_name", "identity", "", "1", 1, None, True, "r", DAY, DAY, None)]
    frame = spark.createDataFrame(rows, schema)
    assert refresh.typed_changes(None, frame).count() == 0
    assert refresh.carried_times(None, frame).first().last_changed_at == DAY
    refresh.check_previous(frame, "2026-01-02T00:00:00+00:00")
    for bad, cutoff in ((frame.withColumn("run_id", F.lit(None).cast("string")), None), (frame, "2025-12-31T00:00:00+00:00"), (frame, "2026-01-02T00:00:00")):
        with pytest.raises(ValueError):
            refresh.check_previous(bad, cutoff)
