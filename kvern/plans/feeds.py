"""Queries over change feeds: job ads and events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.functions import text
from kvern.operators import facts, hosts, ranking
from kvern.plans import tables
from kvern.plans.tables import table
from kvern.session import Stage
from kvern.sources import inputs, jobfeed
from kvern.streaming import feed

EVENT_LIMIT = 30
EDGE = "2026-07-01 00:00:00"


def feed_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    now = jobfeed.current_ads(table(spark, folder, "job_entries").select("uuid", "sistEndret", "received_at", "status"))
    return now.select("uuid", "status", F.unix_seconds("sistEndret").alias("changed"))


def feed_closed(spark: SparkSession, folder: str) -> DataFrame:
    return feed_latest_state(spark, folder).where("status <> 'ACTIVE'").select("uuid")


def feed_since_cursor(spark: SparkSession, folder: str) -> DataFrame:
    rows = jobfeed.changed_since(table(spark, folder, "job_entries"), F.lit(EDGE).cast("timestamp"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("uuid").alias("ads"))


def feed_nominate_default_active(spark: SparkSession, folder: str) -> DataFrame:
    """Every ad ever seen is on the index; states before an instant are what the live feed knows."""
    entries = table(spark, folder, "job_entries")
    index = entries.select("uuid").distinct()
    live = jobfeed.current_ads(entries.where(F.col("received_at") < F.lit(EDGE).cast("timestamp")).select("uuid", "sistEndret", "received_at", "status"))
    return jobfeed.nominated(index, live)


def ads_by_employer(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "job_entries")
    ads = entries.select("uuid", text.normal_name(F.col("ad_content.employer.name")).alias("employer"), F.to_date("ad_content.published").cast("string").alias("day"))
    return jobfeed.by_employer(ads.distinct())


def ads_of_registered(spark: SparkSession, folder: str) -> DataFrame:
    """Ads whose employer number is that of a registered firm or workplace."""
    entries = table(spark, folder, "job_entries").select("uuid", F.col("ad_content.employer.orgnr").alias("org")).where("org IS NOT NULL").distinct()
    units = table(spark, folder, "subunit_pages").select(F.explode("_embedded.underenheter").alias("u"))
    keys = units.select(F.col("u.overordnetEnhet").alias("org")).unionByName(units.select(F.col("u.organisasjonsnummer").alias("org")))
    return entries.join(keys, "org", "left_semi")


def ads_not_known(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "job_entries").select("uuid", "received_at")
    edge = F.lit(EDGE).cast("timestamp")
    return facts.known_before(entries.where(F.col("received_at") >= edge).select("uuid").distinct(), entries.where(F.col("received_at") < edge), ["uuid"])


def token_theta_join(spark: SparkSession, folder: str) -> DataFrame:
    """Employer labels that hold all tokens of a registered firm's name."""
    labels = table(spark, folder, "job_entries").select(F.col("ad_content.employer.name").alias("label"))
    names = table(spark, folder, "entities").select("organisasjonsnummer", "navn").distinct()
    return hosts.names_within(labels, "label", names, "navn", "organisasjonsnummer").distinct()


def newest_ten(spark: SparkSession, folder: str) -> DataFrame:
    """Ten newest ads of each employer."""
    ads = table(spark, folder, "job_entries").select(F.col("ad_content.employer.name").alias("employer"), "uuid", F.col("ad_content.published").alias("at")).where("employer IS NOT NULL").distinct()
    return ranking.top(ads, ["employer"], [F.col("at").desc_nulls_last(), F.col("uuid")], 10).select("employer", "uuid", "place")


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    ads = table(spark, folder, "job_entries").select("uuid", "status").distinct()
    return ranking.round_robin(ads, "status", [F.col("uuid")])


def running_budget(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return ranking.running(events, "user_id", [F.col("ts"), F.col("event_id")], F.lit(1), EVENT_LIMIT).select("event_id", "total", "admitted")


def context_of_two(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    return ranking.with_context(events, "user_id", [F.col("ts"), F.col("event_id")], "event_type", 2).select("event_id", F.replace("context", F.lit("\n"), F.lit(">")).alias("context"))


def runtime_p50_p95(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_quantity")
    middle = lines.agg(F.median("l_quantity").alias("p50"))
    return middle.crossJoin(F.broadcast(ranking.nearest_percentile(lines, "l_quantity", 0.95).withColumnRenamed("value", "p95")))  # one row each


def input_dedup_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Work per distinct customer, put back on each of its orders."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("org"))
    done = inputs.once_each(rows).join(table(spark, folder, "customer").select(F.col("c_custkey").alias("org"), "c_name"), "org")
    return inputs.back_to_entries(rows, done)


def inputs_listed(spark: SparkSession, folder: str) -> DataFrame:
    """A list of numbers written as rows with a header, and read as one of unknown form."""
    rows = table(spark, folder, "entities").select(F.col("navn"), F.col("organisasjonsnummer").alias("orgnr"))
    stage = Stage(spark, "inputs")
    rows.write.csv(stage.path("list"), sep=";", header=True, quoteAll=True)
    return inputs.read_inputs(spark, stage.path("list")).select("entry", "org", "valid")


def stream_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as ``feed_latest_state``, worked off as a stream."""
    stream = feed.read(spark, f"{folder}/job_entries.parquet")
    rows = feed.run_now(feed.latest_state(stream, "uuid", ["sistEndret", "received_at"], ["status"]), "update")
    return feed.settled(rows, "uuid").select("uuid", "status", F.unix_seconds("sistEndret").alias("changed"))


def stream_daily_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per closed day and type."""
    stream = feed.read(spark, f"{folder}/events.parquet")
    rows = feed.run_now(feed.daily(stream, "ts", "event_type", "1 hour"), "append")
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_upsert_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user, kept in keyed state."""
    stream = feed.read(spark, f"{folder}/events.parquet")
    keyed = stream.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("n"), F.col("event_type").alias("status"))
    rows = feed.settled(feed.run_now(feed.upserts(keyed), "update", rocksdb=True), "key")
    return rows.select(F.col("key").alias("user_id"), F.col("n").alias("event_id"), F.col("status").alias("event_type"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_latest_state, feed_closed, feed_since_cursor, feed_nominate_default_active, ads_by_employer, ads_of_registered, ads_not_known, token_theta_join,
        newest_ten, round_robin, running_budget, context_of_two, runtime_p50_p95, input_dedup_expand, inputs_listed, stream_latest_state, stream_daily_windows, stream_upsert_state,
    )
}

_STATE = "SELECT uuid, status, sistEndret, received_at FROM job_entries {0} QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY sistEndret DESC NULLS LAST, received_at DESC NULLS LAST, status DESC) = 1"
_LATEST = f"SELECT uuid, status, CAST(floor(epoch(sistEndret)) AS BIGINT) AS changed FROM ({_STATE.format('')})"
_NAME = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'))"
_FOLD = "replace(strip_accents(translate(lower({0}), 'øå', 'oa')), 'æ', 'ae')"
_SUFFIXES = tables.KINDS_SQL
ORACLES = {
    "feed_latest_state": _LATEST,
    "feed_closed": f"SELECT uuid FROM ({_LATEST}) WHERE status <> 'ACTIVE'",
    "feed_since_cursor": f"SELECT status, count(*) AS n, count(DISTINCT uuid) AS ads FROM job_entries WHERE received_at > TIMESTAMPTZ '{EDGE}+00' GROUP BY status",
    "feed_nominate_default_active": f"""WITH s AS ({_STATE.format(f"WHERE received_at < TIMESTAMPTZ '{EDGE}+00'")})
      SELECT DISTINCT j.uuid FROM job_entries j LEFT JOIN s ON s.uuid = j.uuid WHERE coalesce(s.status, 'ACTIVE') = 'ACTIVE'""",
    "ads_by_employer": f"""SELECT employer, count(*) AS ads, min(day) AS first_day, max(day) AS last_day FROM (
      SELECT DISTINCT uuid, {_NAME.format("ad_content.employer.name")} AS employer, strftime(ad_content.published, '%Y-%m-%d') AS day FROM job_entries) GROUP BY employer""",
    "ads_of_registered": """WITH u AS (SELECT unnest(_embedded.underenheter) AS u FROM subunit_pages)
      SELECT DISTINCT uuid, ad_content.employer.orgnr AS org FROM job_entries WHERE ad_content.employer.orgnr IN (SELECT u.overordnetEnhet FROM u UNION SELECT u.organisasjonsnummer FROM u)""",
    "ads_not_known": f"SELECT uuid FROM job_entries WHERE received_at >= TIMESTAMPTZ '{EDGE}+00' EXCEPT SELECT uuid FROM job_entries WHERE received_at < TIMESTAMPTZ '{EDGE}+00'",
    "token_theta_join": f"""WITH l AS (SELECT DISTINCT ad_content.employer.name AS label, regexp_extract_all({_FOLD.format("ad_content.employer.name")}, '[a-z0-9]+') AS hay FROM job_entries),
      n AS (SELECT DISTINCT organisasjonsnummer, regexp_extract_all({_FOLD.format("navn")}, '[a-z0-9]+') AS every FROM entities),
      d AS (SELECT organisasjonsnummer, CASE WHEN len(list_filter(every, lambda t: NOT list_contains({_SUFFIXES}, t))) > 0 THEN list_filter(every, lambda t: NOT list_contains({_SUFFIXES}, t)) ELSE every END AS needle FROM n)
      SELECT DISTINCT label, organisasjonsnummer FROM l, d WHERE len(needle) > 0 AND list_has_all(hay, needle)""",
    "newest_ten": """SELECT employer, uuid, CAST(row_number() OVER (PARTITION BY employer ORDER BY day DESC NULLS LAST, uuid) AS INT) AS place FROM (
      SELECT DISTINCT ad_content.employer.name AS employer, uuid, ad_content.published AS day FROM job_entries WHERE ad_content.employer.name IS NOT NULL)
      QUALIFY row_number() OVER (PARTITION BY employer ORDER BY day DESC NULLS LAST, uuid) <= 10""",
    "round_robin": "SELECT uuid, status, CAST(row_number() OVER (PARTITION BY status ORDER BY uuid) AS INT) AS turn FROM (SELECT DISTINCT uuid, status FROM job_entries)",
    "running_budget": f"SELECT event_id, count(*) OVER w AS total, count(*) OVER w <= {EVENT_LIMIT} AS admitted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "context_of_two": "SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), '>') AS context FROM events",
    "runtime_p50_p95": """WITH s AS (SELECT l_quantity AS q, row_number() OVER (ORDER BY l_quantity) - 1 AS i, count(*) OVER () AS n FROM lineitem WHERE l_quantity IS NOT NULL)
      SELECT (SELECT median(l_quantity) FROM lineitem) AS p50, (SELECT q FROM s WHERE i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))) AS p95""",
    "inputs_listed": "SELECT organisasjonsnummer AS entry, organisasjonsnummer AS org, true AS valid FROM entities WHERE organisasjonsnummer IS NOT NULL",
    "input_dedup_expand": "SELECT o_custkey AS org, o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "stream_latest_state": _LATEST,
    "stream_daily_windows": """SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n FROM (SELECT date_trunc('day', ts) AS d, event_type, count(*) AS n FROM events GROUP BY ALL)
      WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_upsert_state": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
