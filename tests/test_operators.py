from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kvern.operators import facts, hosts, ranking, refresh, robots, screen
from kvern.operators.screen import Filter, parse


@pytest.mark.parametrize(
    "question, filters",
    [
        ("companies in Oslo with more than 20 employees", [("municipality", "eq", "OSLO"), ("employees", ">", 20)]),
        ("firms with revenue above 1.5 million", [("revenue", ">", 1_500_000)]),
        ("AS companies with legal form as", None),
        ("legal form ASA and at most 5 employees", [("legal_form", "eq", "ASA"), ("employees", "<=", 5)]),
        ("unprofitable companies", [("annual_result", "<", 0)]),
        ("profitable companies that have a website", [("annual_result", ">", 0), ("website", "present", True)]),
        ('companies with industry "bygg" hiring', [("hiring", "present", True), ("industry", "contains", "bygg")]),
        ("less than 100 mnok turnover", [("revenue", "<", 100_000_000)]),
        ("revenue above 1 million and revenue below 5 million", None), ("companies with good culture", None), ("happy companies", None), ("", None), ("companies without a website", None),
        ("revenue over 1,000,000", None), ("firms in Bergen with employees > 12", [("municipality", "eq", "BERGEN"), ("employees", ">", 12)]), ("legal form = KS", [("legal_form", "eq", "KS")]),
        ("organisation form is IKS", [("legal_form", "eq", "IKS")]), ("companies with revenue >= NOK 40 million", [("revenue", ">=", 40_000_000)]),
        ("companies with less than 3 million revenue", [("revenue", "<", 3_000_000)]), ("turnover under nok 5 000 000", [("revenue", "<", 5_000_000)]),
        ("more than 2 bn in revenue located in Nordre Land", [("municipality", "eq", "NORDRE LAND"), ("revenue", ">", 2_000_000_000)]),
        ("rank firms by LinkedIn growth", None), ("who has the best Glassdoor score", None), ("more than 5", None), ("loss-making firms in Norway", [("annual_result", "<", 0)]),
    ],
)
def test_plans(question, filters):
    plan = parse(question)
    assert plan.executable is (filters is not None)
    if filters is not None:
        assert plan.filters == [Filter(*f) for f in filters]


def test_top_is_clamped():
    assert parse("top 500 companies by revenue").limit == 100 and parse("top 0 by employees").limit == 1


def test_missing_is_never_small(spark):
    schema = "org string, revenue decimal(38,6), employees int, municipality string"
    rows = spark.createDataFrame([("C", None, None, None), ("A", Decimal(5), 1, "OSLO"), ("B", Decimal(9), 2, "oslo")], schema)
    got = lambda q: [r.org for r in screen.screen(rows, q).collect()]
    assert got("revenue below 100") == ["A", "B"] and got("top 3 by revenue") == ["B", "A", "C"]
    assert got("companies in oslo") == ["A", "B"] and got("dull companies") == []


def test_order_operators(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 3, 7), (None, 4, 1)], "k string, n int, v int")
    assert {(r.k, r.n) for r in ranking.best(rows, ["k"], [F.col("v").desc_nulls_last()]).collect()} == {("a", 1), ("b", 3), (None, 4)}
    assert {(r.k, r.n) for r in ranking.latest(rows, ["k"], ["n"]).collect()} == {("a", 2), ("b", 3), (None, 4)}
    assert sorted((r.n, r.total, r.admitted) for r in ranking.running(rows, "k", [F.col("n")], F.col("v"), 4).collect()) == [(1, 5, False), (2, 5, False), (3, 7, False), (4, 1, True)]
    many = spark.range(103).select(F.col("id"), (F.col("id") % 7).alias("m"))
    chunks = ranking.chunked(many, [F.col("m"), F.col("id")], 25, parts=5).orderBy("m", "id").collect()
    assert [r.chunk for r in chunks] == [i // 25 for i in range(103)]
    assert ranking.nearest_percentile(spark.range(100), "id", 0.95).first().value == 95
    assert ranking.nearest_percentile(spark.range(0), "id", 0.95).first().value is None
    assert {tuple(r) for r in ranking.fixed_histogram(rows, "k", ["a", "z"]).collect()} == {("a", 2), ("z", 0)}


def test_facts(spark):
    rows = spark.createDataFrame([("x", "1", 1), ("x", "2", 2), ("y", None, 1), ("y", "3", 0)], "id string, value string, seq int")
    assert {(r.id, r.value, r.conflicts) for r in facts.first_wins(rows, [F.col("seq")]).collect()} == {("x", "1", 1), ("y", "3", 0)}
    cited = spark.createDataFrame([("x", ["no", "e2", "e1"]), ("y", ["no"]), ("z", None)], "id string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("e1", "u1"), ("e2", "u2")], "evidence_id string, url string")
    assert {(r.id, r.url) for r in facts.first_citation(cited, evidence).collect()} == {("x", "u2"), ("y", None), ("z", None)}


FACT = "id string, entity string, field string, family string, key string, value string, digest bigint, effective_at string, complete boolean"


def fact(id, field, family, value, key="", complete=True, effective=None, entity="e"):
    return (id, entity, field, family, key, value, hash(value) % 1000, effective, complete)


def types(spark, before, after):
    frames = [spark.createDataFrame(rows, FACT) for rows in (before, after)]
    return {(r.id, r.type) for r in refresh.typed_changes(*frames, previous_day="2026-05-06").collect()}, frames


def test_typed_changes(spark):
    before = [fact("n", "legal_name", "identity", "A"), fact("r1", "registered_role", "leadership", "x"), fact("w1", "registered_workplace", "locations", "x", complete=False), fact("s", "employees", "workforce", "1"), fact("f0", "financial_revenue", "financials", "1", "2023-01-01:2023-12-31:S"), fact("y", "filing_years", "history", '["2023"]')]
    after = [fact("n", "legal_name", "identity", "B"), fact("r2", "registered_role", "leadership", "y"), fact("w2", "registered_workplace", "locations", "y"), fact("s", "employees", "workforce", "1"), fact("f0", "financial_revenue", "financials", "1", "2023-01-01:2023-12-31:S"), fact("f1", "financial_revenue", "financials", "2", "2024-01-01:2024-12-31:S"), fact("f2", "financial_assets", "financials", "3", "2024-01-01:2024-12-31:S"), fact("y", "filing_years", "history", '["2023", "2024"]'), fact("j", "job_posting", "hiring", "z", effective="2026-05-20"), fact("j0", "job_posting", "hiring", "z", effective="2026-05-01")]
    got, frames = types(spark, before, after)
    assert got == {("n", "changed_name"), ("r1", "removed_role"), ("r2", "new_role"), ("w1", "removed_location"), ("w2", "first_observed"), ("f1", "filing_value"), ("f2", "filing_value"), ("y", "new_filing"), ("j", "new_job"), ("j0", "first_observed")}
    assert refresh.carried_forward(*frames).where("stale").count() == 0


def test_filing_announced_once_by_its_figures(spark):
    before = [fact("f0", "financial_revenue", "financials", "1", "2023-01-01:2023-12-31:S")]
    after = [*before, fact("f1", "financial_revenue", "financials", "2", "2024-01-01:2024-12-31:S"), fact("f2", "financial_assets", "financials", "3", "2024-01-01:2024-12-31:S")]
    assert types(spark, before, after)[0] == {("f1", "new_filing"), ("f2", "filing_value")}
    assert types(spark, [], [])[0] == set() and types(spark, [], after[:1])[0] == {("f0", "first_observed")}


def test_gone_without_proof_is_carried_on_as_stale(spark):
    before = [fact("r1", "registered_role", "leadership", "x"), fact("d", "business_description", "description", "x")]
    after = [fact("r2", "registered_role", "leadership", "y", complete=False)]
    got, frames = types(spark, before, after)
    assert ("r1", "removed_role") not in got
    assert {r.id for r in refresh.carried_forward(*frames).where("stale").collect()} == {"r1", "d"}


def test_hosts_under_domains_and_names_within_labels(spark):
    pages = spark.createDataFrame([(1, "https://a.firma.example/x"), (2, "https://otherfirma.example"), (3, None)], "id int, url string")
    domains = spark.createDataFrame([("firma.example",), ("example",)], "domain string")
    assert {(r.id, r.domain) for r in hosts.under_domains(pages, "url", domains).collect()} == {(1, "firma.example"), (2, "example")}
    labels = spark.createDataFrame([("Solvik Hotell avd Bu",), ("Hotell Nord",), (None,)], "label string")
    names = spark.createDataFrame([("1", "SOLVIK HOTELL AS"), ("2", "Nord AS"), ("3", None)], "org string, name string")
    assert {tuple(r) for r in hosts.names_within(labels, "label", names, "name", "org").collect()} == {("Solvik Hotell avd Bu", "1"), ("Hotell Nord", "2")}


def test_robots(spark):
    body = "# c\nUser-agent: a\nUser-agent: b\nDisallow: /x # no\nAllow: /x/y\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /*.pdf$\nDisallow:\n"
    rules = spark.createDataFrame([("s", body)], "site string, body string").select("site", F.explode(robots.parse_robots("body")).alias("r")).select("site", "r.*")
    paths = spark.createDataFrame([("s", p) for p in ("/x", "/x/y", "/z.pdf", "/z.pdf?1", "/ok")] + [("t", "/x")], "site string, path string")
    allowed = lambda agent: {r.path for r in robots.decide(paths, rules, agent).where("site = 's' AND allowed").collect()}
    assert allowed("b") == {"/x/y", "/z.pdf", "/z.pdf?1", "/ok"} and allowed("c") == {"/x", "/x/y", "/z.pdf?1", "/ok"}
