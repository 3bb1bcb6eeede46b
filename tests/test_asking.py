"""Questions asked of all companies."""

from kvern.plans import companies
from test_by_value import save


def test_every_company_is_asked(spark, tmp_path):
    facts = [("a", "registered_role", "leadership", "", '"x"'), ("b", "employees", "workforce", "", "3"), ("c", "job_posting", "hiring", "", "{}")]
    folder = save(spark, tmp_path, [facts], orgs=("1", "2", "3"))
    lead, staff, every, _ = companies.QUESTIONS
    asked = [(lead, "registered_role"), (staff, "employees"), *((every, f[1]) for f in facts)]
    got = sorted((r.entity, r.question, r.field) for r in companies.ask_topics(spark, folder).collect())
    assert got == sorted((org, q, f) for org in "123" for q, f in asked)
