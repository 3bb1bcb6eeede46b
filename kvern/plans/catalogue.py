"""The modules that hold queries, and the flagship among these."""

from kvern.plans import companies, extracts, feeds, records, registers, runs, texts

MODULES = [records, companies, runs, feeds, texts, extracts, registers]
FLAGSHIP = companies.QUERIES["screen_topn_revenue"]
