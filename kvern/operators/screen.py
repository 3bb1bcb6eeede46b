"""Screening questions in a closed grammar, turned into predicates over one row per company.

A question is cut into tokens; runs of words become symbols by the longest phrase of a
lexicon; productions read filters off the symbols from left to right.  A symbol that
no production takes is left over, and a plan with leftovers is not executable: no part
of a question is ever left out silently.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the grammar.
COMPARISONS = {
    "more than": ">", "over": ">", "above": ">", "greater than": ">", "at least": ">=",
    "fewer than": "<", "less than": "<", "under": "<", "below": "<", "at most": "<=",
}
FORMS = "asa as enk nuf ans da sa sti brl ba ks iks fli esek sam spa kf bbl".split()
SCALES = {"billion": 9, "bn": 9, "mrd": 9, "million": 6, "m": 6, "mill": 6, "mnok": 6}
FILLER = frozenset(
    """companies company firms firm businesses business organisations organizations entities show list find give get me all the a an with and
    or that which who are is in of for to have has having registered please whose their its norwegian norway norge located based where nok""".split()
)
UNSUPPORTED = (
    "sentiment", "glassdoor", "linkedin", "traffic", "review", "buzz", "popular", "fraud", "without a website", "no website", "velocity", "culture",
)
MEASURES = {"employee": "employees", "employees": "employees", "ansatte": "employees", "revenue": "revenue", "turnover": "revenue", "omsetning": "revenue"}
RESULTS = {"<": ("unprofitable", "loss making", "loss-making", "negative annual result"), ">": ("profitable", "positive annual result")}
OWNED = {"website": "website", "verified website": "website", "official website": "website", "accounts": "financials", "filed accounts": "financials", "annual accounts": "financials"}
OPENINGS = ("jobs", "job ads", "vacancies", "open jobs", "open job ads", "open vacancies")
SLOTS = ("municipality", "legal_form", "employees", "revenue", "annual_result", "website", "financials", "hiring", "industry")  # a plan's order
PLACE_ENDS = frozenset("with and having that where top sorted by".split())

_TOKEN = re.compile(r""" "[^"]*" | '[^']*' | [<>]=? | = | \d+(?:[.,]\d+)* | [^\W\d][\w'.-]* | [^\s\w] """, re.VERBOSE)


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: object


@dataclass
class Plan:
    query: str
    filters: list[Filter] = field(default_factory=list)
    sort: str | None = None
    limit: int | None = None
    unsupported: list[str] = field(default_factory=list)

    @property
    def executable(self) -> bool:
        return bool(self.filters or self.sort) and not self.unsupported


@dataclass(frozen=True)
class Symbol:
    kind: str
    text: str
    value: object = None


def _lexicon() -> dict[str, list[Symbol]]:
    """Phrases by their first word; longer ones first."""
    entries = [Symbol("compare", p, op) for p, op in COMPARISONS.items()]
    entries += [Symbol("measure", w, name) for w, name in MEASURES.items()]
    entries += [Symbol("flag", p, Filter("annual_result", op, 0)) for op, phrases in RESULTS.items() for p in phrases]
    entries += [Symbol("owned", p, Filter(name, "present", True)) for p, name in OWNED.items()]
    entries += [Symbol("owned", p, Filter("hiring", "present", True)) for p in OPENINGS]
    entries += [Symbol("flag", "hiring", Filter("hiring", "present", True))]
    entries += [Symbol("form", p) for p in ("form", "legal form", "organisation form", "organization form")]
    entries += [Symbol("place", p) for p in ("in", "located in", "municipality", "municipality is")]
    entries += [Symbol("have", w) for w in ("with", "has", "have", "having")]
    entries += [Symbol("trade", p) for p in ("industry", "industry contains", "industry is")]
    entries += [Symbol("top", "top"), Symbol("by", "by")]
    by_first: dict[str, list[Symbol]] = {}
    for e in sorted(entries, key=lambda e: -len(e.text)):
        by_first.setdefault(e.text.split()[0], []).append(e)
    return by_first


_LEXICON = _lexicon()


def symbols(question: str) -> list[Symbol]:
    """A question as symbols; digits in groups of three ("5 000 000") are one number."""
    tokens = _TOKEN.findall(question.lower())
    out: list[Symbol] = []
    i = 0
    while i < len(tokens):
        token = tokens[i]
        entry = next((e for e in _LEXICON.get(token, ()) if tokens[i : i + len(e.text.split())] == e.text.split()), None)
        if entry:
            out.append(entry)
            i += len(entry.text.split())
            continue
        if token[0] in "\"'":
            out.append(Symbol("quoted", token, token[1:-1]))
        elif token[0] in "<>=":
            out.append(Symbol("compare", token, token))
        elif token[0].isdigit():
            while i + 1 < len(tokens) and re.fullmatch(r"\d{3}", tokens[i + 1]) and re.fullmatch(r"\d{1,3}( \d{3})*", token):
                i += 1
                token += " " + tokens[i]
            out.append(Symbol("number", token, Decimal(token.replace(" ", "").replace(",", ".")) if len(re.findall("[.,]", token)) < 2 else None))
        elif token in SCALES:
            out.append(Symbol("scale", token, SCALES[token]))
        elif token[0].isalpha():
            out.append(Symbol("word", token))
        i += 1
    return out


class _Parse:
    """Left to right over symbols; each production takes some or none."""

    def __init__(self, plan: Plan, row: list[Symbol]):
        self.plan, self.row, self.at, self.left = plan, row, 0, []

    def kind(self, ahead: int = 0) -> str:
        return self.row[self.at + ahead].kind if self.at + ahead < len(self.row) else ""

    def skip(self, ahead: int, *words: str) -> int:
        while self.at + ahead < len(self.row) and self.row[self.at + ahead].text in words:
            ahead += 1
        return ahead

    def put(self, new: Filter, length: int) -> bool:
        """A slot is filled once: a second mention is left over."""
        if any(f.field == new.field for f in self.plan.filters):
            return False
        self.plan.filters.append(new)
        self.at += length
        return True

    def amount(self, ahead: int) -> tuple[Decimal | None, int]:
        ahead = self.skip(ahead, "nok")
        if self.kind(ahead) != "number" or self.row[self.at + ahead].value is None:
            return None, ahead
        value = self.row[self.at + ahead].value
        if self.kind(ahead + 1) == "scale":
            return value.scaleb(self.row[self.at + ahead + 1].value), ahead + 2
        return value, ahead + 1

    def _limit(self, name: str, operator: str, value: Decimal, length: int) -> bool:
        if name == "employees" and value != value.to_integral_value():
            return False
        return self.put(Filter(name, operator, int(value) if name == "employees" else value), length)

    def measured(self) -> bool:  # revenue over NOK 5 million
        if (self.kind(), self.kind(1)) != ("measure", "compare"):
            return False
        value, length = self.amount(2)
        return value is not None and self._limit(self.row[self.at].value, self.row[self.at + 1].value, value, length)

    def compared(self) -> bool:  # more than 5 million in revenue
        if self.kind() != "compare":
            return False
        value, length = self.amount(1)
        length = self.skip(length, "in", "registered")
        if value is None or self.kind(length) != "measure":
            return False
        return self._limit(self.row[self.at + length].value, self.row[self.at].value, value, length + 1)

    def ranked(self) -> bool:  # top 10 companies by revenue
        if (self.kind(), self.kind(1)) != ("top", "number") or self.plan.sort:
            return False
        length = self.skip(2, "companies")
        value = self.row[self.at + 1].value
        if self.kind(length) != "by" or self.kind(length + 1) != "measure" or value is None:
            return False
        self.plan.sort, self.plan.limit = self.row[self.at + length + 1].value, min(max(int(value), 1), 100)
        self.at += length + 2
        return True

    def flagged(self) -> bool:  # profitable
        return self.kind() == "flag" and self.put(self.row[self.at].value, 1)

    def owns(self) -> bool:  # with a verified website
        if self.kind() != "have":
            return False
        length = self.skip(1, "a", "an")
        return self.kind(length) == "owned" and self.put(self.row[self.at + length].value, length + 1)

    def formed(self) -> bool:  # legal form AS
        if self.kind() != "form":
            return False
        length = self.skip(1, "is", "=")
        code = self.row[self.at + length].text if self.kind(length) == "word" else ""
        return code in FORMS and self.put(Filter("legal_form", "eq", code.upper()), length + 1)

    def trades(self) -> bool:  # industry contains "bakeri"
        if self.kind() != "trade":
            return False
        length = self.skip(1, "=")
        return self.kind(length) == "quoted" and self.put(Filter("industry", "contains", self.row[self.at + length].value), length + 1)

    def placed(self) -> bool:  # in Nordre Land
        if self.kind() != "place":
            return False
        first = self.skip(1, "=")
        length = first
        while self.at + length < len(self.row) and self.row[self.at + length].text.split()[0] not in PLACE_ENDS and self.kind(length) not in ("compare", "quoted"):
            length += 1
        name = " ".join(s.text for s in self.row[self.at + first : self.at + length])
        if name in ("", "norway", "norge"):
            self.at += length
            return bool(name)
        return self.put(Filter("municipality", "eq", name.upper()), length)

    def filled(self) -> bool:
        if self.kind() in ("number", "compare", "have", "by", "quoted") or all(w in FILLER for w in self.row[self.at].text.split()):
            if self.kind() not in ("number",) and not all(w in FILLER for w in self.row[self.at].text.split()):
                self.left.append(self.row[self.at].text)
            self.at += 1
            return True
        return False

    def run(self) -> None:
        productions: list[Callable[[], bool]] = [self.measured, self.compared, self.ranked, self.flagged, self.owns, self.formed, self.trades, self.placed, self.filled]
        while self.at < len(self.row):
            if not any(p() for p in productions):
                self.left.append(self.row[self.at].text)
                self.at += 1


def parse(question: str) -> Plan:
    """The plan of a question, its filters in the order of the slots.  Each slot is filled at most once; a second mention is left over and so makes the plan not executable."""
    text = " ".join((question or "").split())
    plan = Plan(text, unsupported=sorted(t for t in UNSUPPORTED if t in text.lower()))
    reader = _Parse(plan, symbols(text))
    reader.run()
    plan.filters.sort(key=lambda f: SLOTS.index(f.field))
    if reader.left and not plan.unsupported:
        plan.unsupported.append("not in the grammar: " + " ".join(reader.left))
    return plan


def predicate(f: Filter) -> Column:
    """A filter as a condition that is false, never null, where the value is missing."""
    column = F.col(f.field)
    if f.operator == "eq":
        met = F.lower(column) == str(f.value).lower()
    elif f.operator == "contains":
        met = F.contains(F.lower(column), F.lit(str(f.value).lower()))
    elif f.operator == "present":
        met = column == F.lit(f.value)
    else:
        value = F.lit(f.value)
        met = {">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value, "=": column == value}[f.operator]
    return F.coalesce(met, F.lit(False))


def screen(companies: DataFrame, question: str) -> DataFrame:
    """Companies that meet all criteria, the best first or by number.  A question that is not executable gives no rows."""
    plan = parse(question)
    if not plan.executable:
        return companies.limit(0)
    met = companies.where(reduce(lambda a, b: a & b, map(predicate, plan.filters))) if plan.filters else companies
    if plan.sort:
        return met.orderBy(F.col(plan.sort).desc_nulls_last(), "org").limit(plan.limit)
    return met.orderBy("org")
