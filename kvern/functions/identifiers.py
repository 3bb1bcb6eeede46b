"""Organisation numbers, content digests and ids made from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the modulus-11 check digit.
WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)


def bare_org(column: Column) -> Column:
    """Digits of a number written with blanks, dots or hyphens."""
    return F.regexp_replace(column, r"[\s\x{A0}.\-]+", "")


def is_org_number(column: Column) -> Column:
    """Nine digits with a valid check digit; false for null.  A remainder that would need the digit 10 is invalid."""
    digits = F.split(bare_org(column), "")
    weights = F.array(*map(F.lit, WEIGHTS))
    products = F.zip_with(F.slice(digits, 1, 8), weights, lambda d, w: d.cast("int") * w)
    rest = (F.lit(11) - F.aggregate(products, F.lit(0), lambda a, x: a + x) % 11) % 11
    well_formed = F.coalesce(bare_org(column).rlike("^[0-9]{9}$"), F.lit(False))
    return F.when(well_formed, (rest != 10) & (rest == digits[8].cast("int"))).otherwise(F.lit(False))


def org_number(column: Column) -> Column:
    """The nine digits, or null where they are no valid number."""
    return F.when(is_org_number(column), bare_org(column))


def content_id(prefix: str, *parts: Column) -> Column:
    """A short id over the JSON list of the parts: equal content gives equal ids, a null part is written as null."""
    text = F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 24))


def org_mentions(text: Column) -> Column:
    """Valid numbers that stand in a text as three groups of three digits, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{3}[ .\x{A0}]?[0-9]{3}[ .\x{A0}]?[0-9]{3})(?![0-9])"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, bare_org), is_org_number))


#: Words that label an organisation number.
LABELS = r"(?:org\.? ?(?:nr|nummer)\.?|organisasjonsnummer|foretaksnummer|organi[sz]ation (?:number|no\.?)|reg\. no\.?|MVA|VAT(?: no\.?| number)?)"


def labelled_numbers(text: Column) -> Column:
    """Valid numbers that a text calls an organisation number, each once, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i){LABELS}\s*[:#-]?\s*(?:NO\s*)?([0-9]{{3}}[ .\x{{A0}}]?[0-9]{{3}}[ .\x{{A0}}]?[0-9]{{3}})(?![0-9])"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, bare_org), is_org_number))
