"""Dates as written by people and machines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names.
MONTHS = (
    ("januar", "january"), ("februar", "february"), ("mars", "march"), ("april",), ("mai", "may"), ("juni", "june"), ("juli", "july"),
    ("august",), ("september",), ("oktober", "october"), ("november",), ("desember", "december"),
)
_NAMES = "|".join(n for month in MONTHS for n in month)


def _month(name: Column) -> Column:
    number = F.create_map(*[x for i, month in enumerate(MONTHS, 1) for n in month for x in (F.lit(n), F.lit(i))])
    return F.try_element_at(number, F.lower(name))


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_date(text: Column) -> Column:
    """The date a text names: ISO, day.month.year, "3. mars 2024" or "March 3, 2024", tried in this order.

    Days that do not exist and years before 1990 are no dates.
    """
    iso = r"(?<![0-9])([0-9]{4})-([0-9]{2})-([0-9]{2})(?![0-9])"
    dotted = r"(?<![0-9])([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})(?![0-9])"
    written = rf"(?i)(?<![0-9])([0-9]{{1,2}})\.? ({_NAMES}) ([0-9]{{4}})(?![0-9])"
    american = rf"(?i)({_NAMES}) ([0-9]{{1,2}}), ([0-9]{{4}})(?![0-9])"
    tried = F.coalesce(
        _day(_part(text, iso, 1), _part(text, iso, 2), _part(text, iso, 3)),
        _day(_part(text, dotted, 3), _part(text, dotted, 2), _part(text, dotted, 1)),
        _day(_part(text, written, 3), _month(_part(text, written, 2)), _part(text, written, 1)),
        _day(_part(text, american, 3), _month(_part(text, american, 1)), _part(text, american, 2)),
    )
    return F.when(F.year(tried) >= 1990, tried)


def url_date(url: Column) -> Column:
    """The date in a URL path of the form /2024/03/05/."""
    at = r"/((?:19|20)[0-9]{2})/([0-9]{2})/([0-9]{2})(?:/|$)"
    return _day(_part(url, at, 1), _part(url, at, 2), _part(url, at, 3))


def age_in_years(born: Column, today: Column) -> Column:
    """Full years, a birthday that has not come yet not counted."""
    return F.floor(F.months_between(today, born) / 12).cast("int")


def instant(text: Column) -> Column:
    """A time with a zone; null where the zone is missing or the text is no time."""
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, text.try_cast("timestamp"))
