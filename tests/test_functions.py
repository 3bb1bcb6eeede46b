import datetime as dt

import pytest
from pyspark.sql import functions as F

from kvern.functions import dates, identifiers, money, pointers, text


def values(spark, kind, rows, expression):
    frame = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in frame.select(expression(F.col("x"))).collect()]


def test_check_digits(spark):
    rows = ["923609016", "990 888 213", "984.862.296", "923609017", "12345678", "", None, "92360901x"]
    assert values(spark, "string", rows, identifiers.is_org_number) == [True, True, True, False, False, False, False, False]
    assert values(spark, "string", rows[:4], identifiers.org_number) == ["923609016", "990888213", "984862296", None]


def test_numbers_in_a_text(spark):
    rows = ["Org.nr. 923 609 016 og 1923609016, 984862296 984862296", None, ""]
    assert values(spark, "string", rows, identifiers.org_mentions) == [["923609016", "984862296"], None, []]


def test_amounts(spark):
    rows = ["-1234567.00", "2500000.50", "0.4", None]
    amount = lambda c: money.whole_units(money.amount(c))
    assert values(spark, "string", rows, amount) == ["-1 234 567", "2 500 001", "0", None]
    assert values(spark, "string", ["1234567890123456.780", "-0.00", "100", "1.50", "x", None], money.plain_amount) == ["1234567890123456.78", "0", "100", "1.5", "x", None]


def test_hosts_and_domains(spark):
    rows = ["https://www.Firma.example/om?x=1", "firma.co.uk", "http://a.b.firma.kommune.no:80/", "HTTPS://X.COM/navn", "", None]
    assert values(spark, "string", rows, text.host) == ["firma.example", "firma.co.uk", "a.b.firma.kommune.no", "x.com", None, None]
    assert values(spark, "string", rows, text.registered_domain) == ["firma.example", "firma.co.uk", "firma.kommune.no", "x.com", None, None]
    assert values(spark, "string", rows, text.network) == [None, None, None, "x", None, None]


def test_names(spark):
    assert values(spark, "string", ["ÆRØ Bygg AS", "AS", "Café Ñandú"], lambda c: F.array_join(text.name_tokens(c), " ")) == ["aero bygg", "as", "cafe nandu"]
    assert values(spark, "string", ["Storgt. 5", "Storgata 5", "Bakkevn 2", "Åsv 1"], text.street) == ["storgt 5", "storgata 5", "bakkevn 2", "asv 1"]
    assert values(spark, "string", ["Store gt. 5", "Nye vn 2"], text.street) == ["store gate 5", "nye veien 2"]


def test_written_dates(spark):
    rows = ["2024-03-05", "Publisert 5.3.2024", "5. mars 2024 kl 12", "March 5, 2024", "31.02.2024", "1.1.1980", None, "nr 2024-13-01"]
    day = dt.date(2024, 3, 5)
    assert values(spark, "string", rows, dates.first_date) == [day, day, day, day, None, None, None, None]
    assert values(spark, "string", ["https://x.no/2024/03/05/sak", "https://x.no/2024/13/05/"], dates.url_date) == [day, None]


def test_times_need_a_zone(spark):
    rows = ["2026-01-05T00:00:00Z", "2026-01-05T01:00:00+01:00", "2026-01-05T00:00:00", "x"]
    assert values(spark, "string", rows, lambda c: F.unix_seconds(dates.instant(c))) == [1767571200, 1767571200, None, None]


@pytest.mark.parametrize("pointer, path", [("", "$"), ("/a~1b/0", "$['a/b'][0]"), ("/a~0c", "$['a~c']"), ("/00", "$['00']")])
def test_pointer_paths(pointer, path):
    assert pointers.variant_path(pointer) == path


def test_pointer_values(spark):
    rows = ['{"a": {"b/c": [1, {"d": "x"}]}, "n": 1234567890123456.78}', "{}", "no json", None]
    assert values(spark, "string", rows, lambda c: pointers.at(c, "/a/b~1c/1/d")) == ["x", None, None, None]
    assert str(values(spark, "string", rows[:1], lambda c: pointers.at(c, "/n", "decimal(18,2)"))[0]) == "1234567890123456.78"
