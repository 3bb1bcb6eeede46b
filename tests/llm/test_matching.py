import datetime as dt

from kvern.llm import matching

AT = dt.datetime(2026, 1, 1)
PAGES = (
    "record_id bigint, requested_org string, retrieved_at timestamp, _embedded struct<underenheter:array<struct<organisasjonsnummer:string,navn:string,"
    "overordnetEnhet:string,beliggenhetsadresse:struct<poststed:string,kommune:string>,epostadresse:string,hjemmeside:string>>>, uuid string"
)
ADS = (
    "uuid string, sistEndret timestamp, received_at timestamp, ad_content struct<title:string,employer:struct<orgnr:string,name:string,homepage:string>,"
    "workLocations:array<struct<city:string,municipal:string>>,contactList:array<struct<title:string,email:string,phone:string>>>, org string"
)


def unit(org, name, firm, town, mail=None, site=None):
    return (org, name, firm, (town, town), mail, site)


UNITS = [
    unit("1", "FJELLBAKER BAKERI AS AVD. BU", "F", "BU", None, "https://fjellbaker.example/"), unit("2", "Fjellbaker Bakeri avd Å", "F", "ÅS", "as@fjellbaker.example"),
    unit("3", "SOLVIK HOTELL", "S", "BU"), unit("4", "NORDLYS DATA AS", "N", "ÅS", "nordlys@post.test", None), unit("5", "Kvitnes Elektro", "K", "BU", "kvitnes@post.test"),
    unit("6", "FJELLBAKER RØR", "R", "VIK"), unit("7", "Tangen Frisør", "T", "VIK", None, "tangen.example"), unit(None, "Uten nummer", "X", "BU"), None,
]


def ad(uuid, name, site=None, city=None, mail=None, org=None, hours=0, area=None):
    return (uuid, AT, AT + dt.timedelta(hours=hours), ("t", (org, name, site), [(city, area)] if city or area else None, [("HR", mail, None)] if mail else None), "clash")


CASES = [
    (ad("site", "Noe helt annet", "http://www.FJELLBAKER.example/jobb", "bu"), "1"), (ad("mail", "X", None, "Ås", "mailto:jobb@Fjellbaker.example"), "2"),
    (ad("other town", "Fjellbaker Bakeri", "fjellbaker.example", "Vik"), None), (ad("name", "solvik hotell AS, Bu", None, "1234 BU"), "3"), (ad("order", "Hotell Solvik", None, "Bu"), "3"),
    (ad("slip", "Slovik Hotell", None, "Bu"), "3"), (ad("short", "S. Hotell", None, "Bu"), "3"), (ad("inside", "Hotellhuset Solvik", None, "Bu"), "3"), (ad("own site", "Solvik Hotell2", "solvik-bu.example", "Bu"), None),
    (ad("provider", "Data", None, "Ås", "nordlys@post.test"), "4"), (ad("person", "Ukjent", None, "Ås", "ola@post.test"), None), (ad("no town", "Tangen Frisør", "https://karriere.tangen.example/x"), "7"),
    (ad("step", "Fjellbaker Bakeri", "fjellbaker.example/as"), "2"), (ad("lookalike", "Nordlysheim Data", None, "Ås"), None), (ad("nothing", None), None), (ad("first", "Fjellbaker", None, "Vik"), "6"),
    (ad("two firms", "Fjellbaker Bakeri", None, "Bu"), "1"), (ad("board", "Kvitnes", "https://jobbside.example/kvitnes", "Bu"), "5"), (ad("wrong place", "Solvik Hotell", None, "Ås"), None),
]


def run(spark, units, cases):
    pages = [(1, "F", AT, (units,), "clash"), (2, "F", AT - dt.timedelta(days=1), ([unit("3", "GAMMELT NAVN", "S", "VIK")],), "clash"), (3, None, None, None, None)]
    board = [ad(f"b{k}", f"Firma {k} AS", f"https://jobbside.example/firma{k}", "Oslo") for k in range(12)]
    return matching.match(spark.createDataFrame(pages, PAGES), spark.createDataFrame(cases + board, ADS))


def test_each_rule_finds_its_cases_and_lookalikes_are_left(spark):
    out = run(spark, UNITS, [a for a, _ in CASES]).collect()
    got = {r.uuid: r.organisasjonsnummer for r in out}
    assert len(out) == len(got) and got == {a[0]: org for a, org in CASES if org}


def test_last_delivery_holds_and_labels_give_confidence(spark):
    cases = [ad("a", "Solvik Hotell", None, "Bu"), ad("a", "Noe annet", None, "Bu", hours=5), ad(None, "Solvik Hotell", None, "Bu")]
    cases += [ad(f"l{k}", "Solvik Hotell", None, "Bu", org="S" if k < 8 else "999") for k in range(10)]
    out = {r.uuid: r for r in run(spark, UNITS, cases).collect()}
    assert set(out) == {f"l{k}" for k in range(10)}
    # eight labels of ten name the firm; all rules together have one right and one wrong label more
    assert abs(out["l0"].firm_confidence - (8 + matching.PRIOR * 9 / 12) / (10 + matching.PRIOR)) < 1e-9
    assert out["l0"].place_confidence == 1 and out["l0"].confidence == out["l0"].firm_confidence


def test_without_labels_and_with_two_workplaces_in_a_town(spark):
    twins = [*UNITS, unit("8", "Tangen Frisør to", "T", "VIK", None, "tangen.example")]
    out = run(spark, twins, [ad("a", "Tangen", "tangen.example", "Vik")]).collect()
    assert [(r.organisasjonsnummer, r.firm_confidence, r.place_confidence, r.confidence) for r in out] == [("7", 0.5, 0.5, 0.25)]


def test_all_towns_and_mails_of_an_ad_count(spark):
    row = ("all", AT, AT, ("t", (None, "Ukjent", None), [("Oslo", None), ("ÅS", None)], [("HR", "x@gmail.example", None), ("HR", "kontakt@fjellbaker.example", None)]), "clash")
    assert [r.organisasjonsnummer for r in run(spark, UNITS, [row]).collect()] == ["2"]


def test_a_board_with_most_ads_and_keys_of_many_workplaces(spark):
    many = [unit(str(100 + k), f"Felles {k}", f"M{k}", "BU") for k in range(200)]
    cases = [ad(f"m{k}", "Felles", "https://jobbside.example/felles", "Bu") for k in range(300)] + [ad("k", "Kvitnes", "https://jobbside.example/kvitnes", "Bu")]
    out = run(spark, [*UNITS, *many], cases).collect()
    assert {r.uuid: r.organisasjonsnummer for r in out} == {"k": "5"}  # a first word of 200 workplaces names none


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    pages, ads = spark.createDataFrame([], PAGES), spark.createDataFrame([], ADS)
    assert matching.match(pages, ads).count() == 0


def test_without_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = {r.uuid: r.organisasjonsnummer for r in run(spark, UNITS, [a for a, _ in CASES]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {a[0]: org for a, org in CASES if org}
