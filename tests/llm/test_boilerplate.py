import random

from kvern.llm import boilerplate
from kvern.llm.boilerplate import common_lines


def naive_lcs(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = h[i][j] + 1 if x == y else max(h[i][j + 1], h[i + 1][j])
    return h[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randrange(15))] for _ in range(2))
        left, right = common_lines(a, b)
        assert [a[i] for i in sorted(left)] == [b[j] for j in sorted(right)] and len(left) == naive_lcs(a, b)


MENU = ["Hopp til hovedinnhold", "Om oss", "Varer", "Kontakt"]
FOOT = ["Besøksadresse: Torget 1, Bu", "Følg oss", "© 2020 Firma. Alle rettigheter reservert."]


def site(host, n, seed):
    rnd = random.Random(seed)
    rows, truth = [], set()
    for k in range(n):
        title = f"Side nummer {seed}-{k}"
        body = [f"Avsnitt {rnd.random()} forteller noe som bare står her, om sak {k}." for _ in range(3)]
        inside = [title, body[0], "Telefon på kveldstid: avtales", "Les også: Varer", body[1], f"Varer: fra {k} kr", body[2]]
        lines = [*MENU, f"Hjem > Varer > {title}", *inside, "Del på Facebook", "Mest lest", "En annen side (1.2.2025)", "Noe mer ...", *FOOT]
        page = seed * 1000 + k
        about = f"{title}: {body[1][:50]}" if k % 2 else "Firma selger varer til hele landet."
        rows.append((page, f"https://{host}/side-nummer-{seed}-{k}", host, f"{title} | Firma", about, lines))
        start = len(MENU) + 1
        truth |= {(page, start + i) for i, x in enumerate(inside) if not x.startswith("Les også")}
        if k % 2:
            truth.add((page, -1))
    return rows, truth


SCHEMA = "page_id bigint, url string, site string, title string, description string, lines array<string>, host string, row int"


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {(r.page_id, r.line_no) for r in boilerplate.main_content(frame).collect()}


def test_main_lines_of_large_small_and_single_sites(spark):
    rows, truth = [], set()
    for seed, n in enumerate((150, 12, 7, 3, 1, 1), 1):
        r, t = site(f"firma{seed}.example", n, seed)
        rows, truth = rows + r, truth | t
    random.Random(0).shuffle(rows)
    assert found(spark, rows) == truth


def test_nulls_copies_and_odd_pages(spark):
    rows, truth = site("firma1.example", 20, 1)
    others = [r for seed in (2, 3, 4) for r in site(f"firma{seed}.example", 8, seed)[0]]  # what forms tell takes several hosts
    copies = [(9000 + k, *rows[3][1:]) for k in range(5)]
    marks = {n for p, n in truth if p == rows[3][0]}
    odd = [(1, None, None, None, None, None), (2, "https://firma1.example/x", "s", None, None, []), (3, None, "firma1.example", None, "", [None, " ", "En linje som sier noe helt for seg selv, uten tittel."])]
    got = found(spark, rows + copies + odd + others)
    assert {x for x in got if x[0] >= 1000 and x[0] < 2000} == truth
    assert all({n for p, n in got if p == c[0]} == marks for c in copies)
    assert {x for x in got if x[0] < 1000} == {(3, 2)}
    assert found(spark, []) == set()


def test_on_one_host_alone_the_differences_decide(spark):
    """Nothing is known of forms there: lines that the neighbours share are deleted, inside the body too."""
    rows, truth = site("firma1.example", 20, 1)
    got = {x for x in found(spark, rows) if x[1] >= 0}
    shared = {(r[0], i) for r in rows for i, x in enumerate(r[5]) if x == "Telefon på kveldstid: avtales"}
    assert not got & shared and {x for x in truth if x[1] >= 0} - shared <= got


def test_a_run_of_copies_longer_than_a_block(spark):
    rows, truth = site("firma1.example", 12, 1)
    others = [r for seed in (2, 3, 4) for r in site(f"firma{seed}.example", 8, seed)[0]]
    copies = [(5000 + k, *rows[6][1:]) for k in range(3 * boilerplate.BLOCK)]
    elsewhere = [(8000 + k, f"https://firma1.example/kopi-{k}", *rows[6][2:]) for k in range(2 * boilerplate.BLOCK)]
    got = found(spark, rows + others + copies + elsewhere)
    marks = {n for p, n in truth if p == rows[6][0]}
    assert {x for x in got if 1000 <= x[0] < 2000} == truth
    assert all({n for p, n in got if p == c[0]} == marks for c in copies + elsewhere)


def test_forms_joined_instead_of_sent(spark, monkeypatch):
    rows = [r for seed in (1, 2, 3, 4) for r in site(f"firma{seed}.example", 8, seed)[0]]
    sent = found(spark, rows)
    monkeypatch.setattr(boilerplate, "BROADCAST_BYTES", 0)
    assert found(spark, rows) == sent and sent


def test_long_lines_that_begin_alike_are_different_forms():
    a, b = ("Vi selger " + "svært " * 60 + x for x in ("fisk.", "brød."))
    assert boilerplate.parts_of(a)[0]["whole"] != boilerplate.parts_of(b)[0]["whole"]


def test_very_long_page():
    long = [f"linje {i}" for i in range(20000)]
    left, right = common_lines(["x", *long], [*long, "y"])
    assert len(left) == len(right) == 20000
