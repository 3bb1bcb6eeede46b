import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from kvern.sources import bundle, inputs, jobfeed, pages, sinks


def test_input_lists_in_all_forms(spark, tmp_path):
    forms = {
        "a.json": '["923609016", {"orgnr": "990 888 213"}, 5]', "b.json": '{"companies": [{"Organisasjonsnummer": "984862296"}]}', "c.jsonl": '{"org": "923609016"}\n\n{"x": 1}\n"990888213"',
        "d.csv": 'navn;orgnr\n"A; B";923609016\nC;990888213', "e.tsv": "org nr\tx\n923609016\ty", "f.txt": "923609016\nbad\n", "g.txt": "",
        "h.csv": '"organisation_number"\n"923609016"\n', "i.json": '{\n "organisation_numbers": [\n  "923609016",\n  {"ORGNR": 990888213}\n ]\n}\n', "j.txt": '{"organisation_number": broken\n923 609 016\nnot-a-number\n',
        "k.tsv": "name\torganisasjonsnummer\nExample\t923609016\n",
    }
    for name, body in forms.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    rows = inputs.read_inputs(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.position)):
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.org, r.valid))
    by = {name[0]: rows for name, rows in got.items()}
    assert by["a"] == [("923609016", True), ("990888213", True), ("5", False)] and by["b"] == [("984862296", True)]
    assert [x for x in rows if x.file.endswith("c.jsonl")] and {r.entry for r in rows if r.file.endswith("c.jsonl")} == {"923609016", "", "990888213"}
    assert by["d"] == [("923609016", True), ("990888213", True)] and by["e"] == [("923609016", True)] and by["f"] == [("923609016", True), ("bad", False)]
    assert by["h"] == [("923609016", True)] and by["i"] == [("923609016", True), ("990888213", True)] and by["k"] == [("923609016", True)]
    assert [x[1] for x in by["j"]] == [False, True, False] and "g" not in by
    assert all([r.position for r in sorted((r for r in rows if r.file.endswith(n)), key=lambda r: r.position)] == list(range(len(by[n[0]]))) for n in forms if n[0] in by)


HTML = """<html lang="nb"><head><title>Om &amp; oss</title><meta name="description" content="Kort"><link rel="canonical" href="/om">
<link rel="alternate" type="application/rss+xml" href="/rss"><script type="application/ld+json">{"@type": "Organization", "a": [{"@type": "Place"}]}</script>
<script>var x = "skjult";</script></head><body><h1>Hei <b>der</b></h1><p>En<br>to</p><a href="/a"></a><a href="/a">A</a><a href="mailto:x@y.example">x</a></body></html>"""


def test_pages(spark):
    frame = spark.createDataFrame([(HTML, "https://x.example/om/"), (None, None), ("", "u")], "body string, url string")
    one, none, empty = [r.p for r in frame.select(pages.pages_of("body", "url").alias("p")).collect()]
    assert (one.title, one.description, one.h1, one.lang, one.canonical) == ("Om & oss", "Kort", "Hei der", "nb", "https://x.example/om")
    assert one.lines == ["Hei der", "En", "to", "Ax"] and [tuple(x) for x in one.links] == [("https://x.example/a", "A")]
    assert one.feeds == ["https://x.example/rss"] and one.contacts == ["mailto:x@y.example"]
    nodes = pages.structured_nodes(one.jsonld[0])
    assert [(n["path"], n["type"]) for n in nodes] == [("$", '"Organization"'), ("$.a[0]", '"Place"')]
    assert none.title is None and (empty.lines or []) == []


def test_feeds_sitemaps_and_posts(spark):
    rss = "<rss><channel><item><title>A</title><link>u</link><pubDate>d</pubDate></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link href="v"/><updated>e</updated></entry></feed>'
    assert pages.feed_items(rss) == [{"title": "A", "url": "u", "published": "d"}] and pages.feed_items(atom) == [{"title": "B", "url": "v", "published": "e"}]
    assert pages.feed_items("<!DOCTYPE x>" + rss) == pages.feed_items("<rss>") == pages.feed_items(None) == []
    frame = spark.createDataFrame([("<loc> https://a?x=1&amp;y </loc><loc>b</loc>", json.dumps([{"id": 1, "title": {"rendered": "T"}}]))], "m string, p string")
    assert frame.select(pages.sitemap_urls(F.col("m"))).first()[0] == ["https://a?x=1&y", "b"]
    assert [(r.post, r.title) for r in pages.posts(frame, "p").collect()] == [(1, "T")]


def test_replay_takes_the_newest_sound_snapshot(spark, tmp_path):
    shas = {}
    for body in (b"one", b"two"):
        shas[body] = hashlib.sha256(body).hexdigest()
        (tmp_path / f"{shas[body]}.html").write_bytes(body)
    (tmp_path / ("0" * 64 + ".bin")).write_bytes(b"broken")
    day = lambda n: dt.datetime(2026, 1, n)
    rows = [("a", "u", "u", 200, day(1), shas[b"one"], None, None, None), ("b", "u", "u", 200, day(2), shas[b"two"], None, None, None), ("c", "u", "u", 200, day(3), "0" * 64, None, None, None)]
    meta = spark.createDataFrame(rows, bundle.METADATA)
    bodies = bundle.read_bodies(spark, str(tmp_path))
    assert [r.id for r in bundle.replay(meta, bodies).collect()] == ["b"]
    assert [r.id for r in bundle.replay(meta, bodies, "2026-01-01 12:00:00").collect()] == ["a"]


def test_job_feed_and_sinks(spark, tmp_path):
    rows = [("a", "ACTIVE", 1, 1), ("a", "INACTIVE", 2, 1), ("a", "ACTIVE", 1, 9), ("b", "ACTIVE", 1, 1)]
    feed = spark.createDataFrame(rows, "uuid string, status string, sistEndret int, received_at int")
    now = jobfeed.current_ads(feed)
    assert {(r.uuid, r.status) for r in now.collect()} == {("a", "INACTIVE"), ("b", "ACTIVE")}
    index = spark.createDataFrame([("a",), ("b",), ("c",)], "uuid string")
    assert {r.uuid for r in jobfeed.nominated(index, now).collect()} == {"b", "c"}
    for run in ("r1", "r2", "r2"):
        sinks.write_run(now, f"{tmp_path}/runs", run)
    assert spark.read.parquet(f"{tmp_path}/runs").groupBy("run_id").count().count() == 2 and spark.read.parquet(f"{tmp_path}/runs").count() == 4
    sinks.write_chunks(spark.range(60), [F.col("id")], f"{tmp_path}/chunks")
    assert {r["chunk"]: r["count"] for r in spark.read.json(f"{tmp_path}/chunks").groupBy("chunk").count().collect()} == {0: 25, 1: 25, 2: 10}
    sinks.write_lines(now, f"{tmp_path}/lines", compress=True)
    assert spark.read.json(f"{tmp_path}/lines").count() == 2
    bodies = spark.createDataFrame([("x",), ("x",), (None,)], "body string")
    assert sinks.content_addressed(bodies, "body").count() == 1
