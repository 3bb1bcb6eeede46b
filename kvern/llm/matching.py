"""Registered workplaces and employers of job ads, matched without a shared key.

A cascade of exact joins in passes: the first uses the strongest attributes, site and
mail hosts; the next one names, labels and mails with the town; the last one words
that are near.  Ads that a pass resolved are anti-joined before the next.  Within a pass
all rules are one join: an ad has a row per rule and key, and the other side has one
row per key, which tells whether the key belongs to one workplace or to several.  So no
join multiplies rows, and nothing is broadcast.  A rule's confidence is its precision
on ads whose employer number is given, smoothed towards that of all rules.

Attributes are taken apart row by row; hosts shared by several firms (mail
providers) and sites that carry ads of many employers (job boards) are found by
counting over all rows.  A job board may carry a third of all ads: its host is a key
with one row on the other side, so the skewed partition is split and nothing but that row repeated.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.session import Stage

BOARD_EMPLOYERS = 10  # first path steps on a site of no registered firm that make it a job board
PRIOR = 5.0  # smoothing of a rule's labelled precision: as if so many labels of all rules' precision had been seen
MIN_CONFIDENCE = 0.5

#: Short forms of company kinds, and hosts' parts that name no firm.
KINDS = frozenset("as asa ans da enk sa sti ba nuf iks kf fli stift a s".split())
HOST_PARTS = re.compile(r"^(?:www|karriere|jobb|jobbe|jobs|career|careers|stilling|stillinger)\.")


def fold(text: str | None) -> str:
    plain = (text or "").lower().replace("ø", "o").replace("æ", "ae").replace("å", "a").replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))


def town_key(text: str | None) -> str | None:
    """A place name's letters: postal codes, case and marks don't count."""
    return re.sub(r"[^a-z]", "", fold(text)) or None


def site_parts(url: str | None) -> tuple[str | None, str | None]:
    """Host without its common prefixes, and the first step of the path."""
    bare = re.sub(r"^[a-z]+://", "", fold(url).strip()).split("?")[0].split("#")[0]
    host, _, path = bare.partition("/")
    host = HOST_PARTS.sub("", host).strip(". ")
    return (host, path.strip("/").split("/")[0] or None) if re.fullmatch(r"[a-z0-9.-]+\.[a-z]+", host) else (None, None)


def mail_parts(mail: str | None) -> tuple[str | None, str | None]:
    """The whole address in lower case, and its host."""
    bare = re.sub(r"^mailto:", "", fold(mail).strip())
    m = re.fullmatch(r"([^@\s]+)@([a-z0-9.-]+\.[a-z]+)", bare)
    return (bare, m.group(2)) if m else (None, None)


def name_words(name: str | None, places: set[str | None]) -> tuple[list[str], str | None]:
    """Words of a firm's name without company kind, branch words and a place at the end; and that place."""
    words = [w for w in re.findall(r"[a-z0-9&]+\.?", fold(name)) if w.rstrip(".") not in ("avd", "avdeling", "filial")]
    place = None
    while len(words) > 1 and (words[-1].rstrip(".") in KINDS or words[-1] in places):
        place = words[-1] if words[-1] in places else place
        words.pop()
    return words, place


def _deletions(word: str) -> set[str]:
    """A word and each form with one letter left out: two words one slip apart share one of these."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _keys(name: str | None, places: set[str | None], host: str | None) -> dict[str, str | None]:
    words, _ = name_words(name, places)
    plain = [w.rstrip(".") for w in words]
    core = " ".join(plain) or None
    first = plain[0] if plain else None
    short = len(words) > 1 and (words[0].endswith(".") or len(plain[0]) == 1)
    label = re.sub(r"(-gruppe|-gruppen|-group)$", "", host.rsplit(".", 1)[0]).replace("-", "") if host else None
    return {
        "core": core,
        "tokens": " ".join(sorted(plain)) if len(plain) > 1 else None,
        "first": first,
        "last": plain[-1] if len(plain) > 1 else None,
        "short": first if short else None,
        "label": label,
        "joined": "".join(plain) or None,
    }


#: The rules in the order of the passes.  Those of the last pass may have several keys that lead to different workplaces.
RULES = (
    "site", "mail host",
    "mail and town", "name and town", "name with town", "site label and town", "board step and town", "name words and town", "first word and town",
    "any word and town", "slip in name and town", "abbreviation and town",
)
FIRST_NAMED, FIRST_NEAR = 2, 9
SURE_KEYS = (9,)  # of a near rule with single keys only: a key of several workplaces is none

_AD = "uuid string, towns array<string>, host string, step string, mails array<string>, mail_hosts array<string>, core string, tokens string, first string, last string, short string, label string, words array<string>, ends string, before string, employer string"
_UNIT = "org string, firm string, town string, host string, mail string, mail_host string, core string, tokens string, first string, last string, joined string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "int": pa.int32()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    return pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in schema.names}, schema=schema)


def _take_apart_ads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            host, step = site_parts(r["homepage"])
            mails = [m for m in map(mail_parts, r["mails"] or ()) if m[0]]
            towns = list(dict.fromkeys(t for t in map(town_key, r["cities"] or ()) if t))
            areas = {town_key(x) for x in (*(r["cities"] or ()), *(r["municipals"] or ()))} - {None}
            k = _keys(r["name"], areas, host)
            words = (k["core"] or "").split()
            # without a town, the name's last word or the site's step may be one: the joins will tell
            ends, before = (words[-1], " ".join(words[:-1])) if not towns and len(words) > 1 else (None, None)
            employer = r["employer"] if r["employer"] and r["employer"].strip("0 ") else None
            own = {"uuid": r["uuid"], "towns": towns, "host": host, "step": step, "mails": list(dict.fromkeys(m for m, _ in mails)), "mail_hosts": list(dict.fromkeys(h for _, h in mails))}
            rows.append(own | {"words": words, "ends": ends, "before": before, "employer": employer} | k)
        yield _batch(rows, _AD)


def _take_apart_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            host, _ = site_parts(r["homepage"])
            mail, mail_host = mail_parts(r["mail"])
            town, area = town_key(r["town"]), town_key(r["municipal"])
            rows.append({"org": r["org"], "firm": r["firm"] or r["org"], "town": town, "host": host, "mail": mail, "mail_host": mail_host} | _keys(r["name"], {town, area} - {None}, host))
        yield _batch(rows, _UNIT)


def workplaces(pages: DataFrame) -> DataFrame:
    """One row per registered workplace, as it was last fetched, with its attributes."""
    unit = F.explode("_embedded.underenheter").alias("u")
    rows = pages.select("retrieved_at", "record_id", unit).where("u.organisasjonsnummer IS NOT NULL")
    needed = F.struct(
        F.col("u.overordnetEnhet").alias("firm"), F.col("u.navn").alias("name"), F.col("u.beliggenhetsadresse.poststed").alias("town"),
        F.col("u.beliggenhetsadresse.kommune").alias("municipal"), F.col("u.epostadresse").alias("mail"), F.col("u.hjemmeside").alias("homepage"),
    )
    slim = rows.select(F.col("u.organisasjonsnummer").alias("org"), "retrieved_at", "record_id", needed.alias("u"))
    last = slim.groupBy("org").agg(F.max_by("u", F.struct("retrieved_at", "record_id")).alias("u"))
    return last.select("org", "u.*").mapInArrow(_take_apart_units, _UNIT)


def ads(entries: DataFrame) -> DataFrame:
    """One row per ad, as it was last delivered, with its employer's attributes: all its towns and mails.  A null uuid is none."""
    needed = F.struct(
        F.col("ad_content.employer.orgnr").alias("employer"), F.col("ad_content.employer.name").alias("name"), F.col("ad_content.employer.homepage").alias("homepage"),
        F.col("ad_content.workLocations.city").alias("cities"), F.col("ad_content.workLocations.municipal").alias("municipals"), F.col("ad_content.contactList.email").alias("mails"),
    )
    order = F.struct("received_at", "sistEndret", F.xxhash64("ad_content"))
    slim = entries.where("uuid IS NOT NULL").select("uuid", order.alias("at"), needed.alias("a"))
    return slim.groupBy("uuid").agg(F.max_by("a", "at").alias("a")).select("uuid", "a.*").mapInArrow(_take_apart_ads, _AD)


def host_owners(units: DataFrame, entries: DataFrame, entities: DataFrame | None) -> DataFrame:
    """``(host, firm, open)``: the firm that a host belongs to, null where several do or none; whether it is open to all.

    Hosts of several firms are mail providers or the like; sites of no firm with ads under many steps are job boards.
    """
    of_firm = units.select("firm", F.explode(F.array("host", "mail_host")).alias("host"))
    if entities is not None:
        none = F.lit(None).cast("string")
        flat = entities.select(F.col("organisasjonsnummer").alias("org"), none.alias("firm"), none.alias("name"), none.alias("town"), none.alias("municipal"), F.col("epostadresse").alias("mail"), F.col("hjemmeside").alias("homepage"))
        legal = flat.where("org IS NOT NULL").mapInArrow(_take_apart_units, _UNIT)
        own = legal.join(units.select("firm").distinct(), "firm", "left_semi").select("firm", F.explode(F.array("host", "mail_host")).alias("host"))
        of_firm = of_firm.unionByName(own)
    firms = of_firm.where("host IS NOT NULL").groupBy("host").agg(F.min("firm").alias("lo"), F.max("firm").alias("hi"))
    steps = entries.where("host IS NOT NULL AND step IS NOT NULL").select("host", "step").distinct().groupBy("host").agg(F.count("*").alias("steps"))
    both = firms.join(steps, "host", "full_outer")
    single = F.col("lo") == F.col("hi")
    is_open = F.when(F.col("lo").isNull(), F.col("steps") >= BOARD_EMPLOYERS).otherwise(~single)
    return both.select("host", F.when(single, F.col("lo")).alias("firm"), is_open.alias("open")).where("open OR firm IS NOT NULL")


def _flagged(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """Ads with ``board``, ``bare`` (neither a site nor a mail host of its own), ``firm`` and the rule that told it."""
    hosts = F.concat(
        F.when(F.col("host").isNotNull(), F.array(F.struct(F.lit(0).alias("kind"), F.col("host").alias("host")))).otherwise(F.array()),
        F.transform("mail_hosts", lambda h: F.struct(F.lit(1).alias("kind"), h.alias("host"))),
    )
    met = entries.select("uuid", F.explode(hosts).alias("h")).select("uuid", "h.*").join(owners, "host", "left")
    closed = ~F.coalesce("open", F.lit(False))
    site, mail = F.col("kind") == 0, F.col("kind") == 1
    told = met.groupBy("uuid").agg(
        F.max(site & ~closed).alias("board"), F.max(closed).alias("own"), F.max(F.when(site & closed, F.col("firm"))).alias("site_firm"),
        F.min(F.when(mail & closed, F.col("firm"))).alias("lo"), F.max(F.when(mail & closed, F.col("firm"))).alias("hi"),
    )
    mail_firm = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    return entries.join(told, "uuid", "left").select(
        *entries.columns, F.coalesce("board", F.lit(False)).alias("board"), (~F.coalesce("own", F.lit(False))).alias("bare"),
        F.coalesce("site_firm", mail_firm).alias("firm"), F.when(F.col("site_firm").isNotNull(), 0).when(mail_firm.isNotNull(), 1).alias("rule"),
    )


def _of_firms(named: DataFrame, units: DataFrame, alone: DataFrame) -> DataFrame:
    """``(uuid, rule, org)`` of ads whose firm is known: its workplace in the ad's town, the first of its towns where there are several.

    Without a town: the firm's only workplace, or the one in a town that the name's last word or the site's step names.
    """
    places = units.where("town IS NOT NULL").groupBy("firm", "town").agg(F.min("org").alias("org"))
    places = places.unionByName(alone.select("firm", F.lit("").alias("town"), "org"))
    wanted = F.when(F.size("towns") > 0, F.col("towns")).otherwise(F.array(F.lit(""), "ends", "step"))
    tried = named.select("uuid", "rule", "firm", F.posexplode(wanted).alias("turn", "town")).where("town IS NOT NULL")
    hits = tried.join(places, ["firm", "town"])
    return hits.groupBy("uuid").agg(F.min(F.struct("turn", "rule", "org")).alias("m")).select("uuid", "m.rule", "m.org")


_KEY = "rule int, key bigint"


def _key(rule: int, *parts: str) -> int:
    """A rule's key as a 64-bit hash: joins and aggregations over numbers stay in generated code."""
    return xxhash.xxh3_64_intdigest("\x1f".join((str(rule), *parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _near_keys(first: str | None, last: str | None, town: str) -> Iterator[tuple[int, int]]:
    """A workplace's keys of the last pass: its first word; that with a slip, before its last word or none; any beginning of the first.

    A last word that an ad cuts off is told by its beginnings, without a slip.
    """
    if first and len(first) > 3:
        yield 9, _key(9, first, town)
    if first and len(first) > 4:
        for form in _deletions(first):
            yield 10, _key(10, form, last or "", town)
            if last:
                yield 10, _key(10, form, "", town)
        for end in range(1, len(last or "")):
            yield 10, _key(10, first, last[:end], town)
    if first and last:
        for end in range(1, len(first) + 1):
            yield 11, _key(11, first[:end], last, town)


def _pairs_batch(found: list[tuple[int, int, int]], last: str) -> pa.RecordBatch:
    columns = [pa.array([f[k] for f in found], t) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["rule", "key", last])


def _unit_keys(near: bool):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u in batch.to_pylist():
                town, found = u["town"], []
                if near and town:
                    found += _near_keys(u["first"], u["last"], town)
                if not near:
                    for place in ([town] if town else []) + ([""] if u["alone"] else []):
                        found += [(rule, _key(rule, u[c], place)) for rule, c in ((2, "mail"), (3, "core")) if u[c]]
                        found += [(5, _key(5, x, place)) for x in {u["joined"], u["first"]} if x]
                    if town:
                        found += [(rule, _key(rule, u[c], town)) for rule, c in ((4, "core"), (6, "first"), (7, "tokens"), (8, "first")) if u[c]]
                rows += [(r, k, u["id"]) for r, k in found]
            yield _pairs_batch(rows, "id")

    return keys


def _ad_keys(near: bool):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a in batch.to_pylist():
                found: set[tuple[int, int]] = set()
                if near:
                    first, last = a["first"], a["last"] or ""
                    for town in a["towns"]:
                        found |= {(9, _key(9, w, town)) for w in a["words"]}
                        if first and len(first) > 4:
                            found |= {(10, _key(10, form, last, town)) for form in _deletions(first)}
                        if a["short"] and last:
                            found.add((11, _key(11, a["short"], last, town)))
                else:
                    for town in a["towns"] or [""]:
                        found |= {(2, _key(2, m, town)) for m in a["mails"]}
                        if a["core"]:
                            found.add((3, _key(3, a["core"], town)))
                        if a["label"] and not a["board"]:
                            found.add((5, _key(5, a["label"], town)))
                    if a["before"]:
                        found.add((4, _key(4, a["before"], a["ends"])))
                    for town in a["towns"]:
                        if a["board"] and a["step"]:
                            found.add((6, _key(6, a["step"], town)))
                        if a["bare"]:
                            found |= {(rule, _key(rule, a[c], town)) for rule, c in ((7, "tokens"), (8, "first")) if a[c]}
                rows += [(r, k, a["ad"]) for r, k in found]
            yield _pairs_batch(rows, "ad")

    return keys


def _pass(open_ads: DataFrame, units: DataFrame, near: bool) -> DataFrame:
    """``(uuid, rule, org)``: the first rule of a pass by which an ad meets a single workplace."""
    table = units.mapInArrow(_unit_keys(near), _KEY + ", id bigint").groupBy("rule", "key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    single = F.col("lo") == F.col("hi")
    table = table.where(~F.col("rule").isin(*SURE_KEYS) | single if near else single)
    met = open_ads.mapInArrow(_ad_keys(near), _KEY + ", ad bigint").join(table, ["rule", "key"])
    each = met.groupBy("ad", "rule").agg(F.min("lo").alias("id"), F.max("hi").alias("hi")).where("id = hi")
    found = each.groupBy("ad").agg(F.min("rule").alias("rule"), F.min_by("id", "rule").alias("id"))
    return found.join(units.select("id", "org"), "id").join(open_ads.select("ad", "uuid"), "ad").select("uuid", "rule", "org")


def match(pages: DataFrame, entries: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """``(organisasjonsnummer, uuid, rule, firm_confidence, place_confidence, confidence)``: at most one workplace per ad.

    Rules that name a firm (by site or mail host) settle the ad: the workplace is the
    firm's one in the ad's town, its only one where the ad gives no town, else none.
    Weaker rules need the town and hold only for ads without a site of their own that
    no firm registered.  Of two workplaces of a firm in one town the lower number is
    taken, and ``place_confidence`` is one by their number.  ``firm_confidence`` is the
    rule's labelled precision; labels name the firm only.  ``confidence`` is their product.
    Rows with nulls simply lack the rules that need what is missing; repeated
    rows count once; empty tables give no rows; other columns are not read.  Runs jobs.
    """
    stage = Stage(pages.sparkSession, "matching")
    units = stage.write(workplaces(pages), "units")
    every = stage.write(ads(entries), "ads")
    alone = units.groupBy("firm").agg(F.min("org").alias("org"), F.count("*").alias("n")).where("n = 1").select("firm", "org")
    flagged = stage.write(_flagged(every, host_owners(units, every, entities)).withColumn("ad", F.monotonically_increasing_id()), "flagged")

    passes = [stage.write(_of_firms(flagged.where("firm IS NOT NULL"), units, alone), "pass0")]
    rest = flagged.where("firm IS NULL")
    marked = stage.write(units.join(alone.select("org", F.lit(True).alias("alone")), "org", "left").withColumn("id", F.monotonically_increasing_id()), "marked")
    passes.append(stage.write(_pass(rest, marked, near=False), "pass1"))
    bare = rest.where("bare AND size(towns) > 0").join(passes[1].select("uuid"), "uuid", "left_anti")
    passes.append(stage.write(_pass(bare, marked, near=True), "pass2"))

    matched = passes[0].unionByName(passes[1]).unionByName(passes[2])
    beside = units.where("town IS NOT NULL").groupBy("firm", "town").agg(F.count("*").alias("n"))
    placed = units.select("org", "firm", "town").join(beside, ["firm", "town"], "left").select("org", F.col("firm").alias("of"), F.coalesce("n", F.lit(1)).alias("n"))
    full = stage.write(matched.join(placed, "org").join(every.select("uuid", "employer"), "uuid"), "matched")
    labelled = full.where("employer IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("of") == F.col("employer")).alias("right"))
    counts = {r.rule: (r.n, r.right) for r in labelled.collect()}  # a row per rule
    seen, right = (sum(c[k] for c in counts.values()) for k in (0, 1))
    pooled = (right + 1) / (seen + 2)
    sure = F.create_map(*[F.lit(x) for k in range(len(RULES)) for x in (k, (counts.get(k, (0, 0))[1] + PRIOR * pooled) / (counts.get(k, (0, 0))[0] + PRIOR))])[F.col("rule")]
    names = F.array(*map(F.lit, RULES))[F.col("rule")]
    out = full.select(F.col("org").alias("organisasjonsnummer"), "uuid", names.alias("rule"), sure.alias("firm_confidence"), (1 / F.col("n")).alias("place_confidence"))
    return out.withColumn("confidence", F.col("firm_confidence") * F.col("place_confidence"))
