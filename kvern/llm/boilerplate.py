"""The main body of web pages, by differencing pages of near URLs within a host.

Pages stand in the order of host and URL path.  A page is compared with the nearest
different pages before and after it on its host: their lines are aligned by longest
common subsequence, and lines that its neighbours share are deleted.

A difference alone errs where two pages share a line by chance, and says nothing of
a host's only page or of a line that differs from page to page (a teaser, a menu in
other letters).  So what the differences show on all hosts is counted by the form of
a line: how often lines of a form lie inside a body, that is between the page's
heading and its last sentence that no neighbour shares.  A form that hardly ever
does is furniture wherever it stands; one that often does is content, shared or not.
Forms of headings are titles: a title with a date or an ellipsis, after a label that
mostly introduces titles or menu lines, or behind the body, points to another page.  No list of
words is given; all of it comes from the pages.

Texts are read once, where they lie.  Only hashes of lines and of their forms are
sorted and compared, and a page's decision is a byte per line.  A host may hold a
third of all pages: the order is cut into blocks of consecutive pages by a global row
number, each with the pages next to it as context.  Copies of a page count once in a
block, so that a run of copies is no neighbour of itself.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvern.session import Stage

BLOCK = 64  # pages differenced by one call
NEAR = 2  # different pages before and after with which a page is compared
HOSTS = 3  # hosts on which a form must have been seen to tell anything
FURNITURE, CONTENT = 0.2, 0.3  # shares of a form's lines inside bodies, up to and from which it is furniture or content
PART_FURNITURE = 0.1  # the same for a part of a form: its label or its last words
BROADCAST_BYTES = 48 << 20  # size up to which the table of forms goes to every worker; beyond it, it is joined
SLICE = 1000  # pages taken apart at a time

PROSE, DATED, TOLD, BLANK = 1, 2, 4, 8  # bits of a line's shape
IS_FURNITURE, IS_CONTENT, IS_TITLE, IS_POINTER = 1, 2, 4, 8  # bits of what is known of a form

_DATED = re.compile(r"\s*\(\d{1,2}[./]\d{1,2}[./]\d{4}\)$")
_CRUMB = re.compile(r"\s+[»>/›]\s+")
_MARKS = re.compile(r"^[^\w(©]+")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"(?<!^)\b[A-ZÆØÅÄÖ][\w\-]*")
_ADDRESS = re.compile(r"\S+\.\w{2,8}")
_SAYS = re.compile(r"[.!?]$|:\s|,\s|\d")
_YEAR = re.compile(r"[^:,]*\d{4}")
KINDS = ("whole", "named", "label", "end", "tail")  # parts of a form, the most telling first


def host_of(url: str | None, site: str | None) -> str:
    m = re.match(r"(?:[a-z]+:)?//(?:www\.)?([^/?#]+)", (url or "").lower())
    return m.group(1) if m else (site or "").lower()


def path_of(url: str | None) -> str:
    return re.sub(r"^(?:[a-zA-Z]+:)?//[^/?#]*", "", url or "").split("?")[0].split("#")[0]


def form_of(line: str) -> tuple[str, str]:
    """A line without what differs from host to host: digits masked and case gone; and so with names masked too."""
    bare = _DIGITS.sub("#", line if line[:1].isalnum() else _MARKS.sub("", line) or line)
    named = _NAME.sub("@", bare)
    front, gap, last = named.rpartition(" ")
    if "." in last[:-1] and _ADDRESS.fullmatch(last):
        named = f"{front}{gap}@"
    return bare.lower(), named.lower()


def stem_of(line: str) -> str:
    """A line without a date in brackets or an ellipsis at its end."""
    if line.endswith(("...", "…")):
        return line.rstrip(".… ")
    return _DATED.sub("", line) if line.endswith(")") else line


def parts_of(line: str) -> tuple[dict[str, str], str, str]:
    """The parts of a line's form; the named form without a date or ellipsis at the end; that of what a label introduces."""
    whole, named = form_of(line)
    parts = {"whole": whole, "named": named}
    words = named.split()
    front, mark, back = line.partition(": ")
    label = mark and 2 <= len(front) <= 40 and back and ":" not in front
    if label:
        parts["label"] = form_of(front)[0]
    if len(words) > 5:
        parts["end"] = " ".join(words[-4:])
    if len(words) > 3:
        parts["tail"] = " ".join(words[-2:])
    stem = stem_of(line)
    return parts, named if stem == line else form_of(stem)[1], form_of(back)[1] if label else ""


def shape_of(line: str) -> int:
    """Bits: a sentence, cut off or dated, says something itself (and so is no title of another page), blank."""
    if not line:
        return BLANK
    says = len(line) > 60 or bool(_SAYS.search(line)) and not _YEAR.fullmatch(line)
    return (PROSE if len(line) > 40 and line[-1] in ".!?" else 0) | (DATED if stem_of(line) != line else 0) | (TOLD if says else 0)


def _hash(kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind} {text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _slug(text: str) -> str:
    plain = text.lower().replace("æ", "ae").replace("ø", "o").replace("å", "a")
    plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def common_lines(a: list, b: list) -> tuple[set[int], set[int]]:
    """Positions in each of a longest common subsequence, by the pairs of equal lines (Hunt and Szymanski)."""
    places: dict[object, list[int]] = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    ends: list[int] = []
    chains: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            chain = (i, j, chains[k - 1] if k else None)
            ends[k : k + 1], chains[k : k + 1] = [j], [chain]
    left, right, link = set(), set(), chains[-1] if chains else None
    while link:
        left.add(link[0])
        right.add(link[1])
        link = link[2]
    return left, right


def heading(lines: list[str], title: str | None, url: str | None) -> int:
    """Where the page's own heading stands: by the title, the URL's last step, or the last step of a breadcrumb; -1 if nowhere."""
    wanted = " ".join(re.split(r"\s+[|]\s+", title)[0].split()).lower() if title else ""
    slug = _slug(path_of(url).rstrip("/").rsplit("/", 1)[-1])
    if wanted:
        for i, line in enumerate(lines):
            if len(line) == len(wanted) and line.lower() == wanted:
                return i
    if slug:
        for i, line in enumerate(lines):
            if len(line) <= 2 * len(slug) and _slug(line) == slug:
                return i
    for i, line in enumerate(lines[:-1]):
        if lines[i + 1] and line.lower().endswith(lines[i + 1].lower()) and len(steps := _CRUMB.split(line)) > 1 and steps[-1].lower() == lines[i + 1].lower():
            return i + 1
    return -1


def described(description: str | None, lines: list[str], head: int) -> tuple[list[int], list[int], list[int]]:
    """A description's sentences: their lengths, and pairs of a sentence's and a line's number where the line holds it.

    A heading with a colon before the text is left out; the last sentence may be cut off.
    """
    text = re.sub(r"\s*(\.\.\.|…)$", "", " ".join((description or "").split()).lower())
    if not text:
        return [], [], []
    if head >= 0 and lines[head] and text.startswith(lines[head].lower() + ":"):
        text = text[len(lines[head]) + 1 :].strip()
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text) if p]
    low = [x.lower() for x in lines]
    held = [(k, i) for k, p in enumerate(parts) for i, line in enumerate(low) if p in line]
    return [len(p) for p in parts], [k for k, _ in held], [i for _, i in held]


_LINES = ", ".join(f"{k} array<bigint>" for k in ("line", *KINDS, "stem", "rest")) + ", shape binary"


def _take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and shapes of each page's lines.  A slice's equal lines are worked on once."""
    columns = ("line", *KINDS, "stem", "rest")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            page_id, url, site, title, description, texts = part.columns
            coded = texts.flatten().cast(pa.string()).dictionary_encode(null_encoding="encode")
            plain, facts, shapes = [], np.zeros((len(columns), len(coded.dictionary)), np.int64), np.zeros(len(coded.dictionary), np.uint8)
            for k, raw in enumerate(coded.dictionary):
                line = " ".join((raw.as_py() or "").split())
                plain.append(line)
                shapes[k] = shape_of(line)
                facts[0, k] = _hash("line", line)
                if line:
                    parts, stem, rest = parts_of(line)
                    for c, kind in enumerate(KINDS, 1):
                        if kind in parts and not (kind == "named" and parts["whole"] == parts["named"]):
                            facts[c, k] = _hash("form" if c < 3 else kind, parts[kind])
                    facts[-2, k] = _hash("form", stem)
                    facts[-1, k] = _hash("form", rest) if rest else 0
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(coded) else np.empty(0, np.int64)
            bounds = np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            flat = shapes[codes].tobytes()
            out = defaultdict(list)
            for k in range(part.num_rows):
                mine = codes[bounds[k] : bounds[k + 1]]
                lines = [plain[c] for c in mine]
                host, address = host_of(url[k].as_py(), site[k].as_py()), url[k].as_py()
                head = heading(lines, title[k].as_py(), address)
                lengths, sentences, places = described(description[k].as_py(), lines, head)
                same = xxhash.xxh3_128_digest(host.encode("utf-8", "surrogatepass") + b"\0" + facts[0, mine].tobytes())
                row = (host, path_of(address), same, head, lengths, sentences, places, flat[bounds[k] : bounds[k + 1]])
                for name, value in zip(("host", "path", "same", "head", "lengths", "sentences", "places", "shape"), row, strict=True):
                    out[name].append(value)
            lists = {c: pa.ListArray.from_arrays(pa.array(bounds), pa.array(facts[i, codes])) for i, c in enumerate(columns)}
            ints = pa.list_(pa.int32())
            kinds = {"host": pa.string(), "path": pa.string(), "same": pa.binary(), "head": pa.int32(), "lengths": ints, "sentences": ints, "places": ints, "shape": pa.binary()}
            made = {n: pa.array(out[n], t) for n, t in kinds.items()}
            names = ["host", "path", "same", "head", "lengths", "sentences", "places", *columns, "shape"]
            yield pa.RecordBatch.from_arrays([page_id, *[(made | lists)[n] for n in names]], names=["page_id", *names])


def _ordered(taken: DataFrame, stage: Stage) -> DataFrame:
    """Pages' hashes with ``row``, their place in the order of host, path, lines and number.

    The order is total, so rows and blocks are the same however the sort was cut.
    Per-partition counts come to the driver: one number per partition.
    """
    order = ["host", "path", "same", "page_id"]
    rows = taken.select("page_id", "host", "path", "same", "head", "line", *KINDS, "stem", "rest", "shape")
    at = F.monotonically_increasing_id()
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("page_id", "path")
    written = stage.write(sorted_rows.withColumn("part", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1)), "ordered")
    before, offsets = 0, []
    for part, count in sorted((r.part, r["count"]) for r in written.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += count
    starts = taken.sparkSession.createDataFrame(offsets, "part bigint, start bigint")
    return written.join(F.broadcast(starts), "part").withColumn("row", F.col("start") + F.col("place")).drop("part", "place", "start")


_COUNTS = ("forms", "lines_of", "inside_of", "label_forms", "rest_forms", "rest_lines")
_DIFFERENCED = f"same binary, host string, seen int, shared binary, head int, heads bigint, {_LINES}, " + ", ".join(f"{c} array<bigint>" for c in _COUNTS)


def inside(shared: np.ndarray, shape: np.ndarray, head: int) -> tuple[int, int]:
    """A page's body as the differences alone show it: from its heading, or the first line of its own, to its last sentence of its own."""
    own = ~shared & ((shape & BLANK) == 0)
    start = head if head >= 0 else int(np.argmax(own)) if own.any() else len(shape)
    told = np.flatnonzero(own & ((shape & PROSE) > 0))
    return start, int(told[-1]) if len(told) and told[-1] > start else start


def _difference(group: pa.Table) -> pa.Table:
    """A block's different pages, each once, with the lines that most of their neighbours share, and counts of forms per host.

    A host's counts stand in its first row; pages without neighbours don't count.
    """
    group = group.sort_by("row")
    host, same, mine, head, shape = (group[c].to_pylist() for c in ("host", "same", "mine", "head", "shape"))
    lists = {c: _split(group[c].combine_chunks()) for c in ("line", *KINDS, "stem", "rest")}
    first: dict[bytes, int] = {}
    owned: set[bytes] = set()
    for k, s in enumerate(same):
        first.setdefault(s, k)
        if mine[k]:
            owned.add(s)
    pages = sorted(first.values())
    rows = {c: [lists[c][k] for k in pages] for c in lists}
    shapes = [np.frombuffer(shape[k], np.uint8) for k in pages]
    heads = [head[k] for k in pages]
    texts = [x.tolist() for x in rows["line"]]
    votes, seen = [np.zeros(len(t), np.int32) for t in texts], [0] * len(pages)
    for i, at in enumerate(pages):
        for j in range(i + 1, min(len(pages), i + NEAR + 1)):
            if host[at] != host[pages[j]]:
                break
            left, right = common_lines(texts[i], texts[j])
            for k, places in ((i, left), (j, right)):
                seen[k] += 1
                votes[k][list(places)] += 1
    out = defaultdict(list)
    counts: dict[str, tuple[Counter, Counter, Counter]] = {}
    for i, at in enumerate(pages):
        if same[at] not in owned:
            continue
        shared = votes[i] * 2 > seen[i]
        start, last = inside(shared, shapes[i], heads[i])
        new = host[at] not in counts
        lines, within, labels = counts.setdefault(host[at], (Counter(), Counter(), Counter()))
        head_form = int(rows["stem"][i][start]) if 0 <= start < len(shared) else 0
        if seen[i]:
            others = (shapes[i] & BLANK) == 0
            others[start : start + 1] = False
            body = others.copy()
            body[:start] = False
            body[last:] = False
            every = np.concatenate([rows[kind][i][others] for kind in KINDS])
            lines.update(every[every != 0].tolist())
            every = np.concatenate([rows[kind][i][body] for kind in KINDS])
            within.update(every[every != 0].tolist())
        for k in np.flatnonzero(rows["label"][i]):
            labels[int(rows["label"][i][k]), int(rows["rest"][i][k])] += 1
        row = {"same": same[at], "host": host[at], "seen": seen[i], "shared": shared.astype(np.uint8).tobytes(), "head": heads[i], "heads": head_form, "shape": shapes[i].tobytes()}
        row |= {c: rows[c][i] for c in rows} | {c: (host[at] if new else None) for c in _COUNTS}
        for name, x in row.items():
            out[name].append(x)
    for c, pick in (
        ("forms", lambda a, b, d: list(a)), ("lines_of", lambda a, b, d: list(a.values())), ("inside_of", lambda a, b, d: [b[k] for k in a]),
        ("label_forms", lambda a, b, d: [k[0] for k in d]), ("rest_forms", lambda a, b, d: [k[1] for k in d]), ("rest_lines", lambda a, b, d: list(d.values())),
    ):
        out[c] = [None if h is None else pick(*counts[h]) for h in out[c]]
    return pa.table({n: pa.array(out[n], _arrow(k)) for n, k in (f.split(" ", 1) for f in _DIFFERENCED.split(", "))})


def _split(lists: pa.ListArray) -> list[np.ndarray]:
    """A list column's rows as pieces of one array."""
    flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _arrow(kind: str) -> pa.DataType:
    return {"binary": pa.binary(), "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}[kind]


def known_forms(differenced: DataFrame) -> DataFrame:
    """``(form, known)``: bits of what all hosts together tell of a form; forms that nothing is known of are left out.

    A host counts once as a host, whatever its size.  Counts are smoothed, so that a few lines prove nothing.
    """
    zipped = F.explode(F.arrays_zip("forms", "lines_of", "inside_of")).alias("x")
    each = differenced.where("forms IS NOT NULL").select("host", zipped).select("host", F.col("x.forms").alias("form"), F.col("x.lines_of").alias("lines"), F.col("x.inside_of").alias("inside"))
    per_host = each.groupBy("form", "host").agg(F.sum("lines").alias("lines"), F.sum("inside").alias("inside"))
    by_form = per_host.groupBy("form").agg(F.count("*").alias("hosts"), F.sum("lines").alias("lines"), F.sum("inside").alias("inside"))
    wide = by_form.where(F.col("hosts") >= HOSTS)
    whole = (F.col("inside") + 2) / (F.col("lines") + 4) <= FURNITURE
    part = (F.col("inside") + 0.5) / (F.col("lines") + 5) <= PART_FURNITURE
    content = (F.col("lines") >= 4) & (F.col("inside") >= CONTENT * F.col("lines"))
    # bit 1 of a whole form and of a part have different bounds; a part's own bit is 16
    shares = wide.select("form", (F.when(whole, IS_FURNITURE).otherwise(0) + F.when(part & (F.col("lines") >= 8), 16).otherwise(0) + F.when(content, IS_CONTENT).otherwise(0)).alias("bits")).where("bits > 0")
    heads = differenced.where("heads <> 0").select(F.col("heads").alias("form"), "host").distinct().groupBy("form").agg(F.count("*").alias("n"))
    titles = heads.where(F.col("n") >= 2).select("form")
    pairs = differenced.where("label_forms IS NOT NULL").select("host", F.explode(F.arrays_zip("label_forms", "rest_forms", "rest_lines")).alias("x"))
    labels = pairs.groupBy(F.col("x.label_forms").alias("label"), F.col("x.rest_forms").alias("form"), "host").agg(F.sum("x.rest_lines").alias("n"))
    links = titles.unionByName(shares.where(F.col("bits").bitwiseAND(IS_FURNITURE) > 0).select("form")).distinct()  # titles, and lines of menus
    hits = labels.join(links.withColumn("hit", F.lit(True)), "form", "left").groupBy("label", "host").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    pointers = hits.groupBy("label").agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("hits").alias("hits")).where((F.col("hosts") >= HOSTS) & (2 * F.col("hits") >= F.col("n")))
    every = shares.unionByName(titles.select("form", F.lit(IS_TITLE).alias("bits"))).unionByName(pointers.select(F.col("label").alias("form"), F.lit(IS_POINTER).alias("bits")))
    return every.groupBy("form").agg(F.sum("bits").cast("int").alias("known"))


def _look_up(forms: np.ndarray, known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(forms) or not len(wanted):
        return np.zeros(len(wanted), np.int32)
    at = np.minimum(np.searchsorted(forms, wanted), len(forms) - 1)
    return np.where(forms[at] == wanted, known[at], 0)


def classes(rows: dict[str, np.ndarray], shared: np.ndarray, shape: np.ndarray, forms: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A byte per line: furniture, content, title and pointer bits, and the shape's dated and told bits above them.

    The most telling part of a form that is known decides; where nothing is known, the differences do.
    """
    bits = {k: _look_up(forms, known, rows[k]) for k in (*KINDS, "stem")}
    furniture, decided = np.zeros(len(shape), bool), np.zeros(len(shape), bool)
    for kind in KINDS:
        b = bits[kind]
        there = (rows[kind] != 0) & ~decided
        out = there & ((b & (IS_FURNITURE if kind in ("whole", "named") else 16)) > 0)
        kept = there & ~out & ((b & IS_CONTENT) > 0)
        if kind != "whole":
            kept &= ~shared  # the very line is shared: that another one of its form is content doesn't save it
        furniture |= out
        decided |= out | kept
    furniture |= ~decided & shared
    furniture |= (shape & BLANK) > 0
    pointer = (bits["label"] & IS_POINTER) > 0
    title = ((bits["stem"] & IS_TITLE) > 0) & ~pointer
    return (furniture * IS_FURNITURE | title * IS_TITLE | pointer * IS_POINTER | ((shape & DATED) > 0) * 16 | ((shape & TOLD) > 0) * 32).astype(np.uint8)


def _classify(batches: Iterator[pa.RecordBatch], table=None) -> Iterator[pa.RecordBatch]:
    """``(same, seen, classes)``; the forms come from ``table``, or as a page's own lists where it is none."""
    for batch in batches:
        found = []
        columns = {c: batch.column(c) for c in batch.schema.names}
        lists = {c: _split(columns[c]) for c in (*KINDS, "stem")}
        votes, shapes = columns["shared"].to_pylist(), columns["shape"].to_pylist()
        for k in range(batch.num_rows):
            rows = {c: lists[c][k] for c in lists}
            shared, shape = np.frombuffer(votes[k], np.uint8), np.frombuffer(shapes[k], np.uint8)
            if table is None:
                pairs = columns["known"][k].as_py() or []
                forms, known = (np.array([p[c] for p in pairs], t) for c, t in (("form", np.int64), ("known", np.int32)))
                order = np.argsort(forms)
                forms, known = forms[order], known[order]
            else:
                forms, known = table.value
            found.append(classes(rows, shared > 0, shape, forms, known).tobytes())
        yield pa.RecordBatch.from_arrays([columns["same"], columns["seen"], pa.array(found, pa.binary())], names=["same", "seen", "classes"])


def main_lines(known: np.ndarray, head: int) -> list[int]:
    """Positions of the main content, from the classes of a page's lines.

    The body begins at the page's heading, or at the first line that is no furniture,
    and ends behind the last line that says something and is neither furniture nor
    points elsewhere; bare titles right behind it are its own as long as no furniture
    or dated title stands before them.  Inside it, furniture and pointers are deleted.
    """
    furniture, title, pointer, dated, told = ((known & bit) > 0 for bit in (IS_FURNITURE, IS_TITLE, IS_POINTER, 16, 32))
    own = (title | ~furniture) & ~pointer & ~dated
    start = head if head >= 0 else int(np.argmax(own)) if own.any() else len(known)
    firm = ~(furniture | pointer | title | dated | ~told)
    hard = dated | furniture & ~title & ~pointer
    last = np.flatnonzero(firm[start + 1 :])
    end = start + 2 + int(last[-1]) if len(last) else start + 1
    while end < len(known) and not hard[end]:
        end += 1
    return [i for i in range(start, min(end, len(known))) if i == start or own[i]]


def about_this_page(lengths: list[int], sentences: list[int], places: list[int], main: list[int]) -> bool:
    """Whether the main lines say what the description does: half of it at least."""
    body = set(main)
    held = {k for k, i in zip(sentences, places, strict=True) if i in body}
    return bool(held) and 2 * sum(lengths[k] for k in held) >= sum(lengths)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, positions = [], []
        head, lengths, sentences, places, known = (batch.column(c).to_pylist() for c in ("head", "lengths", "sentences", "places", "classes"))
        for k in range(batch.num_rows):
            main = main_lines(np.frombuffer(known[k], np.uint8), head[k])
            found = ([-1] if about_this_page(lengths[k], sentences[k], places[k], main) else []) + main
            pages += [k] * len(found)
            positions += found
        yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(pages, pa.int64())), pa.array(positions, pa.int64())], names=["page_id", "line_no"])


def main_content(pages: DataFrame) -> DataFrame:
    """``(page_id, line_no)`` of main lines, and ``line_no`` -1 for a description of this very page.

    Positions count from 0.  Null or empty ``lines`` give no rows, a null line is
    furniture, null titles, descriptions and URLs tell nothing (the site stands in
    for the host).  Pages alone on their host are judged by the known forms.
    Repeated pages each give their rows.  Other columns are not read.  Runs jobs: hashes,
    order and differences are written to the shared folder.
    """
    spark = pages.sparkSession
    stage = Stage(spark, "boilerplate")
    kind = dict(pages.dtypes)["page_id"]
    schema = f"page_id {kind}, host string, path string, same binary, head int, lengths array<int>, sentences array<int>, places array<int>, {_LINES}"
    some = pages.where(F.size("lines") > 0).select("page_id", "url", "site", "title", "description", "lines")
    taken = stage.write(some.mapInArrow(_take_apart, schema), "taken")
    ordered = _ordered(taken, stage)
    block = (F.col("row") / BLOCK).cast("bigint")
    place = F.col("row") % BLOCK
    also = F.when(place < NEAR, F.array(block, block - 1)).when(place >= BLOCK - NEAR, F.array(block, block + 1)).otherwise(F.array(block))
    members = ordered.select("*", block.alias("own"), F.explode(also).alias("block")).withColumn("mine", F.col("own") == F.col("block")).drop("own")
    differenced = stage.write(members.groupBy("block").applyInArrow(_difference, _DIFFERENCED), "differenced")
    stage.drop("ordered")
    forms = stage.write(known_forms(differenced), "forms")
    out = "same binary, seen int, classes binary"
    used = differenced.select("same", "seen", "shared", "shape", *KINDS, "stem")
    if forms.count() * 24 <= BROADCAST_BYTES:
        got = forms.orderBy("form").toArrow()
        table = spark.sparkContext.broadcast((got["form"].to_numpy(), got["known"].to_numpy()))
        classed = used.mapInArrow(partial(_classify, table=table), out)
    else:
        used = stage.write(used.withColumn("key", F.monotonically_increasing_id()), "keyed")
        each = used.select("key", F.explode(F.array_distinct(F.concat(*KINDS, "stem"))).alias("form")).where("form <> 0")
        known = each.join(forms, "form").groupBy("key").agg(F.collect_list(F.struct("form", "known")).alias("known"))  # at most a page's lines
        classed = used.join(known, "key", "left").drop("key").mapInArrow(_classify, out)
    # of a page that several blocks hold copies of, the one with most neighbours tells
    best = classed.groupBy("same").agg(F.max(F.struct("seen", "classes")).alias("b")).select("same", "b.classes")
    decided = taken.select("page_id", "same", "head", "lengths", "sentences", "places").join(best, "same")
    return decided.drop("same").mapInArrow(_decide, f"page_id {kind}, line_no bigint")
